"""Operators against brute force, hand-made cases and properties."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import georef, naming, radiometry
from rasterloom.functions.georef import Affine, Grid
from rasterloom.operators import dataset, morphology, nn, patches, stats, tiling

quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T = Affine(0.5, 0.0, 100.0, 0.0, -0.5, 200.0)


def plain_starts(extent, patch, stride):
    if extent <= patch:
        return [0]
    found = list(range(0, extent - patch + 1, stride))
    return found if found[-1] == extent - patch else [*found, extent - patch]


@quick
@given(extent=st.integers(1, 90), patch=st.integers(1, 40), overlap=st.integers(0, 39))
def test_starts_and_cover(spark, extent, patch, overlap):
    if overlap >= patch:
        with pytest.raises(ValueError):
            tiling.stride_of(patch, overlap)
        return
    stride = tiling.stride_of(patch, overlap)
    want = plain_starts(extent, patch, stride)
    assert spark.range(1).select(tiling.starts(extent, patch, stride)).first()[0] == want
    rows = spark.range(extent).select("id", tiling.starts_covering(F.col("id").cast("int"), extent, patch, stride).alias("s")).collect()
    for at, found in rows:
        assert sorted(found) == [s for s in want if s <= at < s + patch]


def test_tile_and_merge_identity(spark):
    grid = Grid("g", 11, 9, T)
    pixels = spark.createDataFrame([(r, c, float(r * 11 + c)) for r in range(9) for c in range(11)], "row int, col int, value double")
    tiles = tiling.tile_grid(spark, grid, 4, 1)
    padded = tiling.pad(tiling.to_tiles(pixels, grid, 4, 1), tiles, 4)
    merged = tiling.merge_max(tiling.crop(padded, grid).withColumn("pred", F.col("value").cast("smallint")))
    assert {(r, c): p for r, c, p in merged.collect()} == {(r, c): r * 11 + c for r in range(9) for c in range(11)}


def test_narrow_raster_is_padded(spark):
    from rasterloom.plans.prediction import predict_mosaic

    grid = Grid("g", 3, 2, T)
    pixels = spark.createDataFrame([(r, c, float(r + c)) for r in range(2) for c in range(3)], "row int, col int, value double")
    found = {(r, c): p for r, c, p in predict_mosaic(spark, pixels, grid, 8, 2).collect()}
    assert found == {(r, c): (100 * (r + c) // 3 if 100 * (r + c) // 3 > 10 else 0) for r in range(2) for c in range(3)}


@quick
@given(h=st.integers(4, 17), w=st.integers(4, 17), size=st.sampled_from([(4, 4), (4, 2), (2, 1)]))
def test_patches_and_back(spark, h, w, size):
    size, stride = size
    image = spark.createDataFrame([(7, r, c, float(r * w + c)) for r in range(h) for c in range(w)], "image_id long, row int, col int, value double")
    cut = tiling.sliding_patches(image, h, w, size, stride)
    back = {(x.row, x.col): x.value for x in tiling.reconstruct(cut, h, w, size, stride).collect()}
    down, across = [(n // stride - (size // stride - 1 if stride != size else 0) - 1) * stride + size for n in (h, w)]
    assert back == {(r, c): float(r * w + c) if r < down and c < across else 0.0 for r in range(h) for c in range(w)}


def test_guards():
    with pytest.raises(ValueError):
        tiling._patches_along(16, 8, 3)
    with pytest.raises(ValueError):
        naming.rgba(None, "violet")
    with pytest.raises(ValueError):
        nn.unet(dropout_type="none")
    with pytest.raises(ValueError):
        georef.intersect(Grid("a", 1, 1, T), Grid("b", 1, 1, T, crs="EPSG:4326"))
    with pytest.raises(ValueError):
        georef.intersect(Grid("a", 1, 1, T), Grid("b", 1, 1, T.shifted(5, 5)))


def test_fill_and_scale(spark):
    rows = [(1, float("nan")), (1, 4.0), (1, None), (2, 3.0), (2, 3.0), (3, float("inf")), (3, -9999.0)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("f", radiometry.fill_nan(F.col("v"), nodata=-9999.0))
    assert sorted(r.f for r in df.where("k = 1").collect()) == [0.0, 0.0, 4.0]
    assert sorted(r.f for r in df.where("k = 3").collect()) == [0.0, 1.7976931348623157e308]
    flat = df.where("k = 2").select(radiometry.min_max_over(F.col("f"), "k").alias("keep"), radiometry.min_max_over(F.col("f"), "k", constant="null").alias("null"))
    assert [tuple(r) for r in flat.collect()] == [(3.0, None)] * 2


def test_scores_truncate_and_suppress(spark):
    values = [0.10, 0.11, 0.109999, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "p double").select(radiometry.suppress(radiometry.score(F.col("p"))).alias("s"))
    assert [r.s for r in df.collect()] == [0, 11, 0, 100, 0]
    single = spark.createDataFrame([(k / 100,) for k in range(1, 9)], "p double").select(radiometry.score_float(F.col("p")).alias("s"))
    assert [r.s for r in single.collect()] == [int(np.float32(k / 100) * np.float32(100)) for k in range(1, 9)]


def test_thresholds_differ_at_one_half(spark):
    row = spark.createDataFrame([(0.5,)], "p double").select(radiometry.at_least(F.col("p")), radiometry.above(F.col("p"))).first()
    assert tuple(row) == (1.0, 0.0)


@pytest.mark.parametrize(("shape", "strict", "pairwise"), [((257, 10), "skip", "crop"), ((256, 255), "skip", "skip"), ((255, 300), "skip", "skip"), ((256, 256), "keep", "keep"), ((300, 256), "crop", "crop")])
def test_shape_gate(spark, shape, strict, pairwise):
    df = spark.createDataFrame([shape], "h int, w int")
    assert df.select(patches.shape_gate(F.col("h"), F.col("w"), 256), patches.shape_gate(F.col("h"), F.col("w"), 256, compat=True)).first() == (strict, pairwise)


def test_dense_ids_over_spans(spark):
    rows = spark.createDataFrame([(k * 7,) for k in range(40)], "point_id long")
    found = patches.dense_ids(rows, "point_id", start=5, span=32).orderBy("point_id").collect()
    assert [r.patch_id for r in found] == list(range(5, 45))


def test_refill_needs_survivors(spark):
    none = spark.createDataFrame([], "id long")
    with pytest.raises(ValueError):
        dataset.refilled(none, "id", 4, 2)
    few = dataset.refilled(spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id", 4, 2).collect()
    assert len(few) == 8 and {r.id for r in few} == {1, 2, 3} and len({(r.batch_id, r.slot) for r in few}) == 8
    many = dataset.refilled(spark.range(100), "id", 4, 2)
    assert many.select("id").distinct().count() == 8


def test_four_quarter_turns(spark):
    df = spark.createDataFrame([(r, c) for r in range(5) for c in range(5)], "row int, col int")
    turned = df.withColumns({"r": F.col("row"), "c": F.col("col")})
    for _ in range(4):
        r, c = dataset.turned(F.col("r"), F.col("c"), 5, 5, F.lit(False), F.lit(1))
        turned = turned.select("row", "col", r.alias("r"), c.alias("c"))
    assert turned.where("row != r OR col != c").count() == 0
    image = np.arange(25).reshape(5, 5)
    r, c = dataset.turned(F.col("row"), F.col("col"), 5, 5, F.lit(False), F.lit(1))
    for x in df.select("row", "col", r.alias("r"), c.alias("c")).collect():
        assert np.rot90(image)[x.r, x.c] == image[x.row, x.col]


def flood(mask):
    seen, label = {}, 0
    for start in zip(*np.nonzero(mask), strict=True):
        if start in seen:
            continue
        stack, label = [start], int(start[0] * mask.shape[1] + start[1])
        seen[start] = label
        while stack:
            r, c = stack.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                    seen[p] = label
                    stack.append(p)
    return {(int(r), int(c)): v for (r, c), v in seen.items()}


@pytest.mark.parametrize("fill", [0.1, 0.55, 0.65, 1.0])
def test_components_across_blocks(spark, fill):
    mask = np.random.default_rng(3).random((21, 26)) < fill
    df = spark.createDataFrame([(0, r, c, int(mask[r, c])) for r in range(21) for c in range(26)], "image_id long, row int, col int, value int")
    found = {(x.row, x.col): x.label for x in morphology.components(df, 26, block=5).collect()}
    assert found == flood(mask)


def test_snake_across_blocks(spark):
    """One component that crosses the block edges many times."""
    cells = [(r, c) for r in range(0, 16, 2) for c in range(16)] + [(r, 15 if r % 4 == 1 else 0) for r in range(1, 15, 2)]
    df = spark.createDataFrame([(0, r, c, 1) for r, c in cells], "image_id long, row int, col int, value int")
    assert {x.label for x in morphology.components(df, 16, block=4).collect()} == {0}


def test_small_objects(spark):
    cells = [(0, 0), (0, 1), (0, 2), (4, 4), (4, 5), (5, 6)]  # three, two, and one that touches by a corner only
    df = spark.createDataFrame([(0, r, c, 1) for r, c in cells], "image_id long, row int, col int, value int")
    labelled = morphology.components(df, 10, block=4)
    assert {(x.row, x.col) for x in morphology.remove_small(labelled, 3).collect()} == {(0, 0), (0, 1), (0, 2)}
    assert morphology.remove_small(labelled, 1).count() == 6
    assert morphology.remove_small(labelled, 4).count() == 0
    for least in (1, 2, 3, 4):
        assert sorted(map(tuple, morphology.without_small(df, 10, least, block=4).collect())) == sorted(map(tuple, morphology.remove_small(labelled, least).collect()))


@pytest.mark.parametrize("fill", [0.45, 0.62])
def test_labelling_in_levels(spark, fill):
    """Blocks of three pixels, so that three levels of larger blocks are needed; two images of different sizes; repeats."""
    rng = np.random.default_rng(12)
    masks = {3: rng.random((97, 110)) < fill, 9: rng.random((5, 30)) < fill}
    rows = [(k, r, c, int(v)) for k, m in masks.items() for (r, c), v in np.ndenumerate(m)]
    df = spark.createDataFrame([*rows, *rows[:50]], "image_id long, row int, col int, value int")
    found = {k: {} for k in masks}
    for x in morphology.components(df, 110, block=3).collect():
        assert (x.row, x.col) not in found[x.image_id]
        found[x.image_id][x.row, x.col] = x.label
    want = {k: {p: v // m.shape[1] * 110 + v % m.shape[1] for p, v in flood(m).items()} for k, m in masks.items()}
    assert found == want
    sizes = {(k, v): sum(x == v for x in w.values()) for k, w in want.items() for v in set(w.values())}
    large = morphology.without_small(df, 110, 7, block=3).collect()
    assert {(x.image_id, x.row, x.col, x.label) for x in large} == {(k, *p, v) for k, w in want.items() for p, v in w.items() if sizes[k, v] >= 7}
    assert morphology.components(df.limit(0), 110, block=3).count() == morphology.without_small(df.limit(0), 110, 2, block=3).count() == 0


def test_thinning():
    bar = np.zeros((7, 15), bool)
    bar[2:5, 2:13] = True
    thinned = morphology.thin(bar)
    assert thinned.sum(0).max() == 1 and not (thinned & ~bar).any() and thinned[3, 5:10].all()
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert (morphology.thin(line) == line).all()
    ring = np.zeros((11, 11), bool)
    ring[1:10, 1:10] = True
    ring[4:7, 4:7] = False
    thinned = morphology.thin(ring)
    assert len(set(flood_eight(thinned).values())) == 1 and not thinned[5, 5]
    rng = np.random.default_rng(5)
    for _ in range(20):
        blob = rng.random((12, 12)) < 0.6
        thinned = morphology.thin(blob)
        assert not (thinned & ~blob).any()
        assert len(set(flood_eight(thinned).values())) <= len(set(flood_eight(blob).values()))


def flood_eight(mask):
    seen = {}
    for start in zip(*np.nonzero(mask), strict=True):
        if start not in seen:
            stack = [start]
            seen[start] = start
            while stack:
                r, c = stack.pop()
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        p = (r + dr, c + dc)
                        if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                            seen[p] = start
                            stack.append(p)
    return seen


def test_weighted_stats(spark):
    rows = [(k, (k * 37) % 11 + 1) for k in range(1, 100)]
    df = spark.createDataFrame(rows, "value int, n int")
    found = stats.band_stats(df, weight=F.col("n")).first()
    values = np.repeat([k for k, _ in rows], [n for _, n in rows])
    assert found["mean"] == pytest.approx(values.mean(), abs=1e-9) and found.stddev == pytest.approx(values.std(), abs=1e-9) and found.valid_percent == 100
    empty = stats.band_stats(df.where("value > 1000")).first()
    assert empty["mean"] is None and empty.minimum is None
    counts = {r.bucket: r["count"] for r in stats.histogram(spark.createDataFrame([(0,), (1,), (1,), (99,), (100,)], "value int"), 0.505, 99.495, 99).collect()}
    assert len(counts) == 99 and counts[1] == 2 and counts[99] == 1 and sum(counts.values()) == 3


@pytest.mark.parametrize(
    ("net", "n"),
    [(nn.unet(), 1_989_477), (nn.unet(attention=False), 1_945_233), (nn.unet(filters=32), 7_943_877), (nn.vnet(), 5_649_329), (nn.unpadded_unet(), 31_030_593), (nn.satellite_unet(), 1_616_289)],
)
def test_parameter_counts(net, n):
    assert net.n_parameters() == n


def test_network_shapes():
    for net, shape, out in [
        (nn.unet(filters=2, layers=2), (2, 8, 12, 1), (2, 8, 12, 1)), (nn.unet(filters=2, layers=1, upsample="simple", normed=False), (1, 4, 4, 1), (1, 4, 4, 1)), (nn.vnet(filters=2, layers=1), (1, 4, 4, 4, 1), (1, 4, 4, 4, 1)),
        (nn.unpadded_unet(filters=2, layers=2), (1, 48, 48, 1), (1, 8, 8, 1)), (nn.satellite_unet(layers=1, filters=2, wide=3), (1, 8, 8, 1), (1, 8, 8, 1)),
    ]:
        y = net.forward(np.random.default_rng(0).random(shape), net.weights())
        assert y.shape == out and (y >= 0).all() and (y <= 1).all()


def test_layers_against_loops():
    rng = np.random.default_rng(1)
    x, k, b = rng.random((1, 5, 6, 2)).astype("f4"), rng.random((3, 3, 2, 4)).astype("f4"), rng.random(4).astype("f4")
    want = np.zeros((1, 3, 4, 4))
    for r in range(3):
        for c in range(4):
            want[0, r, c] = np.einsum("ijk,ijkf->f", x[0, r : r + 3, c : c + 3], k) + b
    assert np.allclose(nn._conv(x, k, b, None, "valid"), want, atol=1e-5)
    up = nn._deconv(x, k[:2, :2], b)
    assert up.shape == (1, 10, 12, 4) and np.allclose(up[0, 3, 5], x[0, 1, 2] @ k[1, 1] + b, atol=1e-5)
    assert nn._pool(x).shape == (1, 2, 3, 2) and nn._pool(x)[0, 1, 2, 0] == x[0, 2:4, 4:6, 0].max()


def test_training_callbacks():
    assert nn.early_stop([3, 2, 2.5, 2.6], patience=2) == 3 and nn.early_stop([3, 2, 1], patience=2) is None
    assert nn.reduced_rate([1, 1, 1, 1, 1], 0.1, patience=2) == pytest.approx(0.025)
    assert nn.is_best([3, 2]) and not nn.is_best([2, 2]) and not nn.is_best([])
    assert dataset.steps_per_epoch(100, 8) == {"intended": 12, "divided_twice": 1}


def test_names(spark):
    df = spark.createDataFrame([("a/image_1/12_img.tif", "Net_x_512px"), ("plain.tif", "Net")], "path string, model string")
    rows = df.select(naming.label_name(F.col("path")), naming.patch_size(F.col("model")), naming.stem(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [("a/image_1/12_lab.tif", 512, "12_img"), ("plain.tif", None, "plain")]
    with pytest.raises(Exception, match="no patch size"):
        df.select(naming.required_patch_size(F.col("model"))).collect()


def test_reprojection(spark):
    df = spark.createDataFrame([(13.4, 52.5)], "x double, y double")
    x, y = georef.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    there = df.select(x.alias("x"), y.alias("y"))
    assert there.first().x == pytest.approx(1491681.18, abs=0.1)
    x, y = georef.reproject(F.col("x"), F.col("y"), "EPSG:3857", "EPSG:4326")
    assert tuple(there.select(x, y).first()) == pytest.approx((13.4, 52.5))
    with pytest.raises(ValueError):
        georef.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:2154")


def test_counts_are_observed(spark):
    rows, seen = stats.counted(spark.range(10), even=F.col("id") % 2 == 0)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


@quick
@given(h=st.integers(1, 70), w=st.integers(1, 70), patch=st.integers(1, 30), overlap=st.integers(0, 29))
def test_tile_grid(spark, h, w, patch, overlap):
    if overlap < patch:
        found = tiling.tile_grid(spark, Grid("g", w, h, T), patch, overlap).collect()
        want = [(r, c, min(patch, h - r), min(patch, w - c)) for r in plain_starts(h, patch, patch - overlap) for c in plain_starts(w, patch, patch - overlap)]
        assert sorted(map(tuple, found)) == want


@pytest.mark.parametrize("shape", [(40, 50), (16, 16), (33, 16)])
def test_thinning_in_blocks_equals_thinning_whole(spark, shape):
    rng = np.random.default_rng(sum(shape))
    image = np.zeros(shape, bool)
    for _ in range(12):
        r, c = rng.integers(0, shape[0] - 6), rng.integers(0, shape[1] - 6)
        image[r : r + rng.integers(2, 25), c : c + rng.integers(2, 25)] = True
    df = spark.createDataFrame([(3, int(r), int(c), 1) for r, c in zip(*np.nonzero(image))], "image_id long, row int, col int, value int")
    found = morphology.thinned(df, *shape, block=16, halo=4).collect()
    assert sorted((r.row, r.col) for r in found) == sorted(zip(*(x.tolist() for x in np.nonzero(morphology.thin(image)))))
    assert morphology.thinned(df.limit(0), *shape, block=16, halo=4).count() == 0


def test_utm_coordinates(spark):
    from rasterloom.functions import georef

    # the meridian's arc from the equator to 45 degrees north is 4,984,944.378 m on this ellipsoid
    rows = [("a", 15.0, 0.0, 500000.0, 0.0), ("b", 15.0, 45.0, 500000.0, 4984944.378 * 0.9996)]
    df = spark.createDataFrame(rows, "name string, lon double, lat double, x double, y double")
    x, y = georef.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32633")
    for r in df.select("x", "y", x.alias("u"), y.alias("v")).collect():
        assert r.u == pytest.approx(r.x, abs=1e-3) and r.v == pytest.approx(r.y, abs=1e-3)
    grid = [(float(a), float(b)) for a in range(-3, 4) for b in range(-80, 85, 7)]
    points = spark.createDataFrame(grid, "a double, b double")
    for zone, meridian in (("EPSG:32633", 15), ("EPSG:32701", -177), ("EPSG:25832", 9)):
        x, y = georef.reproject(F.col("a") + meridian, F.col("b"), "EPSG:4326", zone)
        lon, lat = georef.reproject(x, y, zone, "EPSG:4326")
        assert all(abs(r.p) < 1e-8 and abs(r.q) < 1e-8 for r in points.select((lon - meridian - F.col("a")).alias("p"), (lat - F.col("b")).alias("q")).collect())
    # lengths: a hundredth of a degree on the central meridian is about 1,105.7 m times 0.9996 at the equator
    one = points.limit(1).select((georef.reproject(F.lit(15.0), F.lit(0.01), "EPSG:4326", "EPSG:32633")[1]).alias("y")).first().y
    assert one == pytest.approx(1105.743 * 0.9996, abs=0.01)


def test_weighted_statistics_far_from_zero(spark):
    from rasterloom.operators import stats

    values = [1e9 + k / 10 for k in range(50)]
    df = spark.createDataFrame([(v, 1 + k % 3) for k, v in enumerate(values)], "value double, w int")
    weights = [1 + k % 3 for k in range(50)]
    want = np.sqrt(np.cov([v - 1e9 for v in values], fweights=weights, ddof=0))
    assert stats.band_stats(df, weight=F.col("w")).first().stddev == pytest.approx(want, rel=1e-6)
    assert stats.band_stats(df).first().stddev == pytest.approx(np.std([v - 1e9 for v in values]), rel=1e-6)


def test_prj_and_attributes():
    from rasterloom.sources import vector

    rows = [{"id": "1", "name": "Ärger"}, {"id": "22", "name": ""}]
    assert vector.parse_attributes(vector.encode_attributes(rows)) == rows and vector.parse_attributes(vector.encode_attributes([])) == []


@pytest.mark.parametrize("kind", ["unet", "plain", "simple", "satellite", "unpadded", "vnet"])
def test_gradients_against_finite_differences(kind):
    from rasterloom.operators import learning, nn

    net, size = {
        "unet": (nn.unet(filters=2, layers=1), 4), "plain": (nn.unet(filters=2, layers=1, attention=False, normed=False), 4), "simple": (nn.unet(filters=2, layers=1, upsample="simple"), 4),
        "satellite": (nn.satellite_unet(layers=1, filters=2, wide=3), 8), "unpadded": (nn.unpadded_unet(filters=2, layers=1), 20), "vnet": (nn.vnet(filters=1, layers=1), 4),
    }[kind]
    rng = np.random.default_rng(4)
    x = rng.random((2, *(size,) * net.space, 1))
    weights = net.rule_weights()
    y = (rng.random(net.forward(x, weights, np.float64).shape[:-1]) > 0.5).astype(float)
    loss, found, _ = learning.gradients(net, x, y, weights)
    flat, got = learning.packed(net, weights), learning.packed(net, found)
    fixed = np.concatenate([np.full(int(np.prod(net.steps[i].shapes[n])), n in learning.FIXED) for i, n in learning._names(net)])
    assert (got[fixed] == 0).all()
    for k in rng.choice(np.flatnonzero(~fixed), 40):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (learning.gradients(net, x, y, learning.unpacked(net, up))[0] - learning.gradients(net, x, y, learning.unpacked(net, down))[0]) / 2e-6
        assert got[k] == pytest.approx(slope, rel=1e-3, abs=1e-4), (k, loss)


@pytest.mark.parametrize("kind", ["spatial", "standard"])
def test_gradients_under_dropout(kind):
    """With one mask held fixed, the gradients still follow finite differences; the masks are what they should be."""
    from rasterloom.operators import learning, nn

    net = nn.unet(filters=3, layers=1, dropout=0.4, dropout_change=0.1, dropout_type=kind, dropout_up=True)
    assert sorted(r for r, _ in net.drops.values()) == [0.4, 0.4, 0.5] and {s for _, s in net.drops.values()} == {kind == "spatial"}
    rng = np.random.default_rng(6)
    x, weights, draw = rng.random((3, 4, 4, 1)), net.rule_weights(), (17, np.array([5, 9, -2]))
    y = (rng.random((3, 4, 4)) > 0.5).astype(float)
    loss, found, _ = learning.gradients(net, x, y, weights, draw)
    assert loss != learning.gradients(net, x, y, weights)[0] != learning.gradients(net, x, y, weights, (18, draw[1]))[0]
    flat, got = learning.packed(net, weights), learning.packed(net, found)
    fixed = np.concatenate([np.full(int(np.prod(net.steps[i].shapes[n])), n in learning.FIXED) for i, n in learning._names(net)])
    for k in rng.choice(np.flatnonzero(~fixed), 40):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (learning.gradients(net, x, y, learning.unpacked(net, up), draw)[0] - learning.gradients(net, x, y, learning.unpacked(net, down), draw)[0]) / 2e-6
        assert got[k] == pytest.approx(slope, rel=1e-3, abs=1e-4)


def test_drop_masks():
    from rasterloom.operators import learning

    ids = np.arange(2_000)
    cells, channels = learning.drop_mask(3, ids, 4, (2_000, 5, 5, 2), 0.3, False), learning.drop_mask(3, ids, 4, (2_000, 5, 5, 20), 0.3, True)
    for mask in (cells, channels):
        assert set(np.unique(mask)) == {0.0, 1 / 0.7} and mask.mean() == pytest.approx(1, abs=0.02)
        assert np.abs(mask.mean(axis=tuple(range(1, mask.ndim))).mean() - 1) < 0.02 and np.abs(np.corrcoef(mask[:-1].ravel(), mask[1:].ravel())[0, 1]) < 0.02
    assert channels.shape == (2_000, 1, 1, 20)
    assert (learning.drop_mask(3, ids[::-1], 4, (2_000, 5, 5, 2), 0.3, False)[::-1] == cells).all()  # a patch's own, wherever it is
    assert (learning.drop_mask(3, ids, 5, (2_000, 5, 5, 2), 0.3, False) != cells).any()


def test_history_holds_the_metrics(spark):
    from rasterloom.functions import metrics
    from rasterloom.operators import learning, nn

    rng = np.random.default_rng(1)
    rows = [(i, i // 8, a.tolist(), (a > 0.5).astype(float).tolist()) for i, a in enumerate(rng.random((24, 16)))]
    df = spark.createDataFrame(rows, "id long, batch_id long, x array<double>, y array<double>").repartition(3)
    net = nn.unet(filters=2, layers=1, dropout=0.3)
    weights, history = learning.train(df, df, net, net.weights(3), 4, 2, rate=0.03)
    again = learning.train(df.repartition(1), df, net, net.weights(3), 4, 2, rate=0.03, seed=1)[1]
    assert set(history[0]) == {"epoch", "loss", "iou", "iou_thresholded", "val_loss", "val_iou", "val_iou_thresholded", "rate", "kept"} and again[0]["loss"] != history[0]["loss"]
    best = min(history, key=lambda h: h["val_loss"])
    p = {r.tile_id: r.data for r in nn.predict_tiles(df.selectExpr("id AS tile_id", "x AS data"), net, weights, 4, precision="double").collect()}
    cells = spark.createDataFrame([(y, q) for i, _, _, ys in rows for y, q in zip(ys, p[i], strict=True)], "y double, p double")
    soft, hard = cells.agg(metrics.iou(F.col("y"), F.col("p")), metrics.iou_at_least(F.col("y"), F.col("p"))).first()
    assert (best["val_iou"], best["val_iou_thresholded"]) == (pytest.approx(soft), pytest.approx(hard))
    y, q = np.array([v for *_, ys in rows for v in ys]), np.array([v for i in range(24) for v in p[i]])
    assert learning.overlaps(learning.tally(y, q)) == (pytest.approx(soft), pytest.approx(hard))
    with pytest.raises(ValueError):
        nn.unet(dropout=0.9, dropout_change=0.1, layers=2)


def test_training_lowers_the_loss(spark, tmp_path):
    from rasterloom.operators import learning, nn

    rng = np.random.default_rng(0)
    x = rng.random((48, 16))
    rows = [(i, i // 16, a.tolist(), (a > 0.5).astype(float).tolist()) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, batch_id long, x array<double>, y array<double>").repartition(3)
    net = nn.unet(filters=2, layers=1)
    weights, history = learning.train(df, df, net, net.weights(3), 4, 6, rate=0.03)
    assert history[-1]["loss"] < 0.8 * history[0]["loss"] and any(h["kept"] for h in history)
    best = min(h["val_loss"] for h in history)
    assert learning.mean_loss(df, net, weights, 4) == pytest.approx(best, rel=1e-6)
    whole = learning.gradient_sums(df, net, net.weights(3), 4, at_once=100)
    parts = learning.gradient_sums(df.coalesce(1), net, net.weights(3), 4, at_once=100)
    assert whole[1] == parts[1] == 48 * 16
    assert learning.train(df.limit(0), df, net, net.weights(3), 4, 2)[1] == []


def test_windows_are_cut_from_blocks(spark):
    """A pixel is dealt once for each block near it, not for each window; blocks without pixels are scored, too."""
    from rasterloom.functions.georef import Affine, Grid
    from rasterloom.operators import nn, tiling

    grid, block, size, inner = Grid("g", 21, 90, Affine(0.5, 0.0, 0.0, 0.0, -0.5, 0.0)), 16, 20, 4
    margin, rng = (size - inner) // 2, np.random.default_rng(8)
    image = np.where(rng.random((90, 21)) < 0.8, rng.random((90, 21)) * 9 - 3, 0)
    image[24:72] = 0
    image[:20, :14] = 2.5
    there = image != 0
    pixels = spark.createDataFrame([(int(r), int(c), float(image[r, c])) for r, c in zip(*np.nonzero(there), strict=True)], "row int, col int, value double")
    blocks = tiling.margined_blocks(pixels, grid, block, margin)
    assert blocks.count() == 6 * 2 and blocks.where("size(k) = 0").count() > 0
    near = lambda at, n: sum(block * b - margin <= at < block * (b + 1) + margin for b in range(n))
    assert blocks.selectExpr("sum(size(k))").first()[0] == sum(near(r, 6) * near(c, 2) for r, c in zip(*np.nonzero(there), strict=True))
    net = nn.unpadded_unet(filters=1, layers=1)
    found = {(r.row_off, r.col_off): r.data for r in nn.predict_windows(blocks, net, net.rule_weights(), grid, block, size, inner, at_once=5, precision="double").collect()}
    assert sorted(found) == [(r, c) for r in range(0, 90, inner) for c in range(0, 21, inner)]
    wide = np.pad(image, ((margin, margin + inner), (margin, margin + inner)))
    for (r, c), data in found.items():
        x = wide[r : r + size, c : c + size]
        x = (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x
        assert data == pytest.approx(net.forward(x[None, ..., None], net.rule_weights(), np.float64).ravel().tolist(), rel=1e-12)
    with pytest.raises(ValueError):
        nn.predict_windows(blocks, net, net.rule_weights(), grid, block, size, 5)


def test_updates_need_no_jobs_and_no_layout(spark):
    """As many jobs for 12 updates as for two; with places in batches it does not matter how samples are stored."""
    from rasterloom.operators import learning, nn

    rng = np.random.default_rng(2)
    rows = [(i, i // 20, i % 20, a.tolist(), (a > 0.5).astype(float).tolist()) for i, a in enumerate(rng.random((230, 16)))]
    df = spark.createDataFrame(rows, "id long, batch_id long, slot int, x array<double>, y array<double>").cache()
    net = nn.unet(filters=2, layers=1, dropout=0.3)
    jobs, found = [], []
    for k, (parts, per_update) in enumerate([(1, 1), (5, 1), (5, 6)]):
        spark.sparkContext.setJobGroup(f"updates-{k}", "")
        weights, history = learning.train(df.repartition(parts), df, net, net.weights(3), 4, 2, per_update=per_update, rate=0.03)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"updates-{k}")))
        found.append((learning.packed(net, weights), [h["loss"] for h in history]))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] == jobs[2]
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-9) and found[0][1] == pytest.approx(found[1][1], rel=1e-9)
    assert found[1][1] != pytest.approx(found[2][1], rel=1e-3)


def test_an_epoch_in_jobs_and_in_a_stage(spark):
    """Both ways take the same steps; batch 1 is empty and takes none."""
    from rasterloom.operators import learning, nn

    rng = np.random.default_rng(3)
    rows = [(i, i // 10 * 2, a.tolist(), (a > 0.5).astype(float).tolist()) for i, a in enumerate(rng.random((30, 16)))]
    df = spark.createDataFrame(rows, "id long, batch_id long, x array<double>, y array<double>")
    net = nn.unet(filters=2, layers=1, normed=False, dropout=0.3)
    flat = learning.packed(net, net.weights(3))
    args = 5, 1, net, (flat, np.zeros(len(flat)), np.zeros(len(flat)), 0), np.ones(len(flat), bool), 4, 0.03, 7
    (one, *_, steps), *sums = learning._epoch_in_jobs(df, *args)
    (two, *_, same), *again = learning._epoch_in_stage(df, *args)
    assert steps == same == 3 and one == pytest.approx(two, rel=1e-9) and sums[1] == again[1] == 30 * 16
    assert sums[0] == pytest.approx(again[0]) and sums[2] == pytest.approx(again[2])


def test_lots_over_the_edges_of_record_batches():
    import pyarrow as pa

    from rasterloom.operators import learning

    update, lot = np.repeat([0, 0, 1, 3], [20, 5, 37, 1]), np.repeat([0, 1, 2, 9], [20, 5, 37, 1])
    table = pa.table({"update": update, "lot": lot, "k": np.arange(63)})
    wanted = [(0, 16), (0, 4), (0, 5), (1, 16), (1, 16), (1, 5), (3, 1)]
    for size in (1, 7, 20, 63):
        got = list(learning._lots(iter(table.to_batches(max_chunksize=size)), 16))
        assert [(u, b.num_rows) for u, b in got] == wanted and [k for _, b in got for k in b.column("k").to_pylist()] == list(range(63))


def test_places_before_a_turn(spark):
    image = [(7, r, c, float(r * 4 + c)) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(image, "image_id long, row int, col int, value double")
    for flip in (False, True):
        for quarter in range(4):
            row, col = dataset.turned(F.col("row"), F.col("col"), 4, 4, F.lit(flip), F.lit(quarter))
            moved = {(r.r, r.c): r.value for r in df.select(row.alias("r"), col.alias("c"), "value").collect()}
            back = spark.range(16).select("id", dataset.place_before(F.col("id"), 4, F.lit(flip), F.lit(quarter)).alias("k")).collect()
            assert {(r.id // 4, r.id % 4): float(r.k) for r in back} == moved
