"""Queries over image chips and masks: metrics, patching, augmentation, morphology, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import metrics, naming, radiometry
from rasterloom.operators import dataset, morphology, tiling
from rasterloom.plans.registry import query
from rasterloom.sources import grids
from rasterloom.sources.grids import CHIPS_SQL, DTM_SQL, MASK_SQL

_C = f"WITH {CHIPS_SQL}"
SCALED_SQL = """scaled AS (SELECT image_id, "row", col, value, CASE WHEN hi > lo THEN (CAST(value AS DOUBLE) - lo) / (hi - lo) ELSE CAST(value AS DOUBLE) END AS p
  FROM chips JOIN (SELECT image_id, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM chips GROUP BY 1) USING (image_id))"""
_S = f"{_C}, {SCALED_SQL}"
JUDGED_SQL = """judged AS (SELECT image_id, "row", col, CASE WHEN value > 0.05 THEN 1.0E0 ELSE 0.0E0 END AS y, p FROM scaled)"""
_J = f"{_S}, {JUDGED_SQL}"


def _scaled(spark, sf_dir):
    return grids.chips(spark, sf_dir).withColumn("p", radiometry.min_max_over(F.col("value"), "image_id"))


def _judged(spark, sf_dir):
    """Truth: value above 0.05.  Prediction: the scaled value."""
    return _scaled(spark, sf_dir).select("image_id", "row", "col", F.when(F.col("value") > F.lit(0.05), 1.0).otherwise(0.0).alias("y"), "p")


def _placed(spark, sf_dir):
    """Chips as overlapping tiles: twenty a row, six pixels apart."""
    scored = _scaled(spark, sf_dir).withColumn("pred", radiometry.suppress(radiometry.score(F.col("p"))))
    row = F.floor(F.col("image_id") / 20).cast("int") * 6 + F.col("row")
    return scored.select(row.alias("row"), ((F.col("image_id") % 20).cast("int") * 6 + F.col("col")).alias("col"), "pred")


@query(f"""{_S} SELECT CAST(image_id // 20 * 6 + "row" AS INT) AS "row", CAST(image_id % 20 * 6 + col AS INT) AS col,
  CAST(max(CASE WHEN trunc(p * 100) > 10 THEN trunc(p * 100) ELSE 0 END) AS SMALLINT) AS pred FROM scaled GROUP BY 1, 2""")
def tile_mosaic_max(spark, sf_dir):
    return tiling.merge_max(_placed(spark, sf_dir))


@query(f'{_S} SELECT image_id, "row", col, round(CASE WHEN hi > lo THEN (CAST(value AS DOUBLE) - lo) / (hi - lo) END, 9) AS value FROM chips JOIN (SELECT image_id, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM chips GROUP BY 1) USING (image_id)')
def norm_train(spark, sf_dir):
    scaled = radiometry.min_max_over(F.col("value"), "image_id", constant="null")
    return grids.chips(spark, sf_dir).withColumn("value", F.round(scaled, 9))


@query(f'{_C} SELECT image_id, "row", col, CAST(trunc(greatest(value, 0) * 100) AS SMALLINT) AS score, CAST(CASE WHEN trunc(greatest(value, 0) * 100) > 10 THEN trunc(greatest(value, 0) * 100) ELSE 0 END AS SMALLINT) AS kept FROM chips')
def score_quantise(spark, sf_dir):
    """Single precision throughout: the values themselves, from zero on, as probabilities."""
    scored = grids.chips(spark, sf_dir).withColumn("score", radiometry.score_float(F.greatest("value", F.lit(0).cast("float"))))
    return scored.select("image_id", "row", "col", "score", radiometry.suppress(F.col("score")).alias("kept"))


def _metric(name, sql, column, *keys):
    """A metric over all chips, or over groups of them."""
    group = f"{', '.join(keys)}, " if keys else ""
    by = " GROUP BY ALL" if keys else ""

    def run(spark, sf_dir):
        judged = _judged(spark, sf_dir)
        return (judged.groupBy(*keys) if keys else judged).agg(F.round(column(F.col("y"), F.col("p")), 6).alias(name))

    run.__name__ = name
    query(f"{_J} SELECT {group}round({sql}, 6) AS {name} FROM judged{by}")(run)


_IOU = "(sum(y * {p}) + 1) / (sum(y + {p}) - sum(y * {p}) + 1)"
_GE, _GT = "(CASE WHEN p >= 0.5 THEN 1.0E0 ELSE 0.0E0 END)", "(CASE WHEN p > 0.5 THEN 1.0E0 ELSE 0.0E0 END)"
_metric("iou_soft", _IOU.format(p="p"), metrics.iou)
_metric("jaccard", _IOU.format(p="p"), metrics.jaccard)
_metric("iou_ge", _IOU.format(p=_GE), metrics.iou_at_least)
_metric("iou_gt", _IOU.format(p=_GT), metrics.iou_above)
_metric("dice", "(2 * sum(y * p) + 1) / (sum(y + p) + 1)", metrics.dice)
_metric("iou_per_image", _IOU.format(p=_GT), metrics.iou_above, "image_id")
_metric("bce", "avg(-(y * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7))))", metrics.cross_entropy)
_metric("f1", f"2 * sum(y * {_GT}) / (2 * sum(y * {_GT}) + sum(abs(y - {_GT})))", lambda y, p: metrics.f1(y, radiometry.above(p)))
_metric("mask_difference", f"sum(y - {_GT})", lambda y, p: F.sum(y - radiometry.above(p)), "image_id")


@query(f'{_J} SELECT image_id, "row", col, round((1 - (y * p + 100) / (y + p - y * p + 100)) * 100, 6) AS distance FROM judged')
def jaccard_distance(spark, sf_dir):
    judged = _judged(spark, sf_dir).groupBy("image_id", "row", "col")
    return judged.agg(F.round(metrics.jaccard_distance(F.col("y"), F.col("p")), 6).alias("distance"))


@query(f"{_J} SELECT CAST(image_id // 16 AS BIGINT) AS batch_id, round(min(p), 9) AS x_min, round(max(p), 9) AS x_max, min(y) AS y_min, max(y) AS y_max FROM judged GROUP BY 1")
def batch_range(spark, sf_dir):
    judged = _judged(spark, sf_dir).groupBy(F.floor(F.col("image_id") / 16).alias("batch_id"))
    return judged.agg(F.round(F.min("p"), 9).alias("x_min"), F.round(F.max("p"), 9).alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query(f'{_C} SELECT image_id, CAST(i * 3 + j AS INT) AS patch, CAST("row" - i * 2 AS INT) AS r, CAST(col - j * 2 AS INT) AS c, value FROM chips, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j) WHERE "row" BETWEEN i * 2 AND i * 2 + 3 AND col BETWEEN j * 2 AND j * 2 + 3')
def sliding_patches(spark, sf_dir):
    return tiling.sliding_patches(grids.chips(spark, sf_dir), 8, 8, 4, 2)


@query(f"""{_C}, cut AS (SELECT image_id, i * 3 + j AS patch, "row", col, value + (i * 3 + j) AS value FROM chips, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)
  WHERE "row" BETWEEN i * 2 AND i * 2 + 3 AND col BETWEEN j * 2 AND j * 2 + 3)
SELECT image_id, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(arg_max(value, patch) AS DOUBLE) AS value FROM cut GROUP BY 1, 2, 3""")
def reconstruct(spark, sf_dir):
    """Patches with their number added, so that it shows which one a pixel came from."""
    cut = tiling.sliding_patches(grids.chips(spark, sf_dir), 8, 8, 4, 2).withColumn("value", (F.col("value") + F.col("patch").cast("float")).cast("float"))
    back = tiling.reconstruct(cut, 8, 8, 4, 2)
    return back.select("image_id", "row", "col", F.col("value").cast("double").alias("value"))


@query(f"""{_C} SELECT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, coalesce(CAST(value AS DOUBLE), 0) AS value
FROM (SELECT DISTINCT image_id FROM chips) CROSS JOIN (SELECT unnest(range(12)) AS r) CROSS JOIN (SELECT unnest(range(12)) AS c)
LEFT JOIN (SELECT image_id, "row" + 2 AS r, col + 2 AS c, value FROM chips) USING (image_id, r, c)""")
def centre_pad(spark, sf_dir):
    """To 13 x 13: the odd pixel is left out."""
    return tiling.centre_pad(grids.chips(spark, sf_dir), 8, 8, 13).withColumn("value", F.col("value").cast("double"))


@query("SELECT p_partkey, CAST((p_size + 20 - p_partkey % 20) // 2 AS INT) AS before, CAST((p_size + 21 - p_partkey % 20) // 2 AS INT) AS after FROM part")
def crop_shape(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    before, after = tiling.crop_margins(F.col("p_size") + 20, (F.col("p_partkey") % 20).cast("int"))
    return part.select("p_partkey", before.alias("before"), after.alias("after"))


@query(f"""{_C}, taps AS (SELECT o, unnest([CAST(greatest(0, least(f, 7)) AS INT), CAST(greatest(0, least(f + 1, 7)) AS INT)]) AS k, unnest([1 - (t - f), t - f]) AS w
  FROM (SELECT o, t, floor(t) AS f FROM (SELECT o, (o + 0.5E0) * (8 / 12.0E0) - 0.5E0 AS t FROM (SELECT unnest(range(12)) AS o))))
SELECT image_id, CAST(y.o AS INT) AS "row", CAST(x.o AS INT) AS col, round(sum(y.w * x.w * value), 6) AS value
FROM chips JOIN taps y ON y.k = "row" JOIN taps x ON x.k = col GROUP BY image_id, y.o, x.o""")
def resize_bilinear(spark, sf_dir):
    return tiling.resize_bilinear(grids.chips(spark, sf_dir), 8, 8, 12).withColumn("value", F.round("value", 6))


@query(f"""{_C}, turns AS (SELECT vec_id AS image_id, CAST('0x' || substr(md5('42-0-' || vec_id), 1, 1) AS INT) < 8 AS flip, CAST('0x' || substr(md5('42-0-' || vec_id), 2, 1) AS INT) % 4 AS k FROM embeddings),
flipped AS (SELECT image_id, k, "row" AS r, CASE WHEN flip THEN 7 - col ELSE col END AS c, value FROM chips JOIN turns USING (image_id))
SELECT image_id, CAST(CASE k WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS INT) AS "row", CAST(CASE k WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS INT) AS col, value FROM flipped""")
def flip_rot(spark, sf_dir):
    flip, quarter = dataset.drawn_turn(F.col("image_id"))
    row, col = dataset.turned(F.col("row"), F.col("col"), 8, 8, flip, quarter)
    return grids.chips(spark, sf_dir).select("image_id", row.alias("row"), col.alias("col"), "value")


@query(f'{_S} SELECT image_id, "row", col, round((p + 0.05E0 - m) * 1.1E0 + m, 6) AS value FROM scaled JOIN (SELECT image_id, avg(p + 0.05E0) AS m FROM scaled GROUP BY 1) USING (image_id)')
def contrast_brightness(spark, sf_dir):
    from pyspark.sql import Window

    lit = _scaled(spark, sf_dir).withColumn("v", radiometry.brightness(F.col("p"), 0.05))
    mean = F.avg("v").over(Window.partitionBy("image_id"))
    return lit.select("image_id", "row", "col", F.round(radiometry.contrast(F.col("v"), mean, 1.1), 6).alias("value"))


@query(f'{_C} SELECT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, coalesce(CAST(value AS DOUBLE), 0) AS value FROM (SELECT DISTINCT image_id FROM chips) CROSS JOIN (SELECT unnest(range(8)) AS r) CROSS JOIN (SELECT unnest(range(8)) AS c) LEFT JOIN (SELECT image_id, "row" AS sr, col AS sc, value FROM chips) s USING (image_id) WHERE s.sr = c AND s.sc = 7 - r')
def augment_affine(spark, sf_dir):
    """A quarter turn by the general affine sampler, where every pixel has a source."""
    return dataset.affine_sampled(grids.chips(spark, sf_dir), 8, 8, 90.0, 0.0, 0.0, False).withColumn("value", F.col("value").cast("double"))


@query(f'WITH {MASK_SQL} SELECT "row", col, CAST(value AS DOUBLE) AS r, CAST(value AS DOUBLE) AS g, 0.0E0 AS b, CAST(value AS DOUBLE) AS a FROM mask')
def mask_rgba(spark, sf_dir):
    return grids.mask(spark, sf_dir).select("row", "col", *naming.rgba(F.col("value"), "yellow"))


@query(f'WITH {MASK_SQL} SELECT "row", col, CAST(value AS DOUBLE) AS r, 0.0E0 AS g, 0.0E0 AS b, CAST(value AS DOUBLE) AS a FROM mask')
def mask_red(spark, sf_dir):
    return grids.mask(spark, sf_dir).select("row", "col", *naming.rgba(F.col("value"), "red"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 + 2 = 3 THEN 'gray' WHEN p_size % 3 + 2 = 4 AND p_partkey % 4 = 3 THEN 'jet' WHEN p_size % 3 + 2 = 4 AND p_partkey % 4 = 1 THEN 'gray' END AS cmap FROM part")
def colour_map(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", naming.colour_map(F.col("p_size") % 3 + 2, F.col("p_partkey") % 4).alias("cmap"))


def _set_pixels(spark, sf_dir, threshold=100):
    return grids.mask(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), "row", "col", radiometry.binarise_label(F.col("value"), threshold).alias("value"))


_SET_SQL = f'WITH RECURSIVE {MASK_SQL}, px AS (SELECT "row" AS r, col AS c, "row" * 128 + col AS id FROM mask WHERE value > 100)'
_LABEL_SQL = f"""{_SET_SQL}, reach(id, root) AS (SELECT id, id FROM px UNION SELECT n.id, reach.root FROM reach JOIN px p ON p.id = reach.id
  JOIN px n ON (n.r = p.r AND abs(n.c - p.c) = 1) OR (n.c = p.c AND abs(n.r - p.r) = 1) WHERE reach.root < n.id),
labels AS (SELECT id, min(root) AS label FROM reach GROUP BY id)"""


@query(f'{_LABEL_SQL} SELECT CAST(0 AS BIGINT) AS image_id, CAST(id // 128 AS INT) AS "row", CAST(id % 128 AS INT) AS col, CAST(label AS BIGINT) AS label FROM labels')
def components(spark, sf_dir):
    return morphology.components(_set_pixels(spark, sf_dir), grids.WIDTH, block=64)


@query(f'{_LABEL_SQL} SELECT CAST(0 AS BIGINT) AS image_id, CAST(label AS BIGINT) AS label, count(*) AS size FROM labels GROUP BY 2')
def component_sizes(spark, sf_dir):
    return morphology.component_sizes(morphology.components(_set_pixels(spark, sf_dir), grids.WIDTH, block=64))


@query(f"""{_LABEL_SQL} SELECT CAST(0 AS BIGINT) AS image_id, CAST(id // 128 AS INT) AS "row", CAST(id % 128 AS INT) AS col, CAST(label AS BIGINT) AS label FROM labels
WHERE label IN (SELECT label FROM labels GROUP BY 1 HAVING count(*) >= 20)""")
def remove_small(spark, sf_dir):
    return morphology.without_small(_set_pixels(spark, sf_dir), grids.WIDTH, 20, block=64)


@query(f"""WITH {DTM_SQL}, {MASK_SQL} SELECT DISTINCT CAST(0 AS BIGINT) AS image_id, CAST("row" + dr AS INT) AS "row", CAST(col + dc AS INT) AS col
FROM mask, dims, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE value > 240 AND "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND 127""")
def dilate(spark, sf_dir):
    grid = grids.terrain_grid(spark, sf_dir)
    return morphology.dilate(_set_pixels(spark, sf_dir, 240), grid.height, grid.width, 3)


def _chip_masks(spark, sf_dir):
    return grids.chips(spark, sf_dir).select("image_id", "row", "col", radiometry.binarise_label(F.col("value"), 0.0).alias("value"))


#: Neighbours of a cell, clockwise from north, in images of 8 x 8 cells with a margin of one, as lists of 100.
_AROUND = (-10, -9, 1, 11, 10, 9, -1, -11)


def _thin_sql(base: str, steps: int = 24) -> str:
    """Recursive table thin(image_id, k, img), a sub-iteration a row, from `base` (image_id, img); and grown, its end dilated."""
    n = [f"img[k + {1 + o}]" for o in _AROUND]
    turns = " + ".join(f"CAST({n[i]} = 0 AND {n[(i + 1) % 8]} = 1 AS INT)" for i in range(8))
    north, east, south, west = n[0], n[2], n[4], n[6]
    first = f"{north} * {east} * {south} = 0 AND {east} * {south} * {west} = 0"
    second = f"{north} * {east} * {west} = 0 AND {north} * {south} * {west} = 0"
    peel = f"img[k + 1] = 1 AND {' + '.join(n)} BETWEEN 2 AND 6 AND {turns} = 1 AND (CASE WHEN step % 2 = 0 THEN {first} ELSE {second} END)"
    return f"""thin(image_id, step, img) AS (SELECT image_id, 0, img FROM {base} UNION ALL
  SELECT image_id, step + 1, [CASE WHEN {peel} THEN 0 ELSE img[k + 1] END for k in range(100)] FROM thin WHERE step < {steps}),
grown AS (SELECT DISTINCT image_id, k // 10 - 1 + dr AS r, k % 10 - 1 + dc AS c FROM (SELECT image_id, unnest(range(100)) AS k, unnest(img) AS set FROM thin WHERE step = {steps}),
  (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE set = 1 AND k // 10 - 1 + dr BETWEEN 0 AND 7 AND k % 10 - 1 + dc BETWEEN 0 AND 7)"""


_BASE_SQL = """base AS (SELECT vec_id AS image_id, [CASE WHEN k // 10 BETWEEN 1 AND 8 AND k % 10 BETWEEN 1 AND 8 AND embedding[(k // 10 - 1) * 8 + k % 10] > 0 THEN 1 ELSE 0 END for k in range(100)] AS img FROM embeddings)"""
_LARGE_SQL = f"""spread(image_id, step, lab) AS (SELECT image_id, 0, [CASE WHEN img[k + 1] = 1 THEN k + 1 ELSE 0 END for k in range(100)] FROM base UNION ALL
  SELECT image_id, step + 1, [CASE WHEN lab[k + 1] = 0 THEN 0 ELSE greatest(lab[k + 1], {", ".join(f"lab[k + {1 + o}]" for o in (-10, 1, 10, -1))}) END for k in range(100)] FROM spread WHERE step < 40),
large AS (SELECT image_id, [CASE WHEN lab[k + 1] > 0 AND len([x for x in lab if x = lab[k + 1]]) >= 6 THEN 1 ELSE 0 END for k in range(100)] AS img FROM spread WHERE step = 40)"""


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_thin_sql("base")} SELECT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM grown""")
def skeleton_buffer(spark, sf_dir):
    return morphology.skeleton_buffer(_chip_masks(spark, sf_dir), 8, 8)


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_LARGE_SQL}, {_thin_sql("large")} SELECT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, area
FROM grown JOIN (SELECT image_id, CAST(count(*) AS BIGINT) AS area FROM grown GROUP BY 1 HAVING count(*) >= 24) USING (image_id)""")
def label_pipeline(spark, sf_dir):
    """Labels as training sees them: binarised, small objects out, thinned and grown, images with enough area."""
    masks = _chip_masks(spark, sf_dir)
    large = morphology.without_small(masks, 8, 6, block=8).withColumn("value", F.lit(1))
    grown = morphology.skeleton_buffer(large, 8, 8).withColumn("value", F.lit(1))
    return grown.join(morphology.enough_area(grown, 24), "image_id").select("image_id", "row", "col", "area")


_SPINE_SQL = f"""amounts AS (SELECT image_id, radians(-20 + d1 * 40) AS a, radians(-5 + d2 * 10) AS s, -0.1E0 + d3 * 0.2E0 AS shift, flip FROM (
  SELECT vec_id AS image_id, {", ".join(f"CAST('0x' || substr(md5('42-0-{name}-' || vec_id), 1, 8) AS BIGINT) / 4294967296.0E0 AS d{k}" for k, name in enumerate(("rotation", "shear", "shift"), 1))},
  CAST('0x' || substr(md5('42-0-' || vec_id), 1, 1) AS INT) < 8 AS flip FROM embeddings)),
spine AS (SELECT image_id, r, c, r - 3.5E0 - shift * 8 AS y, (CASE WHEN flip THEN 7 - c ELSE c END) - 3.5E0 AS x, a, s FROM amounts, (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c))"""


@query(f"""{_C}, {_SPINE_SQL},
placed AS (SELECT image_id, r, c, floor(cos(a) * y + sin(a) * x + 4.0E0) AS sr, floor((-sin(a) + tan(s) * cos(a)) * y + (cos(a) + tan(s) * sin(a)) * x + 4.0E0) AS sc FROM spine)
SELECT p.image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, coalesce(CAST(value AS DOUBLE), 0) AS value FROM placed p LEFT JOIN chips h ON h.image_id = p.image_id AND h."row" = sr AND h.col = sc""")
def augment_drawn(spark, sf_dir):
    """Every image under a rotation, shear, vertical shift and flip of its own."""
    key = F.col("image_id")
    amounts = [dataset.drawn(key, name, low, -low) for name, low in (("rotation", -20.0), ("shear", -5.0), ("shift", -0.1))]
    return dataset.affine_sampled(grids.chips(spark, sf_dir), 8, 8, *amounts, dataset.drawn_turn(key)[0])


@query(f"""{_C}, {_SPINE_SQL},
placed AS (SELECT image_id, r, c, cos(a) * y + sin(a) * x + 3.5E0 AS sy, (-sin(a) + tan(s) * cos(a)) * y + (cos(a) + tan(s) * sin(a)) * x + 3.5E0 AS sx FROM spine),
weighed AS (SELECT image_id, r, c, floor(sy) + i AS sr, floor(sx) + j AS sc, (CASE i WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE j WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w,
  sy BETWEEN 0 AND 7 AND sx BETWEEN 0 AND 7 AS inside FROM placed, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT p.image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(coalesce(sum(CASE WHEN inside THEN w * value END), 0), 5) AS value
FROM weighed p LEFT JOIN chips h ON h.image_id = p.image_id AND h."row" = sr AND h.col = sc GROUP BY 1, 2, 3""")
def augment_bilinear(spark, sf_dir):
    """The same amounts, with bilinear interpolation and zeros beyond the image."""
    key = F.col("image_id")
    amounts = [dataset.drawn(key, name, low, -low) for name, low in (("rotation", -20.0), ("shear", -5.0), ("shift", -0.1))]
    found = dataset.affine_sampled(grids.chips(spark, sf_dir), 8, 8, *amounts, dataset.drawn_turn(key)[0], order=1)
    return found.withColumn("value", F.round("value", 5))


@query(f"""{_S}, lit AS (SELECT image_id, "row", col, p + (-0.1E0 + CAST('0x' || substr(md5('42-0-brightness-' || image_id), 1, 8) AS BIGINT) / 4294967296.0E0 * 0.2E0) AS v,
  0.9E0 + CAST('0x' || substr(md5('42-0-contrast-' || image_id), 1, 8) AS BIGINT) / 4294967296.0E0 * 0.2E0 AS f FROM scaled)
SELECT image_id, "row", col, round((v - m) * f + m, 6) AS value FROM lit JOIN (SELECT image_id, avg(v) AS m FROM lit GROUP BY 1) USING (image_id)""")
def light_drawn(spark, sf_dir):
    """Every image with a brightness and a contrast of its own."""
    key = F.col("image_id")
    lit = _scaled(spark, sf_dir).withColumn("v", F.col("p") + dataset.drawn(key, "brightness", -0.1, 0.1))
    mean = F.avg("v").over(Window.partitionBy("image_id"))
    return lit.select("image_id", "row", "col", F.round((F.col("v") - mean) * dataset.drawn(key, "contrast", 0.9, 1.1) + mean, 6).alias("value"))


@query(f'{_C} SELECT image_id, count(*) AS area FROM chips WHERE value > 0 GROUP BY 1 HAVING count(*) >= 34')
def min_area(spark, sf_dir):
    return morphology.enough_area(_chip_masks(spark, sf_dir), 34)


_NAMES_SQL = "SELECT c_custkey, '/data/set' || c_nationkey || '/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_image.tif' WHEN c_custkey % 3 = 1 THEN '_img.tif' ELSE '_lab.tif' END AS path FROM customer"


def _names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.when(F.col("c_custkey") % 3 == 0, "_image.tif").when(F.col("c_custkey") % 3 == 1, "_img.tif").otherwise("_lab.tif")
    return c.select("c_custkey", F.concat(F.lit("/data/set"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), kind).alias("path"))


@query(f"WITH names AS ({_NAMES_SQL}) SELECT c_custkey, path, CASE WHEN c_custkey % 3 = 0 THEN replace(path, '_image', '_label') ELSE replace(path, '_img', '_lab') END AS label_path FROM names WHERE c_custkey % 3 < 2")
def name_predicates(spark, sf_dir):
    names = _names(spark, sf_dir).where(F.col("path").endswith(".tif") & (F.col("path").contains("image") | F.col("path").contains("img")))
    return names.withColumn("label_path", naming.label_name(F.col("path")))


@query(f"""WITH names AS ({_NAMES_SQL}), images AS (SELECT c_custkey // 3 AS patch_id, path AS image_path FROM names WHERE c_custkey % 3 = 1),
labels_ AS (SELECT c_custkey // 3 AS patch_id, path AS label_path FROM names WHERE c_custkey % 3 = 2 AND c_custkey % 5 <> 0)
SELECT CAST(patch_id AS BIGINT) AS patch_id, image_path, label_path FROM images JOIN labels_ USING (patch_id)""")
def pair_join(spark, sf_dir):
    """Images and labels of one number; some labels are missing."""
    names = _names(spark, sf_dir).withColumn("patch_id", F.floor(naming.patch_id(F.col("path")) / 3))
    images = names.where(F.col("path").endswith("_img.tif")).select("patch_id", F.col("path").alias("image_path"))
    labels = names.where(F.col("path").endswith("_lab.tif") & (F.col("c_custkey") % 5 != 0)).select("patch_id", F.col("path").alias("label_path"))
    return dataset.pair(images, labels)


_MODELS_SQL = "SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '_' || CAST(p_size * 8 AS VARCHAR) || 'px' END AS model FROM part"


def _models(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("p_size") * 8).cast("string"), F.lit("px")))
    return part.select("p_partkey", F.concat(F.translate("p_name", " ", "_"), tail).alias("model"))


@query(f"WITH m AS ({_MODELS_SQL}) SELECT p_partkey, model, CAST(nullif(regexp_extract(model, '_([0-9]+)px$', 1), '') AS INT) AS patch_size FROM m")
def patch_size_from_name(spark, sf_dir):
    return _models(spark, sf_dir).withColumn("patch_size", naming.patch_size(F.col("model")))


@query(f"WITH m AS ({_MODELS_SQL}) SELECT p_partkey, '/rasters/2020/predictions/map.v' || p_partkey || '_' || model || '_pred.tif' AS path FROM m")
def output_name(spark, sf_dir):
    source = F.concat(F.lit("/rasters/2020/map.v"), F.col("p_partkey").cast("string"), F.lit(".tif"))
    return _models(spark, sf_dir).select("p_partkey", naming.output_name(source, F.col("model"), "predictions").alias("path"))


@query("SELECT s_suppkey, 'model_epoch_' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') || '_valloss_' || format('{:.2f}', (s_suppkey % 7) / 9.0E0 + 0.1E0) || '.h5' AS name FROM supplier")
def checkpoint_name(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", naming.checkpoint_name((F.col("s_suppkey") % 40).cast("int"), (F.col("s_suppkey") % 7) / 9.0 + 0.1).alias("name"))


@query("SELECT CAST(date_part('month', ts) AS INT) AS epoch, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def metric_history(spark, sf_dir):
    """A (epoch, metric, value) table: one value for each metric and epoch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.month("ts").alias("epoch"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


@query(f'{_J} SELECT image_id, "row", col, y, round(p, 9) AS p FROM judged WHERE image_id IN (SELECT DISTINCT image_id FROM judged ORDER BY 1 LIMIT 10)')
def plot_frame(spark, sf_dir):
    """What a figure of the first ten images, their masks and predictions needs."""
    judged = _judged(spark, sf_dir)
    first = judged.select("image_id").distinct().orderBy("image_id").limit(10)
    return judged.join(F.broadcast(first), "image_id").select("image_id", "row", "col", "y", F.round("p", 9).alias("p"))
