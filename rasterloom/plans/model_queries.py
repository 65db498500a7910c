"""Queries with a model, files or a stream; each works on the driver's tables alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import radiometry
from rasterloom.functions.georef import Grid
from rasterloom.operators import catalog, dataset, learning, nn, tiling
from rasterloom.plans import training
from rasterloom.plans.grid_queries import NORM_SQL, PADDED_SQL, TILE_PIXELS_SQL, TILES_SQL
from rasterloom.plans.image_queries import _J, _S, _judged, _placed
from rasterloom.plans.network_sql import network_sql
from rasterloom.plans.prediction import predict_mosaic as predict_plan
from rasterloom.plans.registry import query
from rasterloom.sources import file_sink, grids, tiff, vector
from rasterloom.sources.grids import DTM_SQL, MASK_SQL, POINTS_SQL
from rasterloom.sources.raster_source import read_headers, read_rasters
from rasterloom.sources.scratch import work_folder
from rasterloom.streaming import mosaic as stream


def _shared(spark) -> str:
    return work_folder(spark, "grids")


def _scaled_chip(chips):
    """A column for chips with an embedding: its values between its own extremes, which are taken once a chip."""
    wide = chips.withColumns({"low": F.array_min("embedding").cast("double"), "high": F.array_max("embedding").cast("double")})
    return wide.withColumn("data", F.transform("embedding", lambda x: radiometry.min_max(x, F.col("low"), F.col("high"))))


def _chip_tiles(spark, sf_dir):
    return _scaled_chip(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(F.col("vec_id").alias("tile_id"), "data")


def _forward(net):
    def run(spark, sf_dir):
        out = nn.predict_tiles(_chip_tiles(spark, sf_dir), net, net.rule_weights(), 8, precision="double")
        cell = out.select("tile_id", F.posexplode("data").alias("k", "p"))
        score = radiometry.suppress(radiometry.score_of(cell, "p"))
        return cell.select("tile_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), score.alias("pred"))

    return run


def _pred_sql(p: str) -> str:
    return f"CAST(CASE WHEN trunc({p} * 100) > 10 THEN trunc({p} * 100) ELSE 0 END AS SMALLINT) AS pred"


def _forward_sql(net) -> str:
    layers, last = network_sql(net, 8, "a0")
    return f"""{_S}, a0 AS (SELECT image_id AS t, "row" AS y, col AS x, 0 AS c, p AS v FROM scaled), {layers}
SELECT t AS tile_id, CAST(y AS INT) AS "row", CAST(x AS INT) AS col, {_pred_sql("v")} FROM {last}"""


_UNET, _SATELLITE, _VNET, _UNPADDED = nn.unet(filters=4, layers=2), nn.satellite_unet(layers=1, filters=4, wide=6), nn.vnet(filters=2, layers=2), nn.unpadded_unet(filters=2, layers=2)


@query(_forward_sql(_UNET))
def unet_forward(spark, sf_dir):
    """Scores of all chips by an attention network."""
    return _forward(_UNET)(spark, sf_dir)


@query(_forward_sql(_SATELLITE))
def satellite_forward(spark, sf_dir):
    return _forward(_SATELLITE)(spark, sf_dir)


def _vnet_sql() -> str:
    layers, last = network_sql(_VNET, 8, "a0")
    volumes = "SELECT DISTINCT vec_id // 8 AS t FROM embeddings"
    return f"""{_S}, a0 AS (SELECT t, z, y, x, 0 AS c, coalesce(p, 0) AS v FROM ({volumes}), (SELECT unnest(range(8)) AS z), (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)
  LEFT JOIN scaled ON image_id = t * 8 + z AND "row" = y AND col = x), {layers}
SELECT CAST(t AS BIGINT) AS tile_id, CAST(z * 64 + y * 8 + x AS INT) AS k, {_pred_sql("v")} FROM {last} WHERE t * 8 + z IN (SELECT vec_id FROM embeddings)"""


@query(_vnet_sql())
def vnet_forward(spark, sf_dir):
    """Scores of volumes of eight successive chips by a three-dimensional network.

    Chips that a volume lacks count as zeros; only the cells of chips that exist are returned.
    """
    tiles = _chip_tiles(spark, sf_dir)
    volumes = tiles.groupBy(F.floor(F.col("tile_id") / 8).alias("volume")).agg(F.array_sort(F.collect_list(F.struct("tile_id", "data"))).alias("slices"))
    empty = F.array_repeat(F.lit(0.0), 64)
    at = lambda k: F.get(F.filter("slices", lambda s: s["tile_id"] == F.col("volume") * 8 + k), F.lit(0))["data"]
    whole = volumes.select(F.col("volume").alias("tile_id"), F.flatten(F.array(*[F.coalesce(at(k), empty) for k in range(8)])).alias("data"))
    out = nn.predict_tiles(whole, _VNET, _VNET.rule_weights(), 8, 4, precision="double")
    cell = out.select("tile_id", F.posexplode("data").alias("k", "p")).withColumn("chip", F.col("tile_id") * 8 + F.floor(F.col("k") / 64))
    real = cell.join(tiles.select(F.col("tile_id").alias("chip")), "chip", "left_semi")
    return real.select("tile_id", "k", radiometry.suppress(radiometry.score_of(real, "p")).alias("pred"))


def _unpadded_sql() -> str:
    layers, last = network_sql(_UNPADDED, 48, "a0")
    cells = "SELECT row_off, col_off, y, x, coalesce(CASE WHEN isnan(value) THEN 0 ELSE value END, 0) AS v FROM"
    return f"""WITH {DTM_SQL}, tiles AS (SELECT r * 8 AS row_off, q * 8 AS col_off FROM dims, (SELECT unnest(range(0, CAST((SELECT (h + 7) // 8 FROM dims) AS BIGINT))) AS r), (SELECT unnest(range(16)) AS q)),
cells AS ({cells} (SELECT * FROM tiles, (SELECT unnest(range(48)) AS y), (SELECT unnest(range(48)) AS x)) LEFT JOIN dtm ON "row" = row_off + y - 20 AND col = col_off + x - 20),
a0 AS MATERIALIZED (SELECT row_off * 1000000 + col_off AS t, y, x, 0 AS c, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END AS v
  FROM cells JOIN (SELECT row_off, col_off, min(v) AS lo, max(v) AS hi FROM cells GROUP BY ALL) USING (row_off, col_off)), {layers}
SELECT CAST(t AS BIGINT) AS tile_id, CAST(y * 8 + x AS INT) AS k, round(v, 6) AS p FROM {last}, dims WHERE t // 1000000 + y < h AND t % 1000000 + x < w"""


@query(_unpadded_sql())
def unpadded_forward(spark, sf_dir):
    """Scores of the whole terrain by a network without padding: 8 x 8 cells of each 48 x 48 tile.

    The raster gets a margin of zeros on all sides and tiles lie a stride of 8 apart, so that their inner cells meet; tile
    and cell k give the place in the terrain, and cells of tiles beyond its far edges are left out.
    """
    patch, inner, block = 48, 8, 128
    grid = grids.terrain_grid(spark, sf_dir)
    filled = grids.terrain(spark, sf_dir).withColumn("value", radiometry.fill_nan(F.col("value")))
    blocks = tiling.margined_blocks(filled, grid, block, (patch - inner) // 2)
    tiles = nn.predict_windows(blocks, _UNPADDED, _UNPADDED.rule_weights(), grid, block, patch, inner, precision="double")
    scored = tiles.select((F.col("row_off") * 1_000_000 + F.col("col_off")).alias("tile_id"), F.posexplode("data").alias("k", "p"))
    row, col = F.floor(F.col("tile_id") / 1_000_000) + F.floor(F.col("k") / inner), F.col("tile_id") % 1_000_000 + F.col("k") % inner
    return scored.where((row < grid.height) & (col < grid.width)).withColumn("p", F.round("p", 6))


@query("SELECT * FROM (VALUES ('unet', CAST(1989477 AS BIGINT)), ('unet without attention', 1945233), ('vnet', 5649329), ('unpadded', 31030593), ('satellite', 1616289)) AS t(model, parameters)")
def parameter_counts(spark, sf_dir):
    nets = {"unet": nn.unet(), "unet without attention": nn.unet(attention=False), "vnet": nn.vnet(), "unpadded": nn.unpadded_unet(), "satellite": nn.satellite_unet()}
    return spark.createDataFrame([(k, n.n_parameters()) for k, n in nets.items()], "model string, parameters long")


@query()
def trained_network(spark, sf_dir):
    """The history of three epochs over all chips but a tenth, with the place of values above 0.05 as truth.

    Images and masks are turned alike, by a draw for each.  Training has no SQL form; the tests hold every gradient
    against finite differences.
    """
    e = catalog.dealt(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"), "id")
    parted = dataset.split(e.select("id"), "id")
    position = dataset.shuffled(parted.where(~F.col("is_val")).select("id"), "id")
    truth = F.transform("embedding", lambda x: F.when(x > F.lit(0.05), 1.0).otherwise(0.0))
    pairs = lambda ids: _scaled_chip(e.join(ids, "id")).withColumnRenamed("data", "x").withColumn("y", truth)
    flip, turns = dataset.drawn_turn(F.col("id"))
    rows = pairs(position).withColumns({"batch_id": F.floor(F.col("position") / 64), "slot": (F.col("position") % 64).cast("int"), "flip": flip, "turns": turns})
    places = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: dataset.place_before(k, 8, F.col("flip"), F.col("turns")))
    moved = lambda name: F.transform("at", lambda k: F.get(name, k)).alias(name)
    folder = _shared(spark)
    rows.withColumn("at", places).select("id", "batch_id", "slot", moved("x"), moved("y")).write.parquet(f"{folder}/samples")
    pairs(parted.where("is_val").select("id")).select("id", "x", "y").write.parquet(f"{folder}/validation")
    net = nn.unet(filters=2, layers=1, dropout=0.3)
    _, history = learning.train(spark.read.parquet(f"{folder}/samples"), spark.read.parquet(f"{folder}/validation"), net, net.weights(1), 8, 3, per_update=4, rate=0.01)
    names = ["epoch", "loss", "iou", "iou_thresholded", "val_loss", "val_iou", "val_iou_thresholded", "rate", "kept"]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in history], "epoch int, loss double, iou double, iou_thresholded double, val_loss double, val_iou double, val_iou_thresholded double, rate double, kept boolean")


_LOGISTIC = nn.Network(1)
_LOGISTIC.conv(0, 1, 1, "sigmoid")
_W, _B = (float(_LOGISTIC.rule_weights()[1][name].ravel()[0]) for name in ("kernel", "bias"))
_SMOOTH_IOU = "(sum({t} * {q}) + 1) / (sum({t} + {q}) - sum({t} * {q}) + 1)"


def _epoch_sql(w: str, b: str, source: str) -> str:
    q, hard = f"1 / (1 + exp(-({w} * x + {b})))", "CASE WHEN q >= 0.5E0 THEN 1 ELSE 0 END"
    return f"""SELECT avg((q - y) * x) AS gw, avg(q - y) AS gb, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss, {_SMOOTH_IOU.format(t="y", q="q")} AS iou,
  {_SMOOTH_IOU.format(t="y", q=f"({hard})")} AS iou_thresholded FROM (SELECT x, y, {q} AS q FROM {source})"""


@query(f"""{_S}, cells AS (SELECT s.p AS x, CASE WHEN c.value > 0.05E0 THEN 1.0E0 ELSE 0.0E0 END AS y FROM scaled s JOIN chips c USING (image_id, "row", col)),
before AS ({_epoch_sql(f"{_W!r}E0", f"({_B!r}E0)", "cells")}), moved AS (SELECT {_W!r}E0 - 0.01E0 * gw / (abs(gw) + 1e-7) AS w, {_B!r}E0 - 0.01E0 * gb / (abs(gb) + 1e-7) AS b FROM before),
after AS ({_epoch_sql("w", "b", "cells, moved")})
SELECT 0 AS epoch, round(f.loss, 9) AS loss, round(f.iou, 9) AS iou, round(f.iou_thresholded, 9) AS iou_thresholded, round(a.loss, 9) AS val_loss, round(a.iou, 9) AS val_iou, round(a.iou_thresholded, 9) AS val_iou_thresholded,
  round(w, 9) AS kernel, round(b, 9) AS bias FROM before f, after a, moved""")
def trained_step(spark, sf_dir):
    """One update over all chips of a network of one convolution, judged before and after, and its weights."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    truth = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.when(x > F.lit(0.05), 1.0).otherwise(0.0)).alias("y"))
    rows = _chip_tiles(spark, sf_dir).withColumnRenamed("tile_id", "id").withColumnRenamed("data", "x").join(truth, "id").withColumn("batch_id", F.lit(0))
    weights, (h,) = learning.train(rows, rows, _LOGISTIC, _LOGISTIC.rule_weights(), 8, 1, rate=0.01)
    names = ["loss", "iou", "iou_thresholded", "val_loss", "val_iou", "val_iou_thresholded"]
    found = [round(float(v), 9) for v in (*[h[n] for n in names], *[weights[1][n].ravel()[0] for n in ("kernel", "bias")])]
    return spark.createDataFrame([(0, *found)], f"epoch int, {', '.join(f'{n} double' for n in names)}, kernel double, bias double")


def _saved_chips(spark, sf_dir) -> str:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tiles = e.select(
        F.format_string("%d_img.tif", "vec_id").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("data"),
        (F.lit(500000.0) + F.col("vec_id") * 4).alias("origin_x"), F.lit(6200000.0).alias("origin_y"), F.lit(0.5).alias("resolution"),
    )
    tiff.save(tiff.to_files(tiles), folder := _shared(spark))
    return folder


@query("SELECT vec_id || '_img.tif' AS name, 8 AS width, 8 AS height, 1 AS band_count, 'float32' AS dtype, 500000.0E0 + vec_id * 4 AS c, 6200000.0E0 AS f FROM embeddings")
def raster_headers(spark, sf_dir):
    """All chips written as TIFF files, and their headers read back by ranges."""
    found = read_rasters(spark, _saved_chips(spark, sf_dir), "headers")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "width", "height", "band_count", "dtype", "c", "f")


@query("SELECT vec_id || '_img.tif' AS name, CAST((k - 1) // 8 AS INT) AS \"row\", CAST((k - 1) % 8 AS INT) AS col, embedding[k] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)")
def raster_pixels(spark, sf_dir):
    """All chips written as TIFF files, and their pixels read back."""
    read = read_rasters(spark, _saved_chips(spark, sf_dir), "pixels", bands=[1])
    return read.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "row", "col", F.col("value").cast("float").alias("value"))


_SHEET = 256


@query(f"""WITH {DTM_SQL} SELECT 'sheet_' || "row" // {_SHEET} || '.tif' AS name, 1 AS band, CAST("row" % {_SHEET} AS INT) AS "row", CAST(col AS INT) AS col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value
FROM dtm WHERE NOT isnan(value) AND "row" % {_SHEET} BETWEEN 10 AND 49 AND col BETWEEN 100 AND 119""")
def ranged_window(spark, sf_dir):
    """The terrain in big, tiled files of 256 rows, and one window of each read by ranges of its tiles."""
    row = F.col("row") % _SHEET
    cell = F.struct((row * grids.WIDTH + F.col("col")).cast("int").alias("at"), F.col("value").cast("float").alias("v"))
    sheets = grids.terrain(spark, sf_dir).where(~F.isnan("value")).groupBy(F.floor(F.col("row") / _SHEET).alias("k")).agg((F.max(row) + 1).cast("int").alias("height"), F.collect_list(cell).alias("m"))
    tiles = sheets.select(
        F.format_string("sheet_%d.tif", "k").alias("name"), "height", F.lit(grids.WIDTH).alias("width"), F.transform("m", lambda z: z["at"]).alias("at"), F.transform("m", lambda z: z["v"]).alias("data"),
        F.lit(500000.0).alias("origin_x"), F.lit(6200000.0).alias("origin_y"), F.lit(0.5).alias("resolution"),
    )
    tiff.save(tiff.to_files(tiles, tile=16, big=True, missing=float("nan")), folder := _shared(spark))
    read = read_rasters(spark, folder, "pixels", rows=(10, 50), cols=(100, 120), partition_bytes=1 << 16)
    return read.where(~F.isnan("value")).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "band", "row", "col", "value")


@query("SELECT vec_id || '_img.tif' AS name FROM embeddings")
def list_files(spark, sf_dir):
    found = tiff.files(spark, _saved_chips(spark, sf_dir)).select("path")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


@query("SELECT 'points_' || c_nationkey || '.shp' AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS point_id, CAST(c_custkey AS DOUBLE) / 4 AS x, c_acctbal AS y FROM customer")
def shapefile_points(spark, sf_dir):
    """All customers as points, written as a shapefile for each nation and read back."""
    import pandas as pd

    def encode(pdf):
        ordered = pdf.sort_values("c_custkey")
        content = vector.encode_points(list(zip(ordered["c_custkey"] / 4, ordered["c_acctbal"], strict=True)))
        return pd.DataFrame({"name": [f"points_{pdf['c_nationkey'].iloc[0]}.shp"], "content": [content]})

    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(lambda pdf: encode(pdf), "name string, content binary")
    tiff.save(named, folder := _shared(spark))
    found = vector.read_points(spark, folder)
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "point_id", "x", "y")


@query(f"""{_S} SELECT CAST(image_id // 20 * 6 + "row" AS INT) AS "row", CAST(image_id % 20 * 6 + col AS INT) AS col,
  CAST(max(CASE WHEN trunc(p * 100) > 10 THEN trunc(p * 100) ELSE 0 END) AS SMALLINT) AS pred FROM scaled GROUP BY 1, 2""")
def mosaic_stream(spark, sf_dir):
    """The chip mosaic from scores that arrive as files."""
    folder = _shared(spark)
    _placed(spark, sf_dir).repartition(4).write.parquet(f"{folder}/in")
    running = stream.write_mosaic(stream.mosaic_stream(stream.read_scores(spark, f"{folder}/in", 2)), f"{folder}/out", f"{folder}/state")
    running.awaitTermination()
    return stream.current(spark, f"{folder}/out")


_MOSAIC = nn.unet(filters=2, layers=2)
_MOSAIC_LAYERS, _MOSAIC_LAST = network_sql(_MOSAIC, 32, "a0")


def _tile_model(patch, predict):
    """A model for the prediction plan: tiles as arrays, `predict` over them, cells again."""

    def model(scaled):
        tile = scaled.groupBy("row_off", "col_off").agg(F.array_sort(F.collect_list(F.struct((F.col("r") * patch + F.col("c")).alias("k"), F.col("value").alias("v")))).alias("cells"))
        rows = tile.select((F.col("row_off").cast("long") * (1 << 31) + F.col("col_off")).alias("tile_id"), F.transform("cells", lambda x: x["v"]).alias("data"))
        out = predict(rows).select("tile_id", F.posexplode("data").alias("k", "value"))
        return out.select(F.shiftright("tile_id", 31).cast("int").alias("row_off"), (F.col("tile_id") % (1 << 31)).cast("int").alias("col_off"), F.floor(F.col("k") / patch).cast("int").alias("r"), (F.col("k") % patch).cast("int").alias("c"), "value")

    return model


@query(f"""WITH {DTM_SQL}, {TILES_SQL}, {TILE_PIXELS_SQL}, {PADDED_SQL}, {NORM_SQL}, a0 AS MATERIALIZED (SELECT row_off * 1000000 + col_off AS t, r AS y, c AS x, 0 AS c, value AS v FROM norm), {_MOSAIC_LAYERS}
SELECT CAST(t // 1000000 + y AS INT) AS "row", CAST(t % 1000000 + x AS INT) AS col, CAST(greatest(max(CASE WHEN trunc(v * 100) > 10 THEN trunc(v * 100) ELSE 0 END), 0) AS SMALLINT) AS pred
FROM {_MOSAIC_LAST}, dims WHERE t // 1000000 + y < h AND t % 1000000 + x < w GROUP BY 1, 2""")
def model_mosaic(spark, sf_dir):
    """The prediction plan over the terrain with a network as its model, tile by tile."""
    grid, patch = grids.terrain_grid(spark, sf_dir), 32
    model = _tile_model(patch, lambda rows: nn.predict_tiles(rows, _MOSAIC, _MOSAIC.rule_weights(), patch, precision="double"))
    return predict_plan(spark, grids.terrain(spark, sf_dir), grid, patch, 8, model)


@query("""WITH cells AS (SELECT CAST(floor(o_orderkey / 128) AS INT) AS "row", CAST(o_orderkey % 128 AS INT) AS col FROM orders), dims AS (SELECT CAST(max(floor(o_orderkey / 128)) AS INT) + 1 AS h FROM orders),
scored AS (SELECT r AS "row", c AS col, CAST(trunc(CAST((r * 7 + c) % 101 / 100.0E0 AS FLOAT) * CAST(100 AS FLOAT)) AS SMALLINT) AS s FROM (SELECT unnest(range(0, CAST((SELECT h FROM dims) AS BIGINT))) AS r), (SELECT unnest(range(128)) AS c))
SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(CASE WHEN s > 10 THEN s ELSE 0 END AS SMALLINT) AS pred FROM scored""")
def single_precision_scores(spark, sf_dir):
    """The prediction plan with a model that gives hundredths in single precision: 0.11 must score 11."""
    grid, patch = grids.terrain_grid(spark, sf_dir), 32

    def model(scaled):
        place = (F.col("row_off") + F.col("r")) * 7 + F.col("col_off") + F.col("c")
        return scaled.withColumn("value", (place % 101 / 100.0).cast("float"))

    return predict_plan(spark, grids.terrain(spark, sf_dir), grid, patch, 8, model)


@query(f"""WITH {DTM_SQL}, {TILES_SQL}, {TILE_PIXELS_SQL}, {PADDED_SQL}, {NORM_SQL} SELECT CAST(row_off + r AS INT) AS "row", CAST(col_off + c AS INT) AS col,
  CAST(greatest(max(CASE WHEN trunc(value * 100.0E0) > 10 THEN trunc(value * 100.0E0) ELSE 0 END), 0) AS SMALLINT) AS pred
FROM norm, dims WHERE row_off + r < h AND col_off + c < w GROUP BY 1, 2""")
def prediction_files(spark, sf_dir):
    """The mosaic written as byte TIFF files of 64 x 64 cells, LZW-packed with nodata 0, and read back.

    Every file has its own origin, by which it is put in its place, and the source's coordinate system.
    """
    grid = grids.terrain_grid(spark, sf_dir)
    mosaic = predict_plan(spark, grids.terrain(spark, sf_dir), grid, 32, 8)
    tiff.save(tiff.to_files(tiff.square_tiles(mosaic, "pred", grid, 64, "map_pred"), "u1", nodata=0), folder := _shared(spark))
    found = tiff.files(spark, folder)
    t = grid.transform
    heads = tiff.headers(found).where((F.col("crs") == grid.crs) & (F.col("nodata") == 0)).select("path", F.round((F.col("f") - t.f) / t.e).cast("int").alias("top"), F.round((F.col("c") - t.c) / t.a).cast("int").alias("left"))
    cell = tiff.blocks(found, block=64).select("path", "row_off", "col_off", "width", F.posexplode("data").alias("i", "v")).join(heads, "path")
    row, col = F.col("top") + F.col("row_off") + F.floor(F.col("i") / F.col("width")).cast("int"), F.col("left") + F.col("col_off") + F.col("i") % F.col("width")
    return cell.select(row.alias("row"), col.cast("int").alias("col"), F.col("v").cast("smallint").alias("pred"))


def _rasters(spark, sf_dir):
    grid = grids.terrain_grid(spark, sf_dir)
    return grid, Grid("mask", grid.width, grid.height, grid.transform.shifted(2, 4))


def _pairs(spark, sf_dir):
    grid, label = _rasters(spark, sf_dir)
    return grid, label, training.patch_pairs(grids.terrain(spark, sf_dir), grid, grids.mask(spark, sf_dir), label, grids.points(spark, sf_dir, grid), 16)


_PAIRS_SQL = f"""WITH {DTM_SQL}, {MASK_SQL}, {POINTS_SQL}, both_ AS (SELECT d."row" - 2 AS "row", d.col - 4 AS col, d.value AS first, m.value AS second FROM dtm d JOIN mask m ON m."row" = d."row" - 2 AND m.col = d.col - 4),
located AS (SELECT point_id, CAST(floor((x - 4.0E0 - 500002) / 0.5E0) AS INT) AS x0, CAST(floor((y + 4.0E0 - 6199999) / -0.5E0) AS INT) AS y0, CAST(floor((x + 4.0E0 - 500002) / 0.5E0) AS INT) AS x1, CAST(floor((y - 4.0E0 - 6199999) / -0.5E0) AS INT) AS y1
  FROM points, dims WHERE x BETWEEN 500002 AND 500000 + 0.5E0 * w AND y BETWEEN 6200000 - 0.5E0 * h AND 6199999),
numbered AS (SELECT row_number() OVER (ORDER BY point_id) - 1 AS patch_id, * FROM located, dims WHERE x0 >= 0 AND x1 <= w - 4 AND y0 >= 0 AND y1 <= h - 2),
pairs AS (SELECT patch_id, CAST("row" - y0 AS INT) AS r, CAST(col - x0 AS INT) AS c, first, second FROM numbered JOIN both_ ON "row" >= y0 AND "row" < y1 AND col >= x0 AND col < x1)"""


@query(f"""{_PAIRS_SQL} SELECT patch_id || kind AS name, 16 AS width, 16 AS height, CASE WHEN kind = '_pair.tif' THEN 2 ELSE 1 END AS band_count, 'float32' AS dtype, 'EPSG:32633' AS crs,
  500002 + 0.5E0 * x0 AS c, 6199999 - 0.5E0 * y0 AS f FROM numbered, (SELECT unnest(['_img.tif', '_lab.tif', '_pair.tif']) AS kind) WHERE patch_id IN (SELECT patch_id FROM pairs)""")
def patch_files(spark, sf_dir):
    """All patches written as image, label and two-band files, packed in archives, and their headers read back."""
    image, label = _rasters(spark, sf_dir)
    tiles = training.cut_tiles(grids.terrain(spark, sf_dir), image, grids.mask(spark, sf_dir), label, grids.points(spark, sf_dir, image), 16)
    tiff.save(tiff.to_files(tiles), folder := _shared(spark), packed=True)
    found = read_headers(file_sink.saved(spark, folder))
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "width", "height", "band_count", "dtype", "crs", "c", "f")


@query(f"{_PAIRS_SQL} SELECT * REPLACE (CASE WHEN isnan(first) THEN NULL ELSE first END AS first) FROM pairs")
def patch_pairs(spark, sf_dir):
    """Image and label patches where the label raster starts two rows and four columns into the image."""
    _, _, pairs = _pairs(spark, sf_dir)
    return pairs.withColumn("first", F.when(~F.isnan("first"), F.col("first")))


@query(f"""{_PAIRS_SQL}, usable AS (SELECT patch_id FROM pairs GROUP BY 1 HAVING count_if(second > 30) >= 200 AND count(*) = 256),
placed AS (SELECT patch_id, row_number() OVER (ORDER BY md5('42-0-' || patch_id)) - 1 AS p, count(*) OVER () AS n FROM usable)
SELECT CAST(k // 8 AS INT) AS batch_id, CAST(k % 8 AS INT) AS slot, patch_id FROM placed, (SELECT unnest(range(0, CAST((SELECT (count(*) + 7) // 8 * 8 FROM usable) AS BIGINT))) AS k) WHERE p = k % n""")
def training_batches(spark, sf_dir):
    _, _, pairs = _pairs(spark, sf_dir)
    return training.training_batches(pairs, 16, 8, 200)


@query(f"""{_J}, turns AS (SELECT image_id, d, CAST('0x' || substr(md5('42-' || d || '-' || image_id), 1, 1) AS INT) < 8 AS flip, CAST('0x' || substr(md5('42-' || d || '-' || image_id), 2, 1) AS INT) % 4 AS k
  FROM (SELECT DISTINCT image_id FROM judged), (SELECT unnest([0, 1]) AS d)),
flipped AS (SELECT image_id, d, k, "row" AS r, CASE WHEN flip THEN 7 - col ELSE col END AS c, y, p FROM judged JOIN turns USING (image_id))
SELECT image_id, d AS draw, CAST(CASE k WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS INT) AS "row", CAST(CASE k WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS INT) AS col, y, round(p, 9) AS p FROM flipped""")
def augmented_pairs(spark, sf_dir):
    """Two draws of every image with its mask; both halves of a pair get the same turn."""
    judged = _judged(spark, sf_dir)
    draws = [judged.withColumn("draw", F.lit(d)).select("image_id", "draw", *[c.alias(n) for c, n in zip(dataset.turned(F.col("row"), F.col("col"), 8, 8, *dataset.drawn_turn(F.col("image_id"), d)), ("row", "col"), strict=True)], "y", F.round("p", 9).alias("p")) for d in (0, 1)]
    return draws[0].union(draws[1])
