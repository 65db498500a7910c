"""Queries for what surrounds the rasters: systems, attributes, sidecars, weights, guards and training callbacks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions import georef, naming, radiometry
from rasterloom.functions.georef import Grid
from rasterloom.operators import dataset, nn, stats, tiling
from rasterloom.plans.registry import query
from rasterloom.sources import geopackage, grids, tiff, vector
from rasterloom.sources.grids import DTM_SQL, POINTS_SQL
from rasterloom.sources.scratch import work_folder


def _series(terms: tuple[float, ...], outer: str, inner: str, x: str, y: str) -> str:
    return " + ".join(f"{c!r}E0 * {outer}({2 * j} * {x}) * {inner}({2 * j} * {y})" if "e" not in repr(c) else f"{c!r} * {outer}({2 * j} * {x}) * {inner}({2 * j} * {y})" for j, c in enumerate(terms, 1))


_E = georef.ECCENTRICITY


#: The points in degrees and, not rounded, in UTM zone 32, as the last of some tables to be put before a query.
ZONE32_SQL = f"""plane AS (SELECT point_id, x, y, y / {georef.UTM_SCALE!r}E0 AS xi, (x - 500000) / {georef.UTM_SCALE!r}E0 AS eta FROM points),
ball AS (SELECT *, xi - ({_series(georef.FROM_PLANE, "sin", "cosh", "xi", "eta")}) AS u, eta - ({_series(georef.FROM_PLANE, "cos", "sinh", "xi", "eta")}) AS v FROM plane),
conformal AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM ball),
degrees_ AS (SELECT point_id, 15 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees(chi + {" + ".join(f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(georef.TO_LATITUDE, 1))}) AS lat FROM conformal),
turned AS (SELECT *, sin(radians(lat)) AS s, radians(lon - 9) AS l FROM degrees_),
tangent AS (SELECT *, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) AS t FROM turned),
sphere32 AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM tangent),
zone32 AS (SELECT point_id, lon, lat, 500000 + {georef.UTM_SCALE!r} * (eta + {_series(georef.TO_PLANE, "cos", "sinh", "xi", "eta")}) AS x32,
  {georef.UTM_SCALE!r} * (xi + {_series(georef.TO_PLANE, "sin", "cosh", "xi", "eta")}) AS y32 FROM sphere32)""".replace("E0E0", "E0")


@query(f"""WITH {DTM_SQL}, {POINTS_SQL}, {ZONE32_SQL}
SELECT point_id, round(lon, 9) AS lon, round(lat, 9) AS lat, round(x32, 3) AS x32, round(y32, 3) AS y32, round(radians(lon) * 6378137, 3) AS x_web, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y_web FROM zone32""")
def reprojected_points(spark, sf_dir):
    """The survey points, given in UTM zone 33, in degrees, in zone 32 and in spherical Mercator."""
    points = grids.points(spark, sf_dir, grids.terrain_grid(spark, sf_dir))
    to = lambda crs: georef.reproject(F.col("x"), F.col("y"), "EPSG:32633", crs)
    (lon, lat), (x32, y32), (xw, yw) = to("EPSG:4326"), to("EPSG:32632"), to("EPSG:3857")
    return points.select("point_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(x32, 3).alias("x32"), F.round(y32, 3).alias("y32"), F.round(xw, 3).alias("x_web"), F.round(yw, 3).alias("y_web"))


@query("SELECT 'points_' || c_nationkey || '.shp' AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS point_id, CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment, 'EPSG:' || (32601 + c_nationkey) AS crs FROM customer")
def shapefile_attributes(spark, sf_dir):
    """Attributes of all customers as a table file for each nation, with a text that names the system, and both read back."""
    import pandas as pd

    def encode(pdf):
        ordered = pdf.sort_values("c_custkey")
        nation = int(pdf["c_nationkey"].iloc[0])
        rows = [{"custkey": str(k), "segment": s} for k, s in zip(ordered["c_custkey"], ordered["c_mktsegment"], strict=True)]
        text = f'PROJCS["WGS_1984_UTM_Zone_{nation + 1}N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]],PROJECTION["Transverse_Mercator"]]'
        return pd.DataFrame({"name": [f"points_{nation}.dbf", f"points_{nation}.prj"], "content": [vector.encode_attributes(rows), text.encode()]})

    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment").groupBy("c_nationkey").applyInPandas(lambda pdf: encode(pdf), "name string, content binary")
    tiff.save(named, folder := work_folder(spark, "grids"))
    found = vector.read_attributes(spark, folder).join(vector.read_crs(spark, folder), "path")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "point_id", F.col("attributes")["custkey"].alias("custkey"), F.col("attributes")["segment"].alias("segment"), "crs")


@query("SELECT CAST(c_custkey AS BIGINT) AS custkey, CAST(c_custkey AS DOUBLE) / 4 AS x, c_acctbal AS y, c_mktsegment AS segment FROM customer")
def geojson_points(spark, sf_dir):
    """All customers as GeoJSON points, one collection a nation, written and read back."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col("c_custkey") / 4.0, F.col("c_acctbal").cast("double")).alias("coordinates")).alias("geometry"),
        F.struct(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")).alias("properties"),
    )
    whole = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).cast("binary").alias("content"))
    tiff.save(whole.select(F.format_string("points_%d.geojson", "c_nationkey").alias("name"), "content"), folder := work_folder(spark, "grids"))
    found = vector.read_geojson(spark, folder).withColumn("p", F.from_json("properties", "custkey long, segment string"))
    return found.select("p.custkey", "x", "y", "p.segment")


@query("SELECT 'points_' || c_nationkey || '.gpkg' AS name, 'survey' AS layer, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS point_id, CAST(c_custkey AS DOUBLE) / 4 AS x, c_acctbal AS y, 'EPSG:' || (32601 + c_nationkey) AS crs, CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment FROM customer")
def geopackage_points(spark, sf_dir):
    """All customers as points with attributes, one GeoPackage a nation, written and read back."""
    import pandas as pd

    def encode(pdf):
        ordered, nation = pdf.sort_values("c_custkey"), int(pdf["c_nationkey"].iloc[0])
        rows = [{"custkey": str(k), "segment": s} for k, s in zip(ordered["c_custkey"], ordered["c_mktsegment"], strict=True)]
        content = geopackage.encode("survey", list(zip(ordered["c_custkey"] / 4, ordered["c_acctbal"].astype(float), strict=True)), rows, 32601 + nation)
        return pd.DataFrame({"name": [f"points_{nation}.gpkg"], "content": [content]})

    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").groupBy("c_nationkey").applyInPandas(lambda pdf: encode(pdf), "name string, content binary")
    tiff.save(named, folder := work_folder(spark, "grids"))
    found = geopackage.read_geopackage(spark, folder)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "layer", "point_id", "x", "y", "crs", F.col("attributes")["custkey"].alias("custkey"), F.col("attributes")["segment"].alias("segment"))


@query("SELECT 'points_' || c_nationkey || '.shp' AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS point_id, CAST(c_custkey AS DOUBLE) / 4 AS x, c_acctbal AS y FROM customer")
def shapefile_parts(spark, sf_dir):
    """All customers as a shapefile with an index for each nation, read back in parts of 64 records."""
    import pandas as pd

    def encode(pdf):
        ordered, nation = pdf.sort_values("c_custkey"), int(pdf["c_nationkey"].iloc[0])
        points = list(zip(ordered["c_custkey"] / 4, ordered["c_acctbal"].astype(float), strict=True))
        return pd.DataFrame({"name": [f"points_{nation}.shp", f"points_{nation}.shx"], "content": [vector.encode_points(points), geopackage.encode_index(points)]})

    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(lambda pdf: encode(pdf), "name string, content binary")
    tiff.save(named, folder := work_folder(spark, "grids"))
    return geopackage.read_shapes(spark, folder, records=64).withColumn("name", F.substring_index("path", "/", -1)).drop("path")


_BUCKETS, _LOW, _HIGH = 20, -250.0, 250.0


def _sidecar(spark, sf_dir) -> str:
    pixels = grids.terrain(spark, sf_dir)
    s = stats.band_stats(pixels).first()
    counts = [r["count"] for r in stats.histogram(pixels, _LOW, _HIGH, _BUCKETS).orderBy("bucket").collect()]
    names = {"MINIMUM": s.minimum, "MAXIMUM": s.maximum, "MEAN": s.mean, "STDDEV": s.stddev, "VALID_PERCENT": s.valid_percent}
    named = spark.createDataFrame([("dtm.tif.aux.xml", vector.sidecar_xml(names, _LOW, _HIGH, counts))], "name string, content binary")
    tiff.save(named, folder := work_folder(spark, "grids"))
    return folder


@query(f"""WITH {DTM_SQL}, valid AS (SELECT value FROM dtm WHERE NOT isnan(value)), s AS (SELECT min(value) AS a, max(value) AS b, avg(value) AS c, stddev_pop(value) AS d, count(*) * 100.0E0 / (SELECT count(*) FROM dtm) AS e FROM valid)
SELECT 1 AS band, 'STATISTICS_' || unnest(['MINIMUM', 'MAXIMUM', 'MEAN', 'STDDEV', 'VALID_PERCENT']) AS key, round(unnest([a, b, c, d, e]), 6) AS value FROM s""")
def sidecar_statistics(spark, sf_dir):
    """The terrain's statistics written as a sidecar and read back."""
    return vector.sidecar_stats(spark, _sidecar(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""WITH {DTM_SQL}, bars AS (SELECT CAST(floor((value + 250) / 25) AS INT) + 1 AS bucket, count(*) AS n FROM dtm WHERE NOT isnan(value) AND value >= -250 AND value < 250 GROUP BY 1)
SELECT 1 AS band, -250.0E0 AS low, 250.0E0 AS high, CAST(k AS INT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (SELECT unnest(range(1, 21)) AS k) LEFT JOIN bars ON bucket = k""")
def sidecar_histogram(spark, sf_dir):
    return vector.sidecar_histogram(spark, _sidecar(spark, sf_dir))


_SAVED = nn.unet(filters=2, layers=1)


def _weights_sql() -> str:
    parts = []
    for s, step in enumerate(_SAVED.steps):
        for name, shape in step.shapes.items():
            rule = {
                "kernel": f"((i * 7919 + {s * 104729 + 12345}) % 10007 / 5003.5E0 - 1) * {math.sqrt(6 / math.prod(shape[:-1]))!r}E0", "bias": f"(i * 17 + {s * 31}) % 7 / 50.0E0 - 0.06E0",
                "gamma": f"1 + (i + {s}) % 3 / 10.0E0", "beta": f"(i + {s}) % 5 / 20.0E0 - 0.1E0", "mean": f"(i * 3 + {s}) % 4 / 10.0E0", "variance": f"1 + (i + {s}) % 2 / 2.0E0",
            }[name]
            parts.append(f"SELECT {s} AS step, '{name}' AS name, CAST(i AS INT) AS place, round(CAST(CAST({rule} AS FLOAT) AS DOUBLE), 6) AS value FROM (SELECT unnest(range({math.prod(shape)})) AS i)")
    return " UNION ALL ".join(parts)


@query(_weights_sql())
def saved_weights(spark, sf_dir):
    """A network's weights written as a table and loaded again; loading checks that they belong to the network."""
    nn.save_weights(spark, _SAVED.rule_weights(), folder := work_folder(spark, "weights"))
    loaded = nn.load_weights(spark, _SAVED, folder)
    rows = [(s, name, i, round(float(v), 6)) for s, own in enumerate(loaded) for name, w in own.items() for i, v in enumerate(w.ravel())]
    return spark.createDataFrame(rows, "step int, name string, place int, value double")


def _refused(action) -> bool:
    try:
        action()
    except (ValueError, FileNotFoundError):
        return True
    return False


_GUARDS = ("missing model", "model of another network", "overlap of a whole patch", "size no multiple of the stride", "unknown upsampling", "unknown dropout", "unknown colour", "unknown constant rule", "unknown system", "two systems", "no common area", "no survivors", "not a TIFF file")


@query(f"SELECT unnest([{', '.join(repr(g) for g in _GUARDS)}]) AS guard, true AS refused")
def guards(spark, sf_dir):
    """What the operators refuse."""
    t = grids.TRANSFORM
    nn.save_weights(spark, _SAVED.rule_weights(), folder := work_folder(spark, "weights"))
    far = Grid("far", 4, 4, georef.Affine(0.5, 0, 0, 0, -0.5, 0))
    actions = (
        lambda: nn.load_weights(spark, _SAVED, work_folder(spark, "none")), lambda: nn.load_weights(spark, nn.unet(filters=3, layers=1), folder),
        lambda: tiling.stride_of(8, 8), lambda: tiling.sliding_patches(grids.chips(spark, sf_dir), 8, 8, 4, 3),
        lambda: nn.unet(upsample="other"), lambda: nn.unet(dropout_type="other"), lambda: naming.rgba(F.lit(1), "other"), lambda: radiometry.min_max(F.lit(1.0), F.lit(0.0), F.lit(1.0), "other"),
        lambda: georef.reproject(F.lit(1.0), F.lit(1.0), "EPSG:4326", "EPSG:9999"), lambda: georef.intersect(Grid("a", 4, 4, t), Grid("b", 4, 4, t, "EPSG:4326")), lambda: georef.intersect(Grid("a", 4, 4, t), far),
        lambda: dataset.refilled(spark.range(0), "id", 4, 2), lambda: tiff.Tiff(b"none of that"),
    )
    return spark.createDataFrame([(name, _refused(action)) for name, action in zip(_GUARDS, actions, strict=True)], "guard string, refused boolean")


@query("""WITH RECURSIVE h AS (SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS epoch, loss FROM (SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS loss FROM events GROUP BY 1)),
s AS (SELECT epoch, loss, loss AS best, 0 AS since, 0 AS since_cut, 0.001E0 AS rate, true AS is_best FROM h WHERE epoch = 0 UNION ALL
  SELECT h.epoch, h.loss, least(s.best, h.loss), CASE WHEN h.loss < s.best THEN 0 ELSE s.since + 1 END, CASE WHEN h.loss < s.best OR s.since_cut + 1 >= 2 THEN 0 ELSE s.since_cut + 1 END,
    CASE WHEN h.loss >= s.best AND s.since_cut + 1 >= 2 THEN s.rate * 0.5E0 ELSE s.rate END, h.loss < s.best FROM s JOIN h ON h.epoch = s.epoch + 1)
SELECT epoch, loss, is_best, rate, since >= 4 AND NOT coalesce(bool_or(since >= 4) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stops FROM s""")
def callbacks(spark, sf_dir):
    """Losses by day as a history: which epoch's weights are kept, the learning rate after it, and where training stops."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = e.groupBy(F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 6).alias("loss")).orderBy("d").collect()  # a row an epoch
    losses = [r.loss for r in days]
    stop = nn.early_stop(losses, 4)
    rows = [(k, x, nn.is_best(losses[: k + 1]), nn.reduced_rate(losses[: k + 1], 0.001, patience=2), k == stop) for k, x in enumerate(losses)]
    return spark.createDataFrame(rows, "epoch int, loss double, is_best boolean, rate double, stops boolean")
