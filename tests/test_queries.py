"""Every registered grid query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rasterloom.plans import catalog_queries, grid_queries, image_queries, model_queries, registry, support_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, tables, name):
    ours = ordered(registry.QUERIES[name](spark, SF).toPandas())
    theirs = ordered(tables.execute(registry.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        same = (a == b) | (a.isna() & b.isna())
        assert same.all(), column


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_unpadded_forward_scores_every_cell(spark):
    from rasterloom.sources import grids

    grid = grids.terrain_grid(spark, SF)
    rows = registry.QUERIES["unpadded_forward"](spark, SF).collect()
    places = [(r.tile_id // 1_000_000 + r.k // 8, r.tile_id % 1_000_000 + r.k % 8) for r in rows]
    assert sorted(places) == [(i, j) for i in range(grid.height) for j in range(grid.width)]
    assert all(0 <= r.p <= 1 for r in rows)


def test_vnet_forward_scores_every_chip(spark):
    chips = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    rows = registry.QUERIES["vnet_forward"](spark, SF).collect()
    assert sorted((r.tile_id * 8 + r.k // 64, r.k % 64) for r in rows) == sorted((i, k) for i in chips for k in range(64))
