"""Images as arrays: resizing, padding, reassembly and affine sampling against plain loops, odd images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import arrays, dataset, tiling

rng = np.random.default_rng(7)


def frame(spark, images):
    rows = [(k, r, c, float(v)) for k, x in images.items() for (r, c), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "image_id long, row int, col int, value double").repartition(3)


def gathered(df, shape):
    found = {}
    for r in df.collect():
        found.setdefault(r.image_id, np.full(shape, np.nan))[r.row, r.col] = r.value
    return found


@pytest.fixture(scope="module")
def images():
    return {k: rng.random((6, 9)) for k in range(5)}


@pytest.mark.parametrize("size", [4, 9, 13])
def test_resize_against_a_plain_loop(spark, images, size):
    found = gathered(tiling.resize_bilinear(frame(spark, images), 6, 9, size), (size, size))
    assert set(found) == set(images)
    for k, x in images.items():
        for i in range(size):
            for j in range(size):
                y, z = (i + 0.5) * 6 / size - 0.5, (j + 0.5) * 9 / size - 0.5
                a, b = math.floor(y), math.floor(z)
                at = lambda r, c, x=x: x[min(max(r, 0), 5), min(max(c, 0), 8)]
                u, v = y - a, z - b
                want = (1 - u) * ((1 - v) * at(a, b) + v * at(a, b + 1)) + u * ((1 - v) * at(a + 1, b) + v * at(a + 1, b + 1))
                assert abs(found[k][i, j] - want) < 1e-12
    same = gathered(tiling.resize_bilinear(frame(spark, {0: np.eye(4)}), 4, 4, 4), (4, 4))[0]
    assert (same == np.eye(4)).all()


def test_missing_pixels_and_empty_tables(spark, images):
    df = frame(spark, images).where("image_id <> 3 OR row > 2")
    padded = gathered(tiling.centre_pad(df, 6, 9, 12), (12, 11))
    for k, x in images.items():
        want = np.pad(np.where(np.arange(6)[:, None] > 2, x, 0) if k == 3 else x, ((3, 3), (1, 1)))
        assert (padded[k] == want).all()
    assert tiling.resize_bilinear(df.limit(0), 6, 9, 4).count() == tiling.centre_pad(df.limit(0), 6, 9, 12).count() == 0


def placed(x, row, col, mode, fill):
    h, w = x.shape
    if mode == "constant":
        return x[row, col] if 0 <= row < h and 0 <= col < w else fill
    if mode == "nearest":
        return x[min(max(row, 0), h - 1), min(max(col, 0), w - 1)]
    if mode == "wrap":
        return x[row % h, col % w]
    whole = np.pad(x, 40, mode="symmetric")
    return whole[row + 40, col + 40]


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("mode", ["constant", "nearest", "reflect", "wrap"])
def test_affine_against_a_plain_loop(spark, images, order, mode):
    degrees, shear, shift, flip, fill = 31.0, 8.0, 0.3, True, -2.0
    found = gathered(dataset.affine_sampled(frame(spark, images), 6, 9, degrees, shear, shift, flip, fill, order, mode), (6, 9))
    a, s = math.radians(degrees), math.radians(shear)
    for k, x in images.items():
        for r in range(6):
            for c in range(9):
                y, z = r - 2.5 - shift * 6, (8 - c) - 4.0
                sy = math.cos(a) * y + math.sin(a) * z + 2.5
                sx = (-math.sin(a) + math.tan(s) * math.cos(a)) * y + (math.cos(a) + math.tan(s) * math.sin(a)) * z + 4.0
                if order == 0:
                    want = placed(x, math.floor(sy + 0.5), math.floor(sx + 0.5), mode, fill)
                elif mode == "constant" and not (0 <= sy <= 5 and 0 <= sx <= 8):
                    want = fill
                else:
                    i, j = math.floor(sy), math.floor(sx)
                    edge = "nearest" if mode == "constant" else mode
                    want = sum(wy * wx * placed(x, i + di, j + dj, edge, fill) for di, wy in ((0, 1 - sy + i), (1, sy - i)) for dj, wx in ((0, 1 - sx + j), (1, sx - j)))
                assert abs(found[k][r, c] - want) < 1e-9


def test_affine_amounts_of_their_own(spark, images):
    flip = F.col("image_id") % 2 == 0
    found = gathered(dataset.affine_sampled(frame(spark, images), 6, 9, 0.0, 0.0, 0.0, flip), (6, 9))
    assert all((found[k] == (x[:, ::-1] if k % 2 == 0 else x)).all() for k, x in images.items())
    nothing = gathered(dataset.affine_sampled(frame(spark, images), 6, 9, F.lit(None).cast("double"), 0.0, 0.0, False, 5.0), (6, 9))
    assert all((x == 5).all() for x in nothing.values())
    with pytest.raises(ValueError):
        dataset.affine_sampled(frame(spark, images), 6, 9, 0.0, 0.0, 0.0, False, mode="other")


def test_weights_of_an_axis_sum_to_one():
    for extent, size in ((8, 12), (7, 3), (1, 5), (5, 5)):
        assert np.allclose(arrays.taps(extent, size).sum(axis=1), 1) and arrays.taps(extent, size).shape == (size, extent)
    assert (arrays.taps(5, 5) == np.eye(5)).all()
