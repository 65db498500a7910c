"""Convolutional models over tiles: networks as graphs of NumPy layers, run by batched pandas functions.

A network is a list of steps; each step names an operation, the steps it reads and its parameters' shapes.  Weights are
drawn from a seed (He initialisation) or given.  Arrays are (batch, space..., channels), in two or three dimensions.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.functions.georef import Grid


@dataclass
class Step:
    op: str
    reads: tuple[int, ...]
    options: dict = field(default_factory=dict)
    shapes: dict[str, tuple[int, ...]] = field(default_factory=dict)


class Network:
    """Builds a graph; every method adds a step and returns its number.  Step 0 is the input."""

    def __init__(self, channels: int, space: int = 2):
        self.space, self.steps, self.channels = space, [Step("input", ())], [channels]
        #: Steps whose outputs are dropped in training, with the rate and whether whole channels go.
        self.drops: dict[int, tuple[float, bool]] = {}

    def _add(self, op: str, reads: tuple[int, ...], channels: int, shapes: dict | None = None, **options) -> int:
        self.steps.append(Step(op, reads, options, shapes or {}))
        self.channels.append(channels)
        return len(self.steps) - 1

    def conv(self, x: int, filters: int, size: int = 3, activation: str | None = None, padding: str = "same", bias: bool = True) -> int:
        shapes = {"kernel": (size,) * self.space + (self.channels[x], filters)} | ({"bias": (filters,)} if bias else {})
        return self._add("conv", (x,), filters, shapes, activation=activation, padding=padding)

    def norm(self, x: int) -> int:
        c = self.channels[x]
        return self._add("norm", (x,), c, {"gamma": (c,), "beta": (c,), "mean": (c,), "variance": (c,)})

    def pool(self, x: int) -> int:
        return self._add("pool", (x,), self.channels[x])

    def deconv(self, x: int, filters: int, size: int = 2, activation: str | None = None) -> int:
        return self._add("deconv", (x,), filters, {"kernel": (size,) * self.space + (self.channels[x], filters), "bias": (filters,)}, activation=activation)

    def repeat(self, x: int) -> int:
        return self._add("repeat", (x,), self.channels[x])

    def concat(self, *xs: int) -> int:
        return self._add("concat", xs, sum(self.channels[x] for x in xs))

    def crop_like(self, x: int, like: int) -> int:
        return self._add("crop", (x, like), self.channels[x])

    def gate(self, skip: int, below: int, filters: int) -> int:
        """Attention: the skip connection times a sigmoid map made from both inputs."""
        a, b = self.conv(skip, filters, 1), self.conv(below, filters, 1)
        both = self._add("add_relu", (a, b), filters)
        return self._add("times", (skip, self.conv(both, 1, 1, "sigmoid")), self.channels[skip])

    def block(self, x: int, filters: int, normed: bool = True, activation: str = "relu", padding: str = "same", dropout: float = 0.0, spatial: bool = True) -> int:
        """Two convolutions, each followed by normalisation if normed (a normed convolution has no bias), dropout between."""
        for first in (True, False):
            x = self.conv(x, filters, 3, activation, padding, bias=not normed)
            x = self.norm(x) if normed else x
            if first and dropout > 0:
                self.drops[x] = dropout, spatial
        return x

    def n_parameters(self) -> int:
        return sum(math.prod(s) for step in self.steps for s in step.shapes.values())

    def weights(self, seed: int = 0) -> list[dict[str, np.ndarray]]:
        rng, out = np.random.default_rng(seed), []
        for step in self.steps:
            own = {}
            for name, shape in step.shapes.items():
                if name == "kernel":
                    own[name] = (rng.standard_normal(shape) * math.sqrt(2 / math.prod(shape[:-1]))).astype(np.float32)
                else:
                    own[name] = np.full(shape, 1.0 if name in ("gamma", "variance") else 0.0, np.float32)
            out.append(own)
        return out

    def rule_weights(self) -> list[dict[str, np.ndarray]]:
        """Weights in double precision by a rule that any engine can repeat, from a step's number and an entry's place.

        Kernels are spread over [-u, u) with u = sqrt(6 / fan in), by a congruence; the others take a few small values.
        """
        out = []
        for s, step in enumerate(self.steps):
            own = {}
            for name, shape in step.shapes.items():
                i = np.arange(math.prod(shape))
                if name == "kernel":
                    own[name] = ((((i * 7919 + s * 104729 + 12345) % 10007) / 5003.5 - 1.0) * math.sqrt(6 / math.prod(shape[:-1]))).reshape(shape)
                else:
                    own[name] = {"bias": (i * 17 + s * 31) % 7 / 50 - 0.06, "gamma": 1 + (i + s) % 3 / 10, "beta": (i + s) % 5 / 20 - 0.1, "mean": (i * 3 + s) % 4 / 10, "variance": 1 + (i + s) % 2 / 2}[name]
            out.append(own)
        return out

    def forward(self, x: np.ndarray, weights: list[dict[str, np.ndarray]], dtype=np.float32) -> np.ndarray:
        last = {r: i for i, step in enumerate(self.steps) for r in step.reads}
        values: dict[int, np.ndarray] = {0: x.astype(dtype)}
        for i, (step, own) in enumerate(zip(self.steps, weights, strict=True)):
            if i:
                values[i] = _OPS[step.op](*[values[r] for r in step.reads], **step.options, **own)
            for r in step.reads:
                if last[r] == i:
                    values.pop(r, None)
        return values[len(self.steps) - 1]


def _activate(x: np.ndarray, kind: str | None) -> np.ndarray:
    if kind == "relu":
        return np.maximum(x, 0)
    if kind == "sigmoid":
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    if kind == "softmax":
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)
    return x


def _space(x: np.ndarray) -> tuple[int, ...]:
    return x.shape[1:-1]


def _padded(x: np.ndarray, margins: list[tuple[int, int]]) -> np.ndarray:
    """x with zeros around it along the axes of space; np.pad takes longer than a layer on small tiles does."""
    if not any(map(any, margins)):
        return x
    out = np.zeros((x.shape[0], *[n + low + high for n, (low, high) in zip(_space(x), margins, strict=True)], x.shape[-1]), x.dtype)
    out[(slice(None), *[slice(low, low + n) for n, (low, _) in zip(_space(x), margins, strict=True)])] = x
    return out


def _conv(x, kernel, bias=None, activation=None, padding="same"):
    size = kernel.shape[:-2]
    if padding == "same":
        x = _padded(x, [((k - 1) // 2, k // 2) for k in size])
    out_space = [n - k + 1 for n, k in zip(_space(x), size, strict=True)]
    out = np.zeros((x.shape[0], *out_space, kernel.shape[-1]), x.dtype)
    for at in itertools.product(*map(range, size)):
        part = x[(slice(None), *[slice(a, a + n) for a, n in zip(at, out_space, strict=True)])]
        out += part @ kernel[at]
    return _activate(out + bias if bias is not None else out, activation)


def _deconv(x, kernel, bias, activation=None):
    """Stride two; the output has twice the input's extent, what reaches past it is cut off at the end."""
    size = kernel.shape[:-2]
    out = np.zeros((x.shape[0], *[2 * n + k for n, k in zip(_space(x), size, strict=True)], kernel.shape[-1]), x.dtype)
    for at in itertools.product(*map(range, size)):
        out[(slice(None), *[slice(a, a + 2 * n, 2) for a, n in zip(at, _space(x), strict=True)])] += x @ kernel[at]
    return _activate(out[(slice(None), *[slice(0, 2 * n) for n in _space(x)])] + bias, activation)


def _pool(x):
    for axis, n in enumerate(_space(x), 1):
        x = np.take(x, range(n // 2 * 2), axis)
        x = x.reshape(*x.shape[:axis], n // 2, 2, *x.shape[axis + 1 :]).max(axis + 1)
    return x


def _repeat(x):
    for axis in range(1, x.ndim - 1):
        x = x.repeat(2, axis)
    return x


def _crop(x, like):
    gaps = [a - b for a, b in zip(_space(x), _space(like), strict=True)]
    return x[(slice(None), *[slice(g // 2, g // 2 + n) for g, n in zip(gaps, _space(like), strict=True)])]


_OPS = {
    "conv": _conv,
    "deconv": _deconv,
    "norm": lambda x, gamma, beta, mean, variance: (x - mean) / np.sqrt(variance + 1e-3) * gamma + beta,
    "pool": _pool,
    "repeat": _repeat,
    "crop": _crop,
    "concat": lambda *xs: np.concatenate(xs, -1),
    "add_relu": lambda a, b: np.maximum(a + b, 0),
    "times": lambda a, b: a * b,
}


def unet(
    channels: int = 1, classes: int = 1, filters: int = 16, layers: int = 4, attention: bool = True, normed: bool = True, upsample: str = "deconv", head: str = "sigmoid", space: int = 2,
    dropout: float = 0.0, dropout_change: float = 0.0, dropout_type: str = "spatial", dropout_up: bool = False,
) -> Network:
    """The encoder and decoder with skip connections.

    Dropout acts in training alone: inside every block, at a rate that changes by dropout_change from level to level, and
    in the decoder only with dropout_up; `spatial` drops whole channels, `standard` single values.
    """
    if dropout_type not in ("spatial", "standard"):
        raise ValueError("dropout_type must be 'spatial' or 'standard'")
    if upsample not in ("deconv", "simple"):
        raise ValueError("upsample must be 'deconv' or 'simple'")
    if not 0 <= dropout + min(0, layers * dropout_change) <= dropout + max(0, layers * dropout_change) < 1:
        raise ValueError("dropout must stay between 0 and 1 on all levels")
    net, x, skips = Network(channels, space), 0, []
    rate = lambda level: {"dropout": dropout + level * dropout_change, "spatial": dropout_type == "spatial"}
    for level in range(layers):
        x = net.block(x, filters << level, normed, **rate(level))
        skips.append(x)
        x = net.pool(x)
    x = net.block(x, filters << layers, normed, **rate(layers))
    for level in reversed(range(layers)):
        width = filters << level
        x = net.deconv(x, width) if upsample == "deconv" else net.repeat(x)
        skip = net.gate(skips[level], x, net.channels[x]) if attention else skips[level]
        x = net.block(net.concat(x, skip), width, normed, **(rate(level) if dropout_up else {}))
    net.conv(x, classes, 1, head)
    return net


def vnet(channels: int = 1, classes: int = 1, filters: int = 16, layers: int = 4, attention: bool = False, **more) -> Network:
    """unet in three dimensions."""
    return unet(channels, classes, filters, layers, attention, space=3, **more)


def unpadded_unet(channels: int = 1, classes: int = 1, filters: int = 64, layers: int = 4, head: str = "sigmoid") -> Network:
    """Convolutions without padding and cropped skip connections: the output is smaller than the input."""
    net, x, skips = Network(channels), 0, []
    for level in range(layers):
        x = net.block(x, filters << level, normed=False, padding="valid")
        skips.append(x)
        x = net.pool(x)
    x = net.block(x, filters << layers, normed=False, padding="valid")
    for level in reversed(range(layers)):
        x = net.deconv(x, filters << level)
        x = net.block(net.concat(x, net.crop_like(skips[level], x)), filters << level, normed=False, padding="valid")
    net.conv(x, classes, 1, head)
    return net


def satellite_unet(channels: int = 1, classes: int = 1, layers: int = 4, head: str = "sigmoid", filters: int = 64, wide: int = 96) -> Network:
    """Normalisation before each convolution, one width throughout, and an outer skip connection."""
    net = Network(channels)
    step = lambda x, width: net.conv(net.norm(x), width, 3, "relu")
    up = lambda x: net.deconv(net.norm(x), filters, 3, "relu")
    outer = step(net.conv(0, filters, 3, "relu"), filters)
    x, skips = net.pool(step(outer, filters)), []
    for _ in range(layers):
        x = step(step(x, filters), filters)
        skips.append(x)
        x = net.pool(step(x, filters))
    x = up(step(step(x, filters), filters))
    for skip in reversed(skips):
        x = up(step(step(net.concat(x, skip), wide), filters))
    x = step(step(net.concat(x, outer), wide), filters)
    net.conv(x, classes, 1, head)
    return net


def predict_tiles(tiles: DataFrame, net: Network, weights: list[dict[str, np.ndarray]], size: int, at_once: int = 32, precision: str = "float") -> DataFrame:
    """Probabilities of whole tiles: rows (tile_id, data) with data row-major, `size` along every axis of the network.

    Weights are broadcast.  A network without padding returns fewer cells than it got.  Layers compute in `precision`.
    """
    dtype = {"float": np.float32, "double": np.float64}[precision]
    shared = tiles.sparkSession.sparkContext.broadcast((net, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, w = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), at_once):
                part = pdf.iloc[k : k + at_once]
                x = np.stack([np.asarray(d, dtype) for d in part["data"]]).reshape(-1, *(size,) * own.space, 1)
                y = own.forward(x, w, dtype)[..., 0]
                yield pd.DataFrame({"tile_id": part["tile_id"].to_numpy(), "data": list(y.reshape(len(part), -1))})

    return tiles.select("tile_id", "data").mapInPandas(run, f"tile_id long, data array<{precision}>")


def predict_windows(blocks: DataFrame, net: Network, weights: list[dict[str, np.ndarray]], grid: Grid, block: int, size: int, inner: int, at_once: int = 32, precision: str = "float") -> DataFrame:
    """Probabilities around every inner-th cell of a raster: rows (row_off, col_off, data), data row-major from that cell on.

    `blocks` are tiling.margined_blocks with a margin of (size - inner) / 2; each window of `size` is scaled by its own
    extremes, where cells without a value count as zeros.  Only the windows that are worked on at once are copied.
    """
    dtype, margin = {"float": np.float32, "double": np.float64}[precision], (size - inner) // 2
    if block % inner or (size - inner) % 2:
        raise ValueError("inner must divide the block, and leave margins of one width in a window")
    shared = blocks.sparkSession.sparkContext.broadcast((net, weights))
    side, height, width = block + 2 * margin, grid.height, grid.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        for batch in batches:
            for n in range(batch.num_rows):
                top, left, k, v = (batch.column(c)[n] for c in ("block_row", "block_col", "k", "v"))
                top, left = top.as_py() * block, left.as_py() * block
                image = np.zeros(side * side)
                image[k.values.to_numpy()] = v.values.to_numpy(zero_copy_only=False)
                windows = np.lib.stride_tricks.sliding_window_view(image.reshape(side, side), (size, size))[::inner, ::inner]
                rows, cols = (x.ravel() for x in np.meshgrid(range(0, min(block, height - top), inner), range(0, min(block, width - left), inner), indexing="ij"))
                for a in range(0, len(rows), at_once):
                    r, c = rows[a : a + at_once], cols[a : a + at_once]
                    x = windows[r // inner, c // inner]
                    low, high = x.min((1, 2), keepdims=True), x.max((1, 2), keepdims=True)
                    x = np.where(high > low, (x - low) / np.where(high > low, high - low, 1), x)
                    y = own.forward(x[..., None], w, dtype)[..., 0].reshape(len(r), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(top + r, pa.int64()), pa.array(left + c, pa.int64()), lists], names=["row_off", "col_off", "data"])

    return blocks.mapInArrow(run, f"row_off long, col_off long, data array<{precision}>")


def early_stop(history: list[float], patience: int = 10) -> int | None:
    """The epoch (from 0) at which training stops: `patience` epochs without a new minimum; None to go on."""
    best, since = math.inf, 0
    for epoch, loss in enumerate(history):
        best, since = (loss, 0) if loss < best else (best, since + 1)
        if since >= patience:
            return epoch
    return None


def reduced_rate(history: list[float], rate: float, factor: float = 0.5, patience: int = 10, least: float = 0.0) -> float:
    """The learning rate after the given losses: halved after each `patience` epochs without a new minimum."""
    best, since = math.inf, 0
    for loss in history:
        best, since = (loss, 0) if loss < best else (best, since + 1)
        if since >= patience:
            rate, since = max(rate * factor, least), 0
    return rate


def is_best(history: list[float]) -> bool:
    """Whether the last epoch has the least validation loss so far, so that its weights are kept."""
    return bool(history) and history[-1] < min(history[:-1], default=math.inf)


def save_weights(spark, weights: list[dict[str, np.ndarray]], path: str) -> None:
    """Weights as a Parquet table (step, name, shape, data)."""
    rows = [(i, name, list(w.shape), bytearray(w.astype("<f4").tobytes())) for i, own in enumerate(weights) for name, w in own.items()]
    spark.createDataFrame(rows, "step int, name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark, net: Network, path: str) -> list[dict[str, np.ndarray]]:
    """Weights written by save_weights; FileNotFoundError if there are none, ValueError if they belong to another network."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path).collect()
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    out: list[dict[str, np.ndarray]] = [{} for _ in net.steps]
    for r in rows:
        if r.step >= len(out) or net.steps[r.step].shapes.get(r.name) != tuple(r.shape):
            raise ValueError(f"the weights at {path} belong to another network")
        out[r.step][r.name] = np.frombuffer(r.data, "<f4").reshape(r.shape)
    if any(set(own) != set(step.shapes) for own, step in zip(out, net.steps, strict=True)):
        raise ValueError(f"the weights at {path} are not complete")
    return out
