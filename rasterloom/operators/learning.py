"""Training of networks: gradients layer by layer, summed over the cluster, and Adam steps.

One update takes the patches of some batches, and updates follow one another, so what each costs besides its gradients
decides how long an epoch takes.  An epoch is one barrier stage: every task reads its share of each update in order, the
tasks add up their gradients through the first one, and all take the same Adam step, so an update needs no Spark job.  What
is exchanged are arrays of the weights' size.  Where executors come and go (dynamic allocation), which barrier stages do not
allow, each update is a job: tasks add up gradients, a second stage their sums, and the driver takes the step.

Normalisation uses the statistics of the patches that are taken at once, as replicas of a data-parallel run do, and keeps
moving ones for prediction.  With places in batches (`slot`) those patches follow from them; without, from the tasks.
Dropout masks follow from hashes of the update, the patch's id, the layer and the place, so they do not depend on where a
patch is worked on, and a task that runs again draws the same.
"""

from __future__ import annotations

import itertools
import math
import os
import secrets
import socket
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import metrics
from rasterloom.operators import nn

Weights = list[dict[str, np.ndarray]]
FIXED = ("mean", "variance")  # moved by averages, not by gradients
MOMENTUM, SMALL = 0.99, 1e-3


def _windows(kernel: np.ndarray) -> Iterator[tuple[int, ...]]:
    return itertools.product(*map(range, kernel.shape[:-2]))


def _over_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over all but the channels of the products of channels."""
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


def _conv_back(g, x, kernel, padding):
    size = kernel.shape[:-2]
    margin = [((k - 1) // 2, k // 2) if padding == "same" else (0, 0) for k in size]
    padded = nn._padded(x, margin)
    gx, gk = np.zeros_like(padded), np.zeros_like(kernel)
    for at in _windows(kernel):
        place = (slice(None), *[slice(a, a + n) for a, n in zip(at, g.shape[1:-1], strict=True)])
        gk[at] = _over_all(padded[place], g)
        gx[place] += g @ kernel[at].T
    return gx[(slice(None), *[slice(low, low + n) for (low, _), n in zip(margin, x.shape[1:-1], strict=True)])], gk


def _deconv_back(g, x, kernel):
    whole = np.zeros((x.shape[0], *[2 * n + k for n, k in zip(x.shape[1:-1], kernel.shape, strict=False)], g.shape[-1]), g.dtype)
    whole[(slice(None), *[slice(0, 2 * n) for n in x.shape[1:-1]])] = g
    gx, gk = np.zeros_like(x), np.zeros_like(kernel)
    for at in _windows(kernel):
        part = whole[(slice(None), *[slice(a, a + 2 * n, 2) for a, n in zip(at, x.shape[1:-1], strict=True)])]
        gk[at] = _over_all(x, part)
        gx += part @ kernel[at].T
    return gx, gk


def _repeated(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """x twice along every axis of space, with zeros up to the extent of `like`."""
    x = nn._repeat(x)
    return nn._padded(x, [(0, b - a) for a, b in zip(x.shape[1:-1], like.shape[1:-1], strict=True)])


def _halved(x: np.ndarray) -> np.ndarray:
    """Sums over windows of two along every axis of space."""
    for axis, n in enumerate(x.shape[1:-1], 1):
        x = x.reshape(*x.shape[:axis], n // 2, 2, *x.shape[axis + 1 :]).sum(axis + 1)
    return x


def _pool_back(g, x, out):
    even = (slice(None), *[slice(0, n // 2 * 2) for n in x.shape[1:-1]])
    top = x == _repeated(out, x)
    top[(slice(None), *[slice(n // 2 * 2, None) for n in x.shape[1:-1]])] = False
    ties = np.zeros(x.shape, g.dtype)
    ties[even] = nn._repeat(_halved(top[even].astype(g.dtype)))
    return np.where(top, _repeated(g, x) / np.maximum(ties, 1), 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drop_mask(draw: int, ids: np.ndarray, layer: int, shape: tuple[int, ...], rate: float, spatial: bool) -> np.ndarray:
    """0 with probability `rate`, else 1 / (1 - rate): for each patch and channel, or each patch, cell and channel."""
    own = (shape[0], *(1,) * (len(shape) - 2), shape[-1]) if spatial else shape
    key = _mixed(_mixed(np.array([draw], np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(layer))
    row = _mixed(ids.astype(np.int64).view(np.uint64) ^ key)[:, None]
    place = np.arange(math.prod(own[1:]), dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    return ((_mixed(row + place) >> np.uint64(11)) * 2.0**-53 >= rate).reshape(own) / (1 - rate)


def tally(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums from which overlaps follow: truth, prediction, both, prediction of 0.5 or more, truth with it."""
    t = p >= 0.5
    return np.array([y.sum(), p.sum(), (y * p).sum(), t.sum(), (y * t).sum()])


def overlaps(sums: np.ndarray, smooth: float = 1.0) -> tuple[float, float]:
    """Intersection over union of tallied cells, of probabilities and of those of 0.5 or more."""
    truth, soft, both, hard, shared = map(float, sums)
    return (both + smooth) / (truth + soft - both + smooth), (shared + smooth) / (truth + hard - shared + smooth)


def gradients(net: nn.Network, x: np.ndarray, y: np.ndarray, weights: Weights, draw: tuple[int, np.ndarray] | None = None, sums: list | None = None) -> tuple[float, Weights, Weights]:
    """The sum of the binary cross-entropy over all cells, its gradients, and the means and variances of the norms.

    draw is a number and the patches' ids; with it, the network's dropout is applied.  The tally of the cells is added to sums.
    """
    values: list = [x]
    masks: dict[int, np.ndarray] = {}
    seen: Weights = [{} for _ in net.steps]
    for i, (step, own) in enumerate(zip(net.steps, weights, strict=True)):
        if not i:
            continue
        args = [_dropped(values[r], masks.get(r)) for r in step.reads]
        if step.op == "norm":
            axes = tuple(range(x.ndim - 1))
            seen[i] = {"mean": args[0].mean(axes), "variance": args[0].var(axes)}
            own = own | seen[i]
        values.append(nn._OPS[step.op](*args, **step.options, **own))
        if draw is not None and i in net.drops:
            masks[i] = drop_mask(*draw, i, values[i].shape, *net.drops[i])
    if sums is not None:
        sums.append(tally(y, values[-1][..., 0]))
    p = np.clip(values[-1][..., 0], 1e-7, 1 - 1e-7)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    back: list = [None] * len(net.steps)
    back[-1] = ((p - y) / (p * (1 - p)))[..., None]
    found: Weights = [{} for _ in net.steps]

    def give(to: int, g: np.ndarray) -> None:
        back[to] = g if back[to] is None else back[to] + g

    for i in range(len(net.steps) - 1, 0, -1):
        step, own, g, out = net.steps[i], weights[i], _dropped(back[i], masks.get(i)), values[i]
        args = [_dropped(values[r], masks.get(r)) for r in step.reads]
        if step.op in ("conv", "deconv"):
            kind = step.options.get("activation")
            g = g * (out > 0) if kind == "relu" else g * out * (1 - out) if kind == "sigmoid" else g
            gx, found[i]["kernel"] = _conv_back(g, args[0], own["kernel"], step.options["padding"]) if step.op == "conv" else _deconv_back(g, args[0], own["kernel"])
            if "bias" in own:
                found[i]["bias"] = g.reshape(-1, g.shape[-1]).sum(0)
            give(step.reads[0], gx)
        elif step.op == "norm":
            axes, wide = tuple(range(x.ndim - 1)), np.sqrt(seen[i]["variance"] + SMALL)
            unit = (args[0] - seen[i]["mean"]) / wide
            found[i] = {"gamma": (g * unit).sum(axes), "beta": g.sum(axes)}
            h = g * own["gamma"]
            give(step.reads[0], (h - h.mean(axes) - unit * (h * unit).mean(axes)) / wide)
        elif step.op == "pool":
            give(step.reads[0], _pool_back(g, args[0], out))
        elif step.op == "repeat":
            give(step.reads[0], _halved(g))
        elif step.op == "crop":
            whole = np.zeros(args[0].shape, g.dtype)
            lows = [(a - b) // 2 for a, b in zip(args[0].shape[1:-1], g.shape[1:-1], strict=True)]
            whole[(slice(None), *[slice(low, low + n) for low, n in zip(lows, g.shape[1:-1], strict=True)])] = g
            give(step.reads[0], whole)
        elif step.op == "concat":
            for r, part in zip(step.reads, np.split(g, np.cumsum([a.shape[-1] for a in args])[:-1], axis=-1), strict=True):
                give(r, part)
        elif step.op == "add_relu":
            for r in step.reads:
                give(r, g * (out > 0))
        elif step.op == "times":
            give(step.reads[0], g * args[1])
            give(step.reads[1], (g * args[0]).sum(-1, keepdims=True))
    return loss, found, seen


def _dropped(values: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    return values if mask is None else values * mask


def _names(net: nn.Network) -> list[tuple[int, str]]:
    return [(i, name) for i, step in enumerate(net.steps) for name in step.shapes]


def packed(net: nn.Network, arrays: Weights) -> np.ndarray:
    """All arrays in one, in double precision; what is missing is zero."""
    return np.concatenate([np.asarray(arrays[i].get(name, np.zeros(net.steps[i].shapes[name])), np.float64).ravel() for i, name in _names(net)])


def unpacked(net: nn.Network, flat: np.ndarray) -> Weights:
    out: Weights = [{} for _ in net.steps]
    at = 0
    for i, name in _names(net):
        shape = net.steps[i].shapes[name]
        out[i][name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def gradient_sums(samples: DataFrame, net: nn.Network, weights: Weights, size: int, at_once: int = 16, groups: int = 8, draw: int | None = None) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, cells, gradients, norms' statistics (weighted by cells) and tallies, summed over samples (x, y: arrays of a patch).

    With a number to draw by, dropout is applied, for which samples need an id.
    """
    shared = samples.sparkSession.sparkContext.broadcast((net, packed(net, weights)))
    schema, names = "part int, loss double, cells long, gradients binary, seen binary, tallies binary", ["part", "loss", "cells", "gradients", "seen", "tallies"]
    dropping = draw is not None and bool(net.drops)

    def row(part: int, loss: float, cells: int, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([loss]), pa.array([cells]), *[pa.array([x.tobytes()], pa.binary()) for x in sums]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, flat = shared.value
        w, loss, cells, sums, seen, tallies = unpacked(own, flat), 0.0, 0, np.zeros(len(flat)), np.zeros(len(flat)), [np.zeros(5)]
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, *(size,) * own.space) for c in (0, 1))
                ids = part.column(2).fill_null(0).to_numpy() if dropping else None
                more, g, s = gradients(own, x[..., None], y, w, (draw, ids) if dropping else None, tallies)
                loss, cells, sums, seen = loss + more, cells + y.size, sums + packed(own, g), seen + packed(own, s) * y.size
        if cells:
            yield row(TaskContext.get().partitionId() % groups, loss, cells, sums, seen, sum(tallies))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, loss, cells, *sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                new = [loss, cells, *map(np.frombuffer, sums)]
                total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total:
            yield row(0, *total)

    taken = samples.select("x", "y", *[F.col("id").cast("long").alias("id")] * dropping)
    rows = taken.mapInArrow(run, schema).repartition(groups, "part").mapInArrow(add, schema).collect()
    flat = lambda name, size: sum((np.frombuffer(r[name]) for r in rows), np.zeros(size))
    size = len(packed(net, weights))
    return sum(r.loss for r in rows), sum(r.cells for r in rows), flat("gradients", size), flat("seen", size), flat("tallies", 5)


def judged(samples: DataFrame, net: nn.Network, weights: Weights, size: int) -> Row:
    """loss, iou and iou_thresholded of predictions over all cells of samples: null loss where there are none."""
    scored = nn.predict_tiles(samples.select(F.col("id").cast("long").alias("tile_id"), F.col("x").alias("data")), net, weights, size, precision="double")
    both = scored.withColumnRenamed("data", "p").join(samples.select(F.col("id").cast("long").alias("tile_id"), "y"), "tile_id")
    cell = both.select(F.explode(F.arrays_zip("p", "y")).alias("z")).select("z.p", "z.y")
    near = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = F.avg(-(F.col("y") * F.log(near) + (1 - F.col("y")) * F.log1p(-near)))
    return cell.agg(loss.alias("loss"), metrics.iou(F.col("y"), F.col("p")).alias("iou"), metrics.iou_at_least(F.col("y"), F.col("p")).alias("iou_thresholded")).first()


def mean_loss(samples: DataFrame, net: nn.Network, weights: Weights, size: int) -> float:
    """The mean binary cross-entropy of predictions over samples."""
    return judged(samples, net, weights, size).loss


def _slots(spark: SparkSession) -> int:
    """Tasks that run at the same time, which all tasks of a barrier stage must."""
    context = spark.sparkContext
    conf = context.getConf()
    cpus, found = int(conf.get("spark.task.cpus", "1")), context.defaultParallelism
    if conf.contains("spark.default.parallelism"):  # a number of partitions, not of cores
        executors = max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1)
        found = min(found, executors * int(conf.get("spark.executor.cores", "1")))
    return max(1, found // cpus)


def _at_once(connection: Connection) -> Connection:
    """The connection, on which short messages do not wait for one another."""
    with socket.socket(fileno=os.dup(connection.fileno())) as same:
        same.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return connection


@contextmanager
def _added_up(context: BarrierTaskContext, key: bytes) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A function that adds up arrays of one length over the tasks of a barrier stage, in the order of the tasks.

    All send to the first task, whose address they learn from Spark, and get the sum from it.  A task that ends early closes
    its connection, on which the others fail, and Spark runs the stage again.
    """
    tasks, own = context.getTaskInfos(), context.partitionId()
    host = tasks[0].address.rpartition(":")[0]
    if own:
        place = next(filter(None, context.allGather("")))
        with _at_once(Client((host, int(place)), authkey=key)) as first:
            first.send_bytes(own.to_bytes(4, "little"))

            def add(array: np.ndarray) -> np.ndarray:
                first.send_bytes(array.tobytes())
                return np.frombuffer(first.recv_bytes())

            yield add
        return
    others: dict[int, Connection] = {}
    with Listener((host, 0), backlog=len(tasks), authkey=key) as listener:
        context.allGather(str(listener.address[1]))
        for _ in tasks[1:]:
            other = _at_once(listener.accept())
            others[int.from_bytes(other.recv_bytes(), "little")] = other

    def add_all(array: np.ndarray) -> np.ndarray:
        total = array.copy()
        for k in sorted(others):
            total += np.frombuffer(others[k].recv_bytes())
        for other in others.values():
            other.send_bytes(total.tobytes())
        return total

    try:
        yield add_all
    finally:
        for other in others.values():
            other.close()


def _lots(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Updates with rows of one lot, at_once of them or what is left of the lot; rows come sorted by update and lot."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        update, lot = (batch.column(n).to_numpy() for n in ("update", "lot"))
        edges = [0, *(np.flatnonzero((update[1:] != update[:-1]) | (lot[1:] != lot[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in itertools.pairwise(edges):
            while high - low >= at_once or low < high < batch.num_rows:
                yield int(update[low]), batch.slice(low, min(at_once, high - low))
                low += min(at_once, high - low)
        rest = batch.slice(low) if low < batch.num_rows else None
    if rest is not None:
        yield int(rest.column("update")[0].as_py()), rest


#: Weights, the two moments of their gradients, and the updates so far.
State = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def _stepped(state: State, g: np.ndarray, seen: np.ndarray, moves: np.ndarray, rate: float) -> State:
    """The state after an Adam step by mean gradients; what does not move by them takes in the norms' mean statistics."""
    flat, m, v, step = state
    step, m, v = step + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    moved = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return np.where(moves, moved, MOMENTUM * flat + (1 - MOMENTUM) * seen), m, v, step


def _epoch_in_jobs(samples: DataFrame, n_updates: int, per_update: int, net: nn.Network, state: State, moves: np.ndarray, size: int, rate: float, seed: int) -> tuple[State, float, float, np.ndarray]:
    """State, loss, cells and tallies after an epoch in which each update is a job."""
    loss, cells, tallies = 0.0, 0.0, np.zeros(5)
    for low in range(0, n_updates * per_update, per_update):
        lost, seen_cells, g, seen, sums = gradient_sums(samples.where(F.col("batch_id").between(low, low + per_update - 1)), net, unpacked(net, state[0]), size, draw=(seed << 32) + state[3])
        if seen_cells:
            loss, cells, tallies = loss + lost, cells + seen_cells, tallies + sums
            state = _stepped(state, g / seen_cells, seen / seen_cells, moves, rate)
    return state, loss, cells, tallies


def _epoch_in_stage(samples: DataFrame, n_updates: int, per_update: int, net: nn.Network, state: State, moves: np.ndarray, size: int, rate: float, seed: int, at_once: int = 16) -> tuple[State, float, float, np.ndarray]:
    """State, loss, cells and tallies after an epoch in one barrier stage."""
    spark = samples.sparkSession
    tasks, dropping = _slots(spark), bool(net.drops)
    shared, key = spark.sparkContext.broadcast((net, state, moves)), secrets.token_bytes(32)
    if "slot" in samples.columns:
        a_batch = (samples.agg(F.max("slot")).first()[0] or 0) // at_once + 1
        lot = F.col("batch_id") * a_batch + F.floor(F.col("slot") / at_once)
    else:
        lot = F.pmod(F.xxhash64("x", "y"), F.lit(tasks))
    columns = ["x", "y", *[F.col("id").cast("long").alias("id")] * dropping, F.floor(F.col("batch_id") / per_update).cast("long").alias("update"), lot.cast("long").alias("lot"), *["slot"] * ("slot" in samples.columns)]
    order = ["update", "lot", *[n for n in ("slot", "id") if n in samples.columns and (n != "id" or dropping)]]
    dealt = samples.select(*columns).repartitionById(tasks, F.pmod("lot", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, moving = shared.value
        n, loss, cells, tallies = len(moving), 0.0, 0.0, np.zeros(5)
        context, lots = BarrierTaskContext.get(), _lots(batches, at_once)
        upcoming = next(lots, None)
        with _added_up(context, key) as added_up:
            for update in range(n_updates):
                sums, w = np.zeros(7 + 2 * n), unpacked(own, now[0])  # loss, cells, tallies, gradients, statistics
                while upcoming is not None and upcoming[0] == update:
                    part = upcoming[1]
                    x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, *(size,) * own.space) for c in (0, 1))
                    found: list = []
                    lost, g, seen = gradients(own, x[..., None], y, w, ((seed << 32) + now[3], part.column(2).fill_null(0).to_numpy()) if dropping else None, found)
                    sums += np.concatenate([[lost, y.size], *found, packed(own, g), packed(own, seen) * y.size])
                    upcoming = next(lots, None)
                sums = added_up(sums)
                if sums[1]:
                    loss, cells, tallies = loss + sums[0], cells + sums[1], tallies + sums[2:7]
                    now = _stepped(now, sums[7 : 7 + n] / sums[1], sums[7 + n :] / sums[1], moving, rate)
        if not context.partitionId():
            yield pa.RecordBatch.from_pydict({"loss": [loss], "cells": [cells], "step": [now[3]]} | {k: [a.tobytes()] for k, a in zip(("tallies", "flat", "m", "v"), (tallies, *now[:3]), strict=True)})

    (row,) = dealt.mapInArrow(run, "loss double, cells double, step long, tallies binary, flat binary, m binary, v binary", barrier=True).collect()
    shared.unpersist()
    return (*(np.frombuffer(row[k]) for k in ("flat", "m", "v")), row.step), row.loss, row.cells, np.frombuffer(row.tallies)


def train(samples: DataFrame, validation: DataFrame, net: nn.Network, weights: Weights, size: int, epochs: int, per_update: int = 1, rate: float = 1e-3, patience: int = 10, seed: int = 0) -> tuple[Weights, list[dict]]:
    """The weights of the epoch with the least validation loss, and a history of losses, overlaps, rates and what was kept.

    `samples` are rows (batch_id from 0, x, y, an id if the network has dropout, and maybe slot, the place in the batch from
    0), `validation` rows (id, x, y); both should be stored tables.  With slot, norms see the same patches however many tasks
    there are.  The rate is halved, and training stops, by the rules in nn, on the training and the validation loss.  iou and
    iou_thresholded of training are those of the passes that made the gradients, with dropout and moving weights.
    """
    names = _names(net)
    moves = np.concatenate([np.full(math.prod(net.steps[i].shapes[name]), name not in FIXED) for i, name in names])
    flat = packed(net, weights)
    state: State = flat, np.zeros(len(flat)), np.zeros(len(flat)), 0
    last = samples.agg(F.max("batch_id")).first()[0]
    best, history, start = flat, [], rate
    epoch_of = _epoch_in_jobs if samples.sparkSession.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true" else _epoch_in_stage
    for epoch in range(epochs if last is not None else 0):
        state, loss, cells, tallies = epoch_of(samples, last // per_update + 1, per_update, net, state, moves, size, rate, seed)
        found, (soft, hard) = judged(validation, net, unpacked(net, state[0]), size), overlaps(tallies)
        history.append({"epoch": epoch, "loss": loss / cells, "iou": soft, "iou_thresholded": hard, "val_loss": found.loss, "val_iou": found.iou, "val_iou_thresholded": found.iou_thresholded, "rate": rate})
        history[-1]["kept"] = nn.is_best([h["val_loss"] for h in history])
        best = state[0] if history[-1]["kept"] else best
        rate = nn.reduced_rate([h["loss"] for h in history], start, patience=patience)
        if nn.early_stop([h["val_loss"] for h in history], patience) is not None:
            break
    return unpacked(net, best), history
