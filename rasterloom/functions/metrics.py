"""Segmentation metrics and losses as aggregate columns over (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.radiometry import above, at_least


def _overlap(truth: Column, prediction: Column) -> tuple[Column, Column]:
    return F.sum(truth * prediction), F.sum(truth + prediction)


def iou(truth: Column, prediction: Column, smooth: float = 1.0) -> Column:
    both, total = _overlap(truth, prediction)
    return (both + smooth) / (total - both + smooth)


def jaccard(truth: Column, prediction: Column) -> Column:
    """The same with a smoothing of one, from the sum of both masks."""
    return iou(truth, prediction, 1.0)


def iou_at_least(truth: Column, prediction: Column, threshold: float = 0.5, smooth: float = 1.0) -> Column:
    return iou(truth, at_least(prediction, threshold), smooth)


def iou_above(truth: Column, prediction: Column, threshold: float = 0.5, smooth: float = 1.0) -> Column:
    return iou(truth, above(prediction, threshold), smooth)


def dice(truth: Column, prediction: Column, smooth: float = 1.0) -> Column:
    both, total = _overlap(truth, prediction)
    return (2 * both + smooth) / (total + smooth)


def jaccard_distance(truth: Column, prediction: Column, smooth: float = 100.0) -> Column:
    """Over the channels of a pixel: group by image, row and column."""
    both, total = F.sum(F.abs(truth * prediction)), F.sum(F.abs(truth) + F.abs(prediction))
    return (1 - (both + smooth) / (total - both + smooth)) * smooth


def cross_entropy(truth: Column, prediction: Column, epsilon: float = 1e-7) -> Column:
    p = F.greatest(F.least(prediction, F.lit(1 - epsilon)), F.lit(epsilon))
    return F.avg(-(truth * F.log(p) + (1 - truth) * F.log(1 - p)))


def f1(truth: Column, predicted: Column) -> Column:
    """2 TP / (2 TP + FP + FN) of two 0/1 columns; null if all are 0."""
    hit = F.count_if((truth == 1) & (predicted == 1))
    miss = F.count_if((truth == 1) != (predicted == 1))
    return F.try_divide(2 * hit, 2 * hit + miss)
