"""Pixel values: filling, scaling, thresholds, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_nan(value: Column, default: float = 0.0, nodata: float | None = None) -> Column:
    """NaN, null and (if given) the nodata value become `default`; infinities become the largest finite doubles."""
    value = F.coalesce(F.nanvl(value.cast("double"), F.lit(default)), F.lit(default))
    if nodata is not None:
        value = F.when(value == nodata, F.lit(default)).otherwise(value)
    top = F.lit(1.7976931348623157e308)
    return F.greatest(F.least(value, top), -top)


def min_max(value: Column, low: Column, high: Column, constant: str = "keep") -> Column:
    """(value - low) / (high - low).  A constant patch keeps its values ("keep") or gives null ("null")."""
    if constant not in ("keep", "null"):
        raise ValueError("constant must be 'keep' or 'null'")
    flat = value.cast("double") if constant == "keep" else F.lit(None).cast("double")
    return F.when(high > low, (value.cast("double") - low) / (high - low)).otherwise(flat)


def min_max_over(value: Column, *keys: str, constant: str = "keep") -> Column:
    """min_max within each group of the keys."""
    group = Window.partitionBy(*keys)
    return min_max(value, F.min(value).over(group).cast("double"), F.max(value).over(group).cast("double"), constant)


def binarise_label(value: Column, threshold: float = 30) -> Column:
    """1 where the value exceeds the threshold, else 0."""
    return F.when(value > threshold, 1).otherwise(0)


def at_least(value: Column, threshold: float = 0.5) -> Column:
    """1.0 where the value reaches the threshold, else 0.0."""
    return F.when(value >= threshold, 1.0).otherwise(0.0)


def above(value: Column, threshold: float = 0.5) -> Column:
    """1.0 where the value exceeds the threshold, else 0.0."""
    return F.when(value > threshold, 1.0).otherwise(0.0)


def score(probability: Column, scale: float = 100.0) -> Column:
    """Probability times 100 in double precision, truncated to a short."""
    return (probability * F.lit(scale)).cast("smallint")


def score_float(probability: Column, scale: float = 100.0) -> Column:
    """score() in single precision throughout, as networks give their probabilities."""
    return (probability.cast("float") * F.lit(scale).cast("float")).cast("smallint")


def score_of(rows: DataFrame, name: str, scale: float = 100.0) -> Column:
    """The score of a column in the precision that the column has."""
    return (score_float if rows.schema[name].dataType.typeName() == "float" else score)(F.col(name), scale)


def suppress(value: Column, threshold: int = 10) -> Column:
    """Scores up to the threshold become 0."""
    return F.when(value > threshold, value).otherwise(F.lit(0)).cast("smallint")


def contrast(value: Column, mean: Column, factor: float) -> Column:
    return (value - mean) * F.lit(factor) + mean


def brightness(value: Column, delta: float) -> Column:
    return value + F.lit(delta)
