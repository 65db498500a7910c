"""File names, and colours of masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The channels that carry the mask, by colour name.
COLOURS = {"red": "r", "green": "g", "blue": "b", "yellow": "rg", "magenta": "rb", "cyan": "gb"}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def output_name(path: Column, model: Column, subfolder: str) -> Column:
    """{folder}/{subfolder}/{stem}_{model}_pred.tif"""
    return F.concat(folder(path), F.lit(f"/{subfolder}/"), stem(path), F.lit("_"), model, F.lit("_pred.tif"))


def label_name(path: Column) -> Column:
    """The label that belongs to an image file: img becomes lab and image becomes label in the base name."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_extract(path, r"^(.*/|)[^/]*$", 1), F.regexp_replace(F.regexp_replace(base, "image", "label"), "img", "lab"))


def patch_id(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)_(?:img|lab|image|label)\.tif$", 1).try_cast("long")


def patch_size(model_name: Column) -> Column:
    """The number in a trailing _{n}px; null if there is none."""
    return F.regexp_extract(model_name, r"_(\d+)px$", 1).try_cast("int")


def required_patch_size(model_name: Column) -> Column:
    """patch_size, or an error for a name without one."""
    return F.coalesce(patch_size(model_name), F.raise_error(F.concat(F.lit("no patch size in the model name "), model_name)).cast("int"))


def checkpoint_name(epoch: Column, loss: Column, template: str = "model_epoch_%02d_valloss_%.2f.h5") -> Column:
    """A name by a template in printf's form, with the epoch first and the validation loss second."""
    return F.format_string(template, epoch, loss)


def rgba(mask: Column, colour: str = "red") -> list[Column]:
    """Columns r, g, b, a: the mask in the colour's channels and as alpha."""
    if colour not in COLOURS:
        raise ValueError(f"colour must be one of {sorted(COLOURS)}")
    zero = F.lit(0).cast("double")
    return [(mask.cast("double") if c in COLOURS[colour] + "a" else zero).alias(c) for c in "rgba"]


def colour_map(dimensions: Column, channels: Column) -> Column:
    """gray for three dimensions or one channel, jet for four dimensions and three channels, else null."""
    return F.when(dimensions == 3, "gray").when((dimensions == 4) & (channels == 3), "jet").when((dimensions == 4) & (channels == 1), "gray")
