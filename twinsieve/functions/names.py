"""File names, labels and colours as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"\.(jpg|jpeg|png)$"
# Points for what a file name says was done to the image.
BONUS = {
    "rotate": -20, "flip": -15, "grayscale": -25, "blur": -30, "noise": -20, "darker": -10, "brighter": -10,
    "desaturate": -20, "hue": -15, "saturation": -15, "original": 30,
}
# Least score, label and colour of the bands; then of what is below them.
BANDS = ((80, "Excellent", "#10b981"), (60, "Good", "#3b82f6"), (40, "Fair", "#f59e0b"), (20, "Poor", "#ef4444"))
LOWEST = ("Very Poor", "#991b1b")
# Colours of list entries by score, and without one.
LIGHTS = ((80, "#34d399"), (50, "#fbbf24"))
LOW_LIGHT, NO_LIGHT = "#f87171", "#666"
# Colours of clusters in turn.
PALETTE = ("#ff00ff", "#00ffff", "#ffff00", "#ff0080", "#00ff00", "#ff8000", "#8000ff", "#00ff80")
NOISE_COLOUR = "#666666"


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(IMAGE)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def label_of(name: Column) -> Column:
    """The class: what stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def safe_name(name: Column) -> Column:
    """An uploaded name without ``..``, with ``_`` for ``/``."""
    return F.replace(F.replace(name, F.lit(".."), F.lit("")), F.lit("/"), F.lit("_"))


def group_name(position: Column, prefix: str = "group") -> Column:
    return F.format_string(f"{prefix}_%03d", position)


def filename_bonus(name: Column) -> Column:
    """Sum of the points of all words that the name holds, within -100 and 30."""
    low = F.lower(name)
    total = reduce(lambda s, k: s + F.when(low.contains(k[0]), F.lit(float(k[1]))).otherwise(0.0), BONUS.items(), F.lit(0.0))
    return F.greatest(F.lit(-100.0), F.least(F.lit(30.0), total))


def quality_label(score: Column) -> Column:
    return reduce(lambda rest, b: F.when(score >= b[0], b[1]).otherwise(rest), reversed(BANDS), F.lit(LOWEST[0]))


def quality_colour(score: Column) -> Column:
    return reduce(lambda rest, b: F.when(score >= b[0], b[2]).otherwise(rest), reversed(BANDS), F.lit(LOWEST[1]))


def traffic_light(score: Column) -> Column:
    return reduce(lambda rest, b: F.when(score >= b[0], b[1]).otherwise(rest), reversed(LIGHTS), F.when(score.isNull(), NO_LIGHT).otherwise(LOW_LIGHT))


def cluster_colour(index: Column) -> Column:
    """By index, round a palette of eight; null is noise."""
    return F.when(index.isNull(), F.lit(NOISE_COLOUR)).otherwise(F.element_at(F.array(*map(F.lit, PALETTE)), (index % len(PALETTE) + 1).cast("int")))
