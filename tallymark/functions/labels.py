"""Label classes, distances, colours and percent texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.dims import FAIL_CLASS, PASS_CLASS, PASS_FAIL, PASSING_LABELS, label_ord


def is_passing(label: Column) -> Column:
    return F.coalesce(label.isin(PASSING_LABELS), F.lit(False))


def pass_fail_class(label: Column) -> Column:
    """The passing class, or the failing class for anything else."""
    return F.when(is_passing(label), F.lit(PASS_CLASS)).otherwise(F.lit(FAIL_CLASS))


def same_class(actual: Column, predicted: Column) -> Column:
    return is_passing(actual) == is_passing(predicted)


def cell_color(actual: Column, predicted: Column, mode: Column) -> Column:
    """Green, yellow or red by distance on the scale (or by class)."""
    distance = F.abs(label_ord(actual) - label_ord(predicted))
    exact = F.when(distance == 0, "green").when(distance == 1, "yellow").otherwise("red")
    by_class = F.when(same_class(actual, predicted), "green").otherwise("red")
    return F.when(mode == PASS_FAIL, by_class).otherwise(exact)


def accuracy_color(percent: Column) -> Column:
    """White to green above 50 %, towards red below."""
    step = ((percent - 50) * 5.1).cast("int")
    above = F.format_string("rgb(%d, 255, %d)", 255 - step, 255 - step)
    below = F.format_string("rgb(255, %d, %d)", step + 200, step + 200)
    return F.when(percent >= 50, above).otherwise(below)


def percent_text(percent: Column) -> Column:
    """Truncated percent, or N/A where there is no number."""
    missing = percent.isNull() | F.isnan(percent)
    return F.when(missing, "N/A").otherwise(F.concat(percent.cast("int").cast("string"), F.lit("%")))
