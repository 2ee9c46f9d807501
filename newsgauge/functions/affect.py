"""Column expressions on affect scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgauge.functions.fixed_values import INTENSITY_EMOTIONS


def dominant_emotion() -> Column:
    """Name of the first strongest emotion; nulls are skipped, all null gives null."""
    columns = [F.col(f"eireg_{e}") for e in INTENSITY_EMOTIONS]
    strongest = F.greatest(*columns)
    name = F.lit(None).cast("string")
    for emotion, column in reversed(list(zip(INTENSITY_EMOTIONS, columns))):
        name = F.when(column == strongest, F.lit(emotion)).otherwise(name)
    return name


def vreg_bucket(v: Column) -> Column:
    """negative < 0.4 <= neutral < 0.6 <= positive; null counts as positive."""
    return F.when(v < 0.4, "negative").when(v < 0.6, "neutral").otherwise("positive")


def is_fake(label: Column) -> Column:
    """1 for fake, else 0; an unlabelled article counts as 0."""
    return label.eqNullSafe("fake").cast("int")


def label_name(y: Column) -> Column:
    return F.when(y == 1, "fake").otherwise("real")
