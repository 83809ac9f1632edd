"""Plan steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column in a step of its own. As a plain column, a filter or lambda above it would be rewritten to
    compute the value again at each place that reads it; a one-element explode is not rewritten."""
    return df.withColumn(name, F.explode(F.array(value)))
