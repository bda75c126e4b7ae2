"""What ordered operators share: partition and order columns, which must be unique within a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED, FOLLOWING = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def whole(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def centred(by: list[str], order: list[str], half: int) -> WindowSpec:
    return ordered(by, order).rowsBetween(-half, half)


def exact_percentile(column: Column, share: float) -> Column:
    return F.percentile(column, F.lit(share))


def with_group_values(df: DataFrame, by: list[str], values: DataFrame) -> DataFrame:
    """Joins one row of values to each group; a group without values keeps nulls."""
    return df.join(values, by, "left") if by else df.crossJoin(values)
