"""Running sums that no single task has to order: sums over ranges of the order first, then inside each range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cuts between the ranges that running sums are made in: a power of two less one.
CUTS = 1023


def range_cuts(df: DataFrame, value: str, cuts: int = CUTS) -> DataFrame:
    """(_cuts): one row with the values at cuts even quantiles of a column, within a ten-thousandth of the rows, whatever its distribution."""
    at = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    return df.agg(F.approx_percentile(F.col(value).cast("double"), at, F.lit(10_000)).alias("_cuts"))


def order_range(value: Column, cuts: str = "_cuts", number: int = CUTS) -> Column:
    """How many cuts lie below a value, by halving: a code that keeps the order of numbers."""
    x, steps = value.cast("double"), [(number + 1) >> (i + 1) for i in range((number + 1).bit_length() - 1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(F.element_at(F.col(cuts), low + s) < x, low + s).otherwise(low)).cast("bigint")


def same_keys(by: list[str], other: str = "_{}") -> Column:
    """Null-safe equality of the columns by with other.format(position); true for no columns."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other.format(i))) for i, c in enumerate(by)], F.lit(True))


def renamed(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """The other side of same_keys: by under its private names, and the named columns."""
    return df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], *columns)


def sums_before(df: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds before_<c> for each column of sums: its sum over the rows of the group that come earlier in the order.

    The order has to be total in the group and its first column a number without nulls. Ranges are cut at that column's quantiles, so each holds few
    rows, for any distribution; only rows of one value of it are never parted.
    """
    cut = df.join(F.broadcast(range_cuts(df, order[0]))).withColumn("_range", order_range(F.col(order[0]))).drop("_cuts")  # one row
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    parts = parts.select(*by, F.col("_range").alias("_to"), *[F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums])
    joined = placed.join(renamed(parts, by, "_to", *[f"_o_{c}" for c in sums]), same_keys(by) & (F.col("_range") == F.col("_to")))
    return joined.select(*df.columns, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums])
