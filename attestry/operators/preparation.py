"""Imputation and scaling with statistics of chosen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impute_values(df: DataFrame, stat_rows: DataFrame, median: list[str], mode: list[str]) -> DataFrame:
    """Nulls, and zeros in the median columns, become the exact median; nulls in the mode columns the mode, smallest on ties.

    A column with no value among the statistic rows becomes 0. The statistics are one row, so they are broadcast.
    """
    stats = stat_rows.agg(*[F.median(F.nullif(F.col(c), F.lit(0))).alias(f"_{c}") for c in median], *[F.mode(c, True).alias(f"_{c}") for c in mode])
    out = df.join(F.broadcast(stats))
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("double"), F.col(f"_{c}"), F.lit(0.0)) for c in median}
    fill |= {c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0)) for c in mode}
    return out.select(*[fill[c].alias(c) if c in fill else c for c in df.columns])


def scale_values(df: DataFrame, stat_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Minus the mean, over the population standard deviation; a constant column is only centred."""
    stats = stat_rows.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}")) for c in columns}
    return df.join(F.broadcast(stats)).select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def require_complete(df: DataFrame, columns: list[str]) -> None:
    """Raises if a column holds a null: one pass, one row to the driver."""
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()
    bad = [c for c in columns if row[c]]
    if bad:
        raise ValueError(f"nulls without an imputation scope in {', '.join(bad)}")
