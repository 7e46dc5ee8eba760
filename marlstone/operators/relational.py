"""Column and row operators that take more than one call."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Unpivot; values defaults to all columns that are no ids."""
    return df.unpivot(list(ids), list(values) if values is not None else [c for c in df.columns if c not in ids], variable, value)


def fill_missing(df: DataFrame, values: Any, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(values, list(subset) if subset else None)


def drop_missing(df: DataFrame, how: str = "any", at_least: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how, at_least, list(subset) if subset else None)


def replace_values(df: DataFrame, old_to_new: dict, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.replace(old_to_new, subset=list(subset) if subset else None)


def describe_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, least and greatest of numeric columns, a row for each, in one scan."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*(f(F.col(c)).cast("double").alias(f"{c}:{s}") for c in columns for s, f in stats.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}:{s}").alias(s) for s in stats)) for c in columns))
    return wide.select(F.inline(rows))


def cross_counts(df: DataFrame, rows: str, columns: str, values: Sequence[Any]) -> DataFrame:
    """Contingency table with the column values given, so that no extra job looks for them."""
    counted = [F.count_if(F.col(columns) == v).alias(str(v)) for v in values]
    return df.groupBy(rows).agg(*counted)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, by row number; ties need a total order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def last_rows(df: DataFrame, n: int, order: Sequence[Column], reverse: Sequence[Column]) -> DataFrame:
    """The last n rows in an order, as a frame; reverse: the same order the other way round."""
    return df.orderBy(*reverse).limit(n).orderBy(*order)
