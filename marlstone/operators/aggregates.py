"""Aggregations with defined results on ties, and several aggregates over one scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_mode(column: str) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(column, True)


def moments(column: str) -> list[Column]:
    """Skewness and kurtosis of the population."""
    return [F.skewness(column), F.kurtosis(column)]


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[Any], aggregate: Column) -> DataFrame:
    """Pivot with the values given: one job, no driver round trip to find them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(aggregate)


def conditional(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Several filtered sums in one pass: name -> (condition, value)."""
    summed = [F.sum(F.when(c, v)).alias(n) for n, (c, v) in measures.items()]
    return df.groupBy(*keys).agg(*summed) if keys else df.agg(*summed)


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, salts: int = 16) -> DataFrame:
    """Two-level distinct-safe sum for hot keys: by key and salt, then by key."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    return df.groupBy(*keys, salt.alias("_salt")).agg(F.sum(value).alias("_part")).groupBy(*keys).agg(F.sum("_part").alias(f"sum_{value}"))
