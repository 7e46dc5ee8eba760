"""Joins beyond the built-in ones, and hints for the physical strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast by request.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only what the optimizer estimates below the bound; else leave the choice to adaptive execution."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def with_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """strategy: merge, shuffle_hash, broadcast (only if small) or none."""
    if strategy == "broadcast":
        return broadcast_if_small(df)
    return df.hint(strategy) if strategy in ("merge", "shuffle_hash") else df


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the latest right row of the same key that is not later.

    One union, one shuffle on the keys and one window; no pair is built.  Among right
    rows of one time the greatest values (in order) win; left rows without a match get nulls.
    """
    packed = F.struct(F.col(right_time).alias("_t"), *values)
    l_ = left.select("*", F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_found"))
    r_ = right.select(*(F.col(k) for k in on), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), packed.alias("_found"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = W.partitionBy(*on).orderBy("_time", "_side", F.col("_found")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, *(F.col("_last")[v].alias(v) for v in values))


def in_range(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with low <= point < high, as an equi-join on buckets of the given width.

    A range lies in as many buckets as it covers, so the width should be near the usual range.
    """
    r_ = right.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    l_ = left.withColumn("_bucket", F.floor(F.col(point) / width))
    return l_.join(r_, [*on, "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def totals_in_range(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, value: str) -> DataFrame:
    """Right rows with a point in their range, with the count `n` of such left rows and the sum `total` of their values.

    Equal points are added up first and equal ranges looked up once, so work grows with the
    pairs of distinct points and distinct ranges around them, not with the pairs of rows.
    """
    points = left.groupBy(point).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    found = in_range(points, right.select(low, high).distinct(), point, low, high, width).groupBy(low, high).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return right.join(found, [low, high])


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """A join whose left side has hot keys: left rows are dealt over salts, right rows repeated for each."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only the left side is dealt out, so right rows must not be kept")
    salt: Column = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    l_ = left.withColumn("_salt", salt)
    r_ = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l_.join(r_, [*on, "_salt"], how).drop("_salt")
