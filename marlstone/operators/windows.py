"""Window patterns: sessions, islands, moving frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from marlstone.operators.joins import estimated_bytes

#: Estimated bytes of a task that sorts narrow rows; in memory they take some ten times the estimate from a compressed file.
TASK_BYTES = 4 << 20
#: Most tasks by such an estimate, and bytes from which an estimate only says that Spark does not know the size.
MOST_TASKS, UNKNOWN_BYTES = 10_000, 1 << 60


def frame(keys: Sequence[str], order: Sequence[Column | str], rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> WindowSpec:
    spec = W.partitionBy(*keys).orderBy(*order)
    if rows:
        spec = spec.rowsBetween(*rows)
    return spec.rangeBetween(*range_) if range_ else spec


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int, tie: Sequence[str] = ()) -> DataFrame:
    """Number the sessions of each key; a gap of more than gap_seconds starts one.  One shuffle serves both windows."""
    w = W.partitionBy(*keys).orderBy(time, *tie)
    late = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return df.withColumn("_new", F.coalesce(late, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by their keys in so many tasks that a task does not grow with the input; input that is small or of unknown size is left to adaptive execution."""
    size = estimated_bytes(df)
    tasks = min(size // TASK_BYTES + 1, MOST_TASKS)
    return df.repartition(tasks, *keys) if df.sparkSession.sparkContext.defaultParallelism < tasks and size < UNKNOWN_BYTES else df


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """First, last and size of each run of consecutive distinct whole numbers of a key; the nulls of a key are a run of size 1.

    One shuffle on the keys and one sort, which spills, serve all three windows; no table of numbers or runs is held.
    """
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_first(number))
    x = F.col(number)
    first_of_equal = F.lag(F.lit(1)).over(w).isNull() | ~F.lag(x).over(w).eqNullSafe(x)
    numbers = dealt(df.select(*keys, number), keys).withColumn("_kept", first_of_equal).where("_kept").drop("_kept")
    # the number next to a null or to nothing is none, and so is a border
    starts, ends = (F.coalesce(c, F.lit(True)) for c in (F.lag(x).over(w) < x - 1, F.lead(x).over(w) - 1 > x))
    borders = numbers.withColumns({"_starts": starts, "_ends": ends}).where("_starts OR _ends")
    runs = borders.withColumn("_last", F.when(F.col("_ends"), x).otherwise(F.lead(x).over(w))).where("_starts")
    return runs.select(*keys, x.alias("first"), F.col("_last").alias("last"), F.coalesce((F.col("_last") - x).cast("long") + 1, F.lit(1)).alias("size"))


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str, path: str) -> DataFrame:
    """rank() over all rows without gathering them: ranges of the order are ranked each by itself, after the counts of those before.

    path: a new shared folder; the ranges are written there once, so that counts
    and ranks see the same ones.  Equal keys fall into one range.
    """
    spark = df.sparkSession
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    # one row a range, of which there are as many as shuffle partitions
    counts = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    offsets = spark.createDataFrame(before, "_range int, _before long")
    within = F.rank().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(offsets), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")
