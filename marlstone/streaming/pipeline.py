"""Structured Streaming: sources, event-time operators, sinks and query control."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def read_files(spark: SparkSession, path: str, schema: Any, fmt: str = "parquet", per_trigger: int | None = None, **options: Any) -> DataFrame:
    """New files of a folder (or of a glob)."""
    reader = spark.readStream.format(fmt).schema(schema).options(**{k: str(v) for k, v in options.items()})
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def read_rate(spark: SparkSession, rows: int, micro_batch: bool = True) -> DataFrame:
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).load() if micro_batch else spark.readStream.format("rate").option("rowsPerSecond", rows).load()


def read_spool(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """Records of a topic spooled as JSON lines; with the connector on the class path, use read_topic."""
    return read_files(spark, path, schema, "json")


def read_topic(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load()


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time with a watermark; times without a zone are taken in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed_counts(df: DataFrame, column: str, length: str, slide: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    w = F.window(column, length, slide) if slide else F.window(column, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def session_counts(df: DataFrame, column: str, gap: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def deduplicated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """State is dropped once the watermark has passed; needs a watermark."""
    return df.dropDuplicatesWithinWatermark(list(columns))


def interval_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two streams; the condition bounds the times of both, so state can be dropped."""
    return left.join(right, F.expr(on), how)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far of each key that a batch touches, by state kept for each key."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def write(df: DataFrame, checkpoint: str, fmt: str = "parquet", path: str | None = None, name: str | None = None, mode: str = "append", every: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query; every=None takes what is there and stops, and a restart resumes from the checkpoint."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    if each:
        return writer.foreachBatch(each).start()
    return writer.format(fmt).start(path) if path else writer.format(fmt).start()


def status(query: StreamingQuery) -> dict:
    return {"id": query.id, "runId": query.runId, "name": query.name, "active": query.isActive, "message": query.status["message"], "progress": query.lastProgress}


def finished(df: DataFrame, checkpoint: str, target: str, mode: str = "append") -> DataFrame:
    """Run over all that is there and read the result back from files."""
    write(df, checkpoint, path=target, mode=mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(target)
