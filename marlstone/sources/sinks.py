"""Sinks: files, managed tables, create-as-select, inserts, views and lakehouse appends."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANAGED = ("parquet", "orc", "csv", "json")


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options: Any) -> str:
    writer = df.write.format(fmt).mode(mode).options(**{k: str(v) for k, v in options.items()})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def create_table(spark: SparkSession, name: str, columns: str, fmt: str = "parquet", if_not_exists: bool = False, comment: str | None = None, partitioned_by: Sequence[str] = (), properties: dict[str, str] | None = None) -> None:
    if fmt not in MANAGED:
        raise ValueError(f"no managed format: {fmt}")
    parts = [f"CREATE TABLE {'IF NOT EXISTS ' * if_not_exists}{name} ({columns}) USING {fmt}"]
    if partitioned_by:
        parts.append(f"PARTITIONED BY ({', '.join(partitioned_by)})")
    if comment:
        parts.append("COMMENT " + _literal(comment))
    if properties:
        parts.append("TBLPROPERTIES (" + ", ".join(f"{_literal(k)} = {_literal(v)}" for k, v in properties.items()) + ")")
    spark.sql(" ".join(parts))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_as_select(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), bucket_by: tuple[int, Sequence[str]] | None = None) -> DataFrame:
    """A managed table of a frame's rows; bucket_by (number, columns) lets later joins and groupings skip the shuffle."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def insert_into(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Append or overwrite by position, as INSERT does."""
    df.write.insertInto(name, overwrite=overwrite)


def append_lakehouse(df: DataFrame, fmt: str, target: str) -> None:
    """Append to a Delta folder or an Iceberg table; needs the connector."""
    df.writeTo(target).append() if fmt == "iceberg" else df.write.format(fmt).mode("append").save(target)


def temp_view(df: DataFrame, name: str, replace: bool = True, global_: bool = False) -> None:
    if global_:
        df.createOrReplaceGlobalTempView(name) if replace else df.createGlobalTempView(name)
    else:
        df.createOrReplaceTempView(name) if replace else df.createTempView(name)


def collect_arrow(df: DataFrame):
    """A result as one Arrow table; only for results known to be small."""
    return df.toArrow()


def show_string(df: DataFrame, n: int = 20, truncate: int = 20, vertical: bool = False) -> str:
    return df._show_string(n, truncate, vertical)
