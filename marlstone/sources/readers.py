"""Batch sources: files, tables, inline data, ranges, SQL relations and registered names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Formats that need a connector on the class path; they pass through to spark.read.
CONNECTORS = ("delta", "iceberg", "avro", "kafka")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; a local one only where none is named and Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(top or os.path.join(tempfile.gettempdir(), 'marlstone-shared')).rstrip('/')}/engine/{name}-{uuid.uuid4().hex}"


def named(spark: SparkSession, name: str) -> DataFrame:
    """A table or view by its name, qualified or not."""
    return spark.table(name)


def files(spark: SparkSession, fmt: str, paths: str | Sequence[str], schema: StructType | str | None = None, base_path: str | None = None, **options: Any) -> DataFrame:
    """Files of any format Spark reads; base_path keeps partition columns of the given folders."""
    reader = spark.read.format(fmt).options(**{k: str(v) for k, v in options.items()})
    if base_path:
        reader = reader.option("basePath", base_path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load([paths] if isinstance(paths, str) else list(paths))


def direct(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """The SQL form of a path: SELECT * FROM fmt.`path`."""
    return spark.sql(f"SELECT * FROM {fmt}.`{path}`")


def inline(spark: SparkSession, data: pa.Table | Iterable[tuple], schema: StructType | str | None = None) -> DataFrame:
    """Rows or an Arrow table held by the driver."""
    return spark.createDataFrame(data) if isinstance(data, pa.Table) else spark.createDataFrame(list(data), schema)


def sequence(spark: SparkSession, start: int, end: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    return spark.range(start, end, step, partitions)


def register(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Name a frame; whether it is broadcast is left to the sizes that Spark knows."""
    df.createOrReplaceTempView(name)
    return df


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    return register(spark, name, spark.read.parquet(path))


def register_lakehouse(spark: SparkSession, name: str, fmt: str, path: str, version: int | str | None = None) -> DataFrame:
    """A Delta or Iceberg table at a version or snapshot; raises Spark's own error where the connector is missing."""
    if fmt not in ("delta", "iceberg"):
        raise ValueError(f"not a lakehouse format: {fmt}")
    option = {} if version is None else {"versionAsOf" if fmt == "delta" else "snapshot-id": version}
    return register(spark, name, files(spark, fmt, path, **option))


def register_samples(spark: SparkSession, sf_dir: str, tables: Iterable[str] = TABLES, prefix: str = "") -> list[str]:
    """Temp views of all tables of a folder."""
    names = []
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"{prefix}{t}")
        names.append(f"{prefix}{t}")
    return names
