"""Delta tables by their log: snapshots, time travel, appends and overwrites, without a connector.

A table's state is the last action on each file up to a version; Spark reads the
log's JSON and the latest checkpoint, and only file names reach the driver.  A
commit creates the next numbered log file and fails over to the one after it if
another writer was first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ADD = "struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,dataChange:boolean>"
LOG = f"add {ADD}, remove struct<path:string,deletionTimestamp:bigint,dataChange:boolean>, metaData struct<id:string,schemaString:string,partitionColumns:array<string>>"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, log = _fs(spark, f"{path}/_delta_log")
    return sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:20]) for n in _names(spark, path) if n.endswith(".json") and n[:20].isdigit()]


def actions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log's actions up to a version, with the version of each."""
    names = _names(spark, path)
    points = [int(n[:20]) for n in names if n.endswith(".checkpoint.parquet") and (version is None or int(n[:20]) <= version)]
    base = max(points, default=-1)
    commits = [n for n in names if n.endswith(".json") and n[:20].isdigit() and base < int(n[:20]) and (version is None or int(n[:20]) <= version)]
    if base < 0 and not commits:
        raise ValueError(f"no version {'' if version is None else version} of a table at {path}")
    parts = []
    if commits:
        parts.append(spark.read.schema(LOG).json([f"{path}/_delta_log/{n}" for n in commits]).withColumn("version", F.substring(F.col("_metadata.file_name"), 1, 20).cast("long")))
    if base >= 0:
        parts.append(spark.read.schema(LOG).parquet(f"{path}/_delta_log/{base:020d}.checkpoint.parquet").withColumn("version", F.lit(base).cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(path, partitionValues) of the files of a version."""
    each = actions(spark, path, version).where("add IS NOT NULL OR remove IS NOT NULL")
    each = each.select(F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", F.col("add").isNotNull().alias("there"), F.col("add.partitionValues").alias("values")).alias("last"))
    last = each.groupBy("path").agg(F.max_by("last", F.struct("last.version", "last.there")).alias("last"))
    return last.where("last.there").select("path", F.col("last.values").alias("partitionValues"))


def schema_of(spark: SparkSession, path: str, version: int | None = None) -> tuple[StructType, list[str]]:
    row = actions(spark, path, version).where("metaData IS NOT NULL").agg(F.max_by("metaData", "version").alias("m")).first()
    return StructType.fromJson(json.loads(row.m.schemaString)), list(row.m.partitionColumns or [])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the latest or a pinned version; filters on partition columns prune folders."""
    schema, _ = schema_of(spark, path, version)
    names = [r.path for r in live_files(spark, path, version).select("path").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    bases = {n.split("/", 1)[0] for n in names}
    if len(bases) == 1:
        return reader.option("basePath", f"{path}/{bases.pop()}").parquet(*(f"{path}/{n}" for n in names))
    out = None
    for base in sorted(bases):
        own = reader.option("basePath", f"{path}/{base}").parquet(*(f"{path}/{n}" for n in names if n.startswith(f"{base}/")))
        out = own if out is None else out.unionByName(own)
    return out


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> int:
    """Append or overwrite; gives the new version."""
    spark = df.sparkSession
    batch = f"batch-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{batch}")
    fs, top = _fs(spark, f"{path}/{batch}")
    prefix, found, files = fs.makeQualified(top).toString(), fs.listFiles(top, True), []
    while found.hasNext():
        s = found.next()
        if s.getPath().getName().startswith("part-"):
            files.append((s.getPath().toString()[len(prefix) + 1 :], s.getLen()))
    now = int(time.time() * 1000)
    adds = [{"add": {"path": f"{batch}/{n}", "partitionValues": dict(p.split("=", 1) for p in n.split("/")[:-1]), "size": size, "modificationTime": now, "dataChange": True}} for n, size in sorted(files)]
    while True:
        there = versions(spark, path)
        version, lines = (there[-1] + 1 if there else 0), []
        if not there or overwrite:
            lines += [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}] if not there else []
            lines.append({"metaData": {"id": uuid.uuid4().hex, "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": list(partition_by), "configuration": {}, "createdTime": now}})
        if there and overwrite:
            lines += [{"remove": {"path": r.path, "deletionTimestamp": now, "dataChange": True}} for r in live_files(spark, path).collect()]
        try:
            fs, target = _fs(spark, f"{path}/_delta_log/{version:020d}.json")
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if "exist" not in str(e).lower():
                raise
            continue
        out.write(bytearray(("\n".join(json.dumps(x) for x in [*lines, *adds]) + "\n").encode()))
        out.close()
        return version


def checkpoint(spark: SparkSession, path: str) -> int:
    """Write the latest version's state as one file, so that readers need no log before it; gives the version."""
    version = versions(spark, path)[-1]
    every = actions(spark, path, version)
    adds = every.where("add IS NOT NULL").withColumn("path", F.col("add.path")).join(live_files(spark, path, version).select("path"), "path", "left_semi")
    adds = adds.groupBy("path").agg(F.max_by("add", "version").alias("add"))
    meta = every.where("metaData IS NOT NULL").agg(F.max_by("metaData", "version").alias("metaData"))
    state = adds.select("add").unionByName(meta, allowMissingColumns=True).withColumn("remove", F.lit(None).cast("struct<path:string,deletionTimestamp:bigint,dataChange:boolean>"))
    temporary = f"{path}/_delta_log/_new-{uuid.uuid4().hex}"
    state.coalesce(1).write.parquet(temporary)
    fs, folder = _fs(spark, temporary)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.rename(part, _fs(spark, f"{path}/_delta_log/{version:020d}.checkpoint.parquet")[1])
    fs.delete(folder, True)
    return version
