"""Helpers shared by the operators: scratch tables, byte-bounded batches, components."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python code holds as arrays at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or os.path.join(tempfile.gettempdir(), "marlstone-shared")).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which also cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> bool:
    """Whether the rows of df are those of one Parquet scan, chosen and changed one by one."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation") and plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number for each row that every job computes alike, however it splits the scan.

    In a Parquet scan it is made of the file's number and the row's place in the
    file; any other rows are numbered once and written to the shared folder.
    """
    if not stored(df):
        return scratch(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    path = F.col("_metadata.file_path")
    files = sorted(r[0] for r in df.select(path).distinct().collect())
    at = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "marlstone_file string, marlstone_at long")
    placed = df.select("*", path.alias("marlstone_file"), F.col("_metadata.row_index").alias("marlstone_index"))
    number = F.shiftleft("marlstone_at", 40) + F.col("marlstone_index")
    return placed.join(F.broadcast(at), "marlstone_file").select(*df.columns, number.alias(name))


def forget(df: DataFrame) -> None:
    """Remove the files of a scratch table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/marlstone/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this subpackage's classes to executors that needn't have it; read it with `taken`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def taken(of: Broadcast) -> object:
    """What `share` sent, made once in each worker; only the latest few are kept."""
    kept = sys.__dict__.setdefault("_marlstone_shared", {})
    key = hash(of.value)
    if key not in kept:
        while len(kept) > 1:
            kept.pop(next(iter(kept)))
        kept[key] = cloudpickle.loads(of.value)
    return kept[key]


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of the column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Alternates large-star and small-star rounds, each written to the shared
    folder, until a round leaves every edge as it is; a node's neighbours are
    only ever reduced with min, so no group is gathered.  Nodes may have any type
    that can be ordered.  Nodes without an edge don't appear.  Null ends are ignored.
    """
    current = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    size = current.count()
    while size:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        following = scratch(small, name)
        before, size = size, following.count()
        same = size == before and following.join(current, ["a", "b"], "left_anti").isEmpty()
        forget(current)
        current = following
        if same:
            break
    return current.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that were written out and are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
