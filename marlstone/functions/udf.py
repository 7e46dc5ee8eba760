"""User-defined functions: Arrow and pandas scalars, grouped aggregates, table functions, maps over groups and SQL functions.

Prefer built-in expressions; these forms exist for what they can't say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@F.arrow_udf(T.DoubleType())
def discounted(price: pa.Array, discount: pa.Array) -> pa.Array:
    return pc.multiply(price, pc.subtract(1.0, discount))


@F.pandas_udf(T.StringType())
def initials(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else "".join(w[0] for w in x.split()))


@F.pandas_udf(T.DoubleType())
def spread(values: pd.Series) -> float:
    """A grouped aggregate: greatest less least; null without values."""
    return float(values.max() - values.min()) if values.notna().any() else None


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class Words:
    """The words of a text and their places."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str):
    """A row-at-a-time function for SQL, run over Arrow batches; failures raise."""
    return spark.udf.register(name, F.udf(function, returns, useArrow=True))


def register_sql(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL function, inlined by the optimizer."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def top_of_group(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n greatest rows of each group by applyInArrow; a group must fit a task, so keys must not be hot."""

    def take(group: pa.Table) -> pa.Table:
        return group.sort_by([(order, "descending")]).slice(0, n)

    return df.groupBy(key).applyInArrow(take, df.schema)


def count_in_batches(df: DataFrame) -> DataFrame:
    """Row counts of partitions, then their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]})

    return df.mapInArrow(run, "n long").agg(F.sum("n").alias("n"))


class Multiples(DataSource):
    """A Python data source: ids and their multiples, in parts."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_multiples"

    def schema(self) -> str:
        return "id long, v long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return MultiplesReader(int(self.options.get("rows", 10)), int(self.options.get("factor", 2)), int(self.options.get("parts", 1)))


class MultiplesReader(DataSourceReader):
    def __init__(self, rows: int, factor: int, parts: int):
        self.rows, self.factor, self.parts = rows, factor, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k * self.rows // self.parts, (k + 1) * self.rows // self.parts)) for k in range(self.parts)]

    def read(self, partition: InputPartition):  # noqa: ANN201
        a, b = partition.value
        ids = pa.array(range(a, b), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pc.multiply(ids, self.factor)], ["id", "v"])


def counted_together(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of the right side for each left row, by a co-group; a join and a count do the same where that is all that is asked."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return a.select([left_key]).append_column("n", pa.array([b.num_rows] * a.num_rows, pa.int64()))

    return left.groupBy(left_key).cogroup(right.groupBy(right_key)).applyInArrow(run, f"{left_key} {left.schema[left_key].dataType.simpleString()}, n long")
