"""Registry of relational queries: name, builder and the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.readers import table

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder (spark, sf_dir) -> DataFrame under name."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def both(name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register SQL text over the named tables; oracle: the other engine's text where it must differ."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    query(name, oracle or spark_sql)(build)


def load() -> None:
    """Import the modules that register queries."""
    from marlstone.plans import aggregations, engines, frames, relational, scalars, services, shapes, tpch  # noqa: F401
