"""Streams, user-defined functions, tables, views and catalog statements as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import udf
from marlstone.plans.registry import query
from marlstone.services import statements
from marlstone.sources import sinks
from marlstone.sources.readers import files, shared, table
from marlstone.streaming import pipeline as streams


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 day") -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streams.timed(streams.read_files(spark, f"{sf_dir}/events*.parquet", schema), "ts", delay)


def done(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return streams.finished(df, shared(spark, f"{name}-checkpoint"), shared(spark, name), mode)


def in_whole(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Complete mode: each batch's whole result replaces the one before in files, so none passes through the driver."""
    target = shared(spark, name)
    each = lambda batch, k: batch.write.mode("overwrite").parquet(target)
    streams.write(df, shared(spark, f"{name}-checkpoint"), mode="complete", each=each).awaitTermination()
    return spark.read.schema(df.schema).parquet(target)


query("stream_file_append", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")(lambda s, d: done(s, event_stream(s, d).where("event_type = 'click'").select("event_id", "user_id", "value"), "append"))
query("stream_tumbling_complete", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: in_whole(s, streams.windowed_counts(event_stream(s, d), "ts", "1 day", keys=["event_type"]), "tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
)
query("stream_sliding_complete", "SELECT CAST(b AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS b FROM events) t GROUP BY 1")(
    lambda s, d: in_whole(s, streams.windowed_counts(event_stream(s, d), "ts", "1 day", "12 hours"), "sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
)
query(
    "stream_session_complete",
    """SELECT user_id, count(*) AS n, CAST(min(ts) AS TIMESTAMP) AS start FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events) t) u GROUP BY user_id, s""",
)(lambda s, d: in_whole(s, streams.session_counts(event_stream(s, d), "ts", "6 hours", ["user_id"]), "session").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start")))
query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")(lambda s, d: done(s, streams.deduplicated(event_stream(s, d, "60 days").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type"), "dedup"))
query("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")(lambda s, d: done(s, event_stream(s, d).join(table(s, d, "customer"), F.expr("user_id = c_custkey")).select("event_id", "c_mktsegment"), "static"))
query(
    "stream_stream_join",
    "SELECT a.event_id AS click, b.event_id AS buy FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
)(
    lambda s, d: done(
        s,
        streams.interval_join(
            event_stream(s, d).where("event_type = 'click'").selectExpr("event_id AS click", "user_id AS u", "ts AS t"), event_stream(s, d).where("event_type = 'purchase'").selectExpr("event_id AS buy", "user_id AS v", "ts AS w"),
            "u = v AND w BETWEEN t AND t + INTERVAL 2 HOURS",
        ).select("click", "buy"), "joined",
    )
)


@query("stream_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    target = shared(spark, "each")
    each = lambda batch, k: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={k}")
    streams.write(event_stream(spark, sf_dir), shared(spark, "each-checkpoint"), each=each).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.sum("n").alias("n"))


# ---- user-defined functions -----------------------------------------------------------------------

query("udf_arrow_scalar", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(udf.discounted("l_extendedprice", "l_discount"), 4).alias("net")))
query("udf_pandas_scalar", "SELECT p_partkey, concat(left(p_name, 1), left(split_part(p_name, ' ', 2), 1)) AS i FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", udf.initials("p_name").alias("i")))
query("udf_pandas_aggregate", "SELECT event_type, round(max(value) - min(value), 6) AS v FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(udf.spread("value"), 6).alias("v")))
query("udf_group_map", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) t WHERE r <= 2")(lambda s, d: udf.top_of_group(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2))
query("udf_map_batches", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")(lambda s, d: udf.count_in_batches(table(s, d, "lineitem")))


@query("udf_registered", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(spark, sf_dir):
    udf.register_scalar(spark, "marlstone_twice", lambda x: None if x is None else 2 * x + 1, "int")
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "marlstone_twice(p_size) AS v")


@query("udf_sql_function", "SELECT p_partkey, round(p_retailprice * 1.1, 4) AS v FROM part")
def _(spark, sf_dir):
    udf.register_sql(spark, "marlstone_taxed", "x DOUBLE", "DOUBLE", "x * 1.1D")
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "round(marlstone_taxed(p_retailprice), 4) AS v")


@query("udf_table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(unnest(range(0, len(string_split(p_name, ' ')))) AS INTEGER) AS place FROM part")
def _(spark, sf_dir):
    spark.udtf.register("marlstone_words", udf.Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word, place FROM part, LATERAL marlstone_words(p_name)")


# ---- tables, views and statements -----------------------------------------------------------------

for _fmt in ("parquet", "csv", "json", "orc"):

    def _round_trip(spark, sf_dir, fmt=_fmt):
        df = table(spark, sf_dir, "part")
        return files(spark, fmt, sinks.write_files(df, shared(spark, fmt), fmt, mode="overwrite"), df.schema)

    query(f"sink_{_fmt}", "SELECT * FROM part")(_round_trip)


@query("sink_partitioned", "SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO'")
def _(spark, sf_dir):
    path = sinks.write_files(table(spark, sf_dir, "part"), shared(spark, "partitioned"), partition_by=["p_type"], mode="overwrite")
    return files(spark, "parquet", path).where("p_type = 'PROMO'").select("p_partkey", "p_type")


def fresh(spark: SparkSession, stem: str) -> str:
    return f"marlstone_{stem}_{uuid.uuid4().hex[:12]}"


@query("table_create_insert", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def _(spark, sf_dir):
    name = fresh(spark, "t")
    sinks.create_table(spark, name, "k INT, name STRING", comment="it's a table", properties={"origin": "tests"})
    sinks.insert_into(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), name)
    return spark.table(name)


@query("table_create_as_select", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    return sinks.create_as_select(table(spark, sf_dir, "region"), fresh(spark, "c"))


@query("table_bucketed_join", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, sf_dir):
    c = sinks.create_as_select(table(spark, sf_dir, "customer").select("c_custkey"), fresh(spark, "bc"), bucket_by=(4, ["c_custkey"]))
    o = sinks.create_as_select(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), fresh(spark, "bo"), bucket_by=(4, ["o_custkey"]))
    return c.join(o.hint("merge"), F.expr("c_custkey = o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("view_temporary", "SELECT count(*) AS n FROM region")
def _(spark, sf_dir):
    sinks.temp_view(table(spark, sf_dir, "region"), "marlstone_regions")
    return spark.sql("SELECT count(*) AS n FROM marlstone_regions")


@query("view_global", "SELECT count(*) AS n FROM nation")
def _(spark, sf_dir):
    sinks.temp_view(table(spark, sf_dir, "nation"), "marlstone_nations", global_=True)
    return spark.sql("SELECT count(*) AS n FROM global_temp.marlstone_nations")


@query("catalog_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(col_name, data_type)")
def _(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return statements.describe(spark, "region")


@query("catalog_show_tables", "SELECT 'marlstone_shown' AS \"tableName\", true AS \"isTemporary\"")
def _(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("marlstone_shown")
    return statements.tables(spark, "marlstone_shown")
