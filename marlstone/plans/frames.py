"""DataFrame forms that discover their columns, overflow and order-sensitive functions, sorting in partitions, streams under control, Python sources."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import udf
from marlstone.operators import windows
from marlstone.plans.engines import event_stream
from marlstone.plans.registry import both, query
from marlstone.sources.readers import shared, table
from marlstone.streaming import pipeline as streams

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_BY_PRIORITY = ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES)
query("pivot_discovered", f"SELECT o_orderstatus, {_BY_PRIORITY} FROM orders GROUP BY 1")(lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority").count().na.fill(0))
query("crosstab_discovered", f"SELECT o_orderstatus AS o_orderstatus_o_orderpriority, {_BY_PRIORITY} FROM orders GROUP BY 1")(lambda s, d: table(s, d, "orders").crosstab("o_orderstatus", "o_orderpriority"))
query(
    "summary_columns",
    """SELECT * FROM (SELECT 'count' AS summary, CAST(count(user_id) AS VARCHAR) AS user_id, CAST(count(event_type) AS VARCHAR) AS event_type FROM events UNION ALL SELECT 'min', CAST(min(user_id) AS VARCHAR), min(event_type) FROM events
    UNION ALL SELECT 'max', CAST(max(user_id) AS VARCHAR), max(event_type) FROM events) t""",
)(lambda s, d: table(s, d, "events").select("user_id", "event_type").summary("count", "min", "max"))
query("summary_quartiles", "SELECT true AS within, 3 AS n FROM events LIMIT 1")(lambda s, d: _quartiles(table(s, d, "events").select("user_id")))


def _quartiles(df: DataFrame) -> DataFrame:
    """Whether each approximate quartile of summary() lies within its guaranteed rank error (1/10000) of the exact one."""
    found = df.summary("25%", "50%", "75%").select(F.regexp_replace("summary", "%", "").cast("double").alias("p"), F.col("user_id").cast("double").alias("q"))
    ranks = found.join(df).groupBy("p").agg(F.count_if(F.expr("user_id < q")).alias("below"), F.count_if(F.expr("user_id <= q")).alias("upto"), F.count("*").alias("n"))
    ok = (F.col("below") <= (F.col("p") / 100 + 1e-4) * F.col("n") + 1) & (F.col("upto") >= (F.col("p") / 100 - 1e-4) * F.col("n") - 1)
    return ranks.agg(F.bool_and(ok).alias("within"), F.count("*").cast("int").alias("n"))


query("transpose", "SELECT 'r_regionkey' AS key, " + ", ".join(f"max(CASE WHEN r_name = '{n}' THEN r_regionkey END) AS \"{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region")(
    lambda s, d: table(s, d, "region").select("r_name", "r_regionkey").transpose("r_name")
)

# ---- functions over columns -------------------------------------------------------------------------

_TYPES = ("view", "signup", "click", "error", "purchase")
both("fn_json_tuple", "events", "SELECT event_id, a, b FROM events LATERAL VIEW json_tuple(props, 'k', 'none') t AS a, b", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.none') AS b FROM events")
both("fn_crc32", "events", "SELECT event_id, crc32(CAST(event_type AS BINARY)) AS v FROM events", "SELECT event_id, CAST(CASE event_type " + " ".join(f"WHEN '{t}' THEN {zlib.crc32(t.encode())}" for t in _TYPES) + " END AS BIGINT) AS v FROM events")
both("fn_luhn_check", "events", "SELECT event_id, luhn_check(CAST(event_id AS STRING)) AS v FROM events",
     "SELECT event_id, list_sum([(CASE WHEN i % 2 = 1 THEN x ELSE 2 * x - 9 * CAST(x > 4 AS INTEGER) END) FOR x, i IN [CAST(c AS INTEGER) FOR c IN string_split(reverse(CAST(event_id AS VARCHAR)), '')]]) % 10 = 0 AS v FROM events")
both("fn_months_between", "events", "SELECT event_id, CAST(months_between(trunc(ts, 'MM'), DATE '2020-01-01') AS BIGINT) AS v FROM events", "SELECT event_id, datediff('month', DATE '2020-01-01', CAST(ts AS DATE)) AS v FROM events")
both("fn_sequence", "events", "SELECT event_id, sequence(1L, 1 + user_id % 4) AS v FROM events", "SELECT event_id, range(1, 2 + user_id % 4) AS v FROM events")
both("fn_space", "events", "SELECT event_id, concat('a', space(CAST(user_id % 4 AS INT)), 'b') AS v FROM events", "SELECT event_id, concat('a', repeat(' ', user_id % 4), 'b') AS v FROM events")
both("fn_try_to_binary", "events", "SELECT event_id, decode(try_to_binary(CASE WHEN event_id % 2 = 0 THEN hex(event_type) ELSE 'zz' END, 'hex'), 'UTF-8') AS v FROM events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS v FROM events")
both("fn_to_binary_forms", "events", "SELECT event_id, decode(to_binary(base64(CAST(event_type AS BINARY)), 'base64'), 'UTF-8') AS a, decode(to_binary(event_type, 'utf-8'), 'UTF-8') AS b, decode(to_binary(hex(event_type), 'hex'), 'UTF-8') AS c FROM events", "SELECT event_id, event_type AS a, event_type AS b, event_type AS c FROM events")
both("fn_soundex", "events", "SELECT DISTINCT soundex(concat('Robert', event_type)) LIKE 'R163' OR soundex(event_type) RLIKE '^[A-Z][0-9]{3}$' AS v, left(soundex(event_type), 1) AS first FROM events", "SELECT DISTINCT true AS v, upper(left(event_type, 1)) AS first FROM events")
both("agg_try_sum_overflow", "events", "SELECT event_type, try_sum(CASE WHEN event_type = 'click' THEN 9223372036854775807 ELSE user_id END) AS v FROM events GROUP BY event_type", "SELECT event_type, CASE WHEN event_type <> 'click' THEN CAST(sum(user_id) AS BIGINT) END AS v FROM events GROUP BY event_type")
both("agg_try_avg_overflow", "events", "SELECT event_type, try_avg(CASE WHEN event_type = 'click' THEN make_ym_interval(178956970, 7) ELSE make_ym_interval(0, 1) END) IS NULL AS v FROM events GROUP BY event_type", "SELECT event_type, event_type = 'click' AS v FROM events GROUP BY event_type")
both("agg_first_and_last", "events", "SELECT event_type, first(event_type) AS a, last(event_type) AS b, first(CASE WHEN event_id % 3 = 0 THEN event_type END, true) AS c FROM events GROUP BY event_type", "SELECT event_type, event_type AS a, event_type AS b, event_type AS c FROM events GROUP BY event_type")
both("agg_listagg_ordered", "events", "SELECT event_type, md5(listagg(CAST(event_id AS STRING), ',') WITHIN GROUP (ORDER BY event_id DESC)) AS v FROM events GROUP BY event_type", "SELECT event_type, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id DESC)) AS v FROM events GROUP BY event_type")
both("agg_collect_set_values", "events", "SELECT user_id, sort_array(collect_set(event_type)) AS v FROM events GROUP BY user_id", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS v FROM events GROUP BY user_id")

# ---- order within partitions ------------------------------------------------------------------------


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Whether each partition holds its rows in the order of key, by their places in it."""
    placed = df.withColumns({"pid": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    before = F.lag(key).over(W.partitionBy("pid").orderBy("place"))
    return placed.withColumn("ok", F.coalesce(before <= F.col(key), F.lit(True))).agg(F.count("*").alias("n"), F.bool_and("ok").alias("sorted"))


for _name, _clause in {"sort_by": "SORT BY o_totalprice", "distribute_sort_by": "DISTRIBUTE BY o_custkey SORT BY o_totalprice", "cluster_by": "CLUSTER BY o_totalprice"}.items():

    def _sorted(spark, sf_dir, clause=_clause):
        table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
        return _in_order(spark.sql(f"SELECT o_custkey, o_totalprice FROM orders {clause}"), "o_totalprice")

    query(f"sort_{_name}", "SELECT count(*) AS n, true AS sorted FROM orders")(_sorted)


@query("distribute_by_co_locates", "SELECT true AS one_place FROM orders LIMIT 1")
def _(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    placed = spark.sql("SELECT o_custkey FROM orders DISTRIBUTE BY o_custkey").withColumn("pid", F.spark_partition_id())
    return placed.groupBy("o_custkey").agg(F.count_distinct("pid").alias("n")).agg((F.max("n") == 1).alias("one_place"))


query("window_rank_by_ranges", "SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority, o_orderdate) AS r FROM orders")(
    lambda s, d: windows.global_rank(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority", "o_orderdate"], "r", shared(s, "ranks")).select("o_orderkey", "r")
)

# ---- streams under control ---------------------------------------------------------------------------


@query("stream_update_mode", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    target = shared(spark, "updated")
    each = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{target}/b{k}")
    counted = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    streams.write(counted, shared(spark, "updated-checkpoint"), mode="update", each=each).awaitTermination()
    return spark.read.parquet(f"{target}/*").groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


@query("stream_watermark_append", "SELECT CAST(start AS TIMESTAMP) AS start, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1) t WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def _(spark, sf_dir):
    closed = streams.windowed_counts(event_stream(spark, sf_dir), "ts", "1 day").select("start", "n")
    return streams.finished(closed, shared(spark, "closed-checkpoint"), shared(spark, "closed")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_processing_time_and_stop", "SELECT count(*) AS n, true AS listed, true AS stopped, count(*) AS read FROM events")
def _(spark, sf_dir):
    target = shared(spark, "timed")
    running = streams.write(event_stream(spark, sf_dir).select("event_id"), shared(spark, "timed-checkpoint"), path=target, every="200 milliseconds", name=f"marlstone_{target[-8:]}")
    running.processAllAvailable()
    listed = any(q.id == running.id for q in spark.streams.active) and spark.streams.get(running.id).name == running.name
    read = sum(p["numInputRows"] for p in running.recentProgress)
    running.stop()
    stopped = not running.isActive and all(q.id != running.id for q in spark.streams.active)
    return spark.read.parquet(target).agg(F.count("*").alias("n")).select("n", F.lit(listed).alias("listed"), F.lit(stopped).alias("stopped"), F.lit(read).cast("long").alias("read"))


@query("stream_rate_source", "SELECT true AS whole, true AS increasing")
def _(spark, sf_dir):
    target = shared(spark, "rate")
    running = streams.write(streams.read_rate(spark, 50), shared(spark, "rate-checkpoint"), path=target, every="100 milliseconds")
    while not running.lastProgress or running.lastProgress["batchId"] < 2:
        running.awaitTermination(0.2)
    running.stop()
    return spark.read.parquet(target).agg(((F.count("*") % 50 == 0) & (F.count("*") >= 100)).alias("whole"), ((F.max("value") + 1 == F.count("*")) & (F.min("value") == 0)).alias("increasing"))


@query("stream_state_by_key", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def _(spark, sf_dir):
    target = shared(spark, "state")
    counted = streams.running_totals(event_stream(spark, sf_dir).select("user_id", "value"), "user_id", "value")
    each = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{target}/b{k}")
    streams.write(counted, shared(spark, "state-checkpoint"), mode="update", each=each).awaitTermination()
    last = spark.read.parquet(f"{target}/*").groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("t"))
    return last.select("user_id", "t.n", F.round("t.total", 2).alias("total"))


# ---- Python sources and co-groups ---------------------------------------------------------------------


@query("udf_data_source", "SELECT range AS id, range * 3 AS v FROM range(0, 1000)")
def _(spark, sf_dir):
    spark.dataSource.register(udf.Multiples)
    return spark.read.format("marlstone_multiples").option("rows", 1000).option("factor", 3).option("parts", 4).load()


@query("udf_cogroup", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return udf.counted_together(c, "c_custkey", o, "o_custkey")
