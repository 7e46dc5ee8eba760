"""Projection, filters, sorting, sets, missing values, joins, subqueries and windows, in DataFrame form or SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators import aggregates, joins, relational, windows
from marlstone.plans.registry import both, query
from marlstone.sources.readers import direct, shared, table


@query("project_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 400000) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), F.upper("o_orderpriority").alias("priority"))


@query("columns_added_renamed_dropped", "SELECT c_custkey AS id, c_name, c_mktsegment, round(c_acctbal + 1, 2) AS c_acctbal, c_acctbal < 0 AS owes FROM customer")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.withColumns({"owes": F.col("c_acctbal") < 0, "c_acctbal": F.round(F.col("c_acctbal") + 1, 2)}).withColumnsRenamed({"c_custkey": "id"}).drop("c_nationkey")


@query("to_df_and_alias", "SELECT r_regionkey AS k, r_name AS n FROM region")
def _(spark, sf_dir):
    return table(spark, sf_dir, "region").toDF("k", "n").alias("r").select("r.k", "r.n")


@query("unpivot", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return relational.melt(df, ["p_partkey"])


MISSING = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind FROM events)"


def _missing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END").alias("v"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END").alias("kind"))


query("na_fill", f"SELECT event_id, coalesce(v, -1.0) AS v, coalesce(kind, 'none') AS kind FROM {MISSING} t")(lambda s, d: relational.fill_missing(_missing(s, d), {"v": -1.0, "kind": "none"}))
query("na_drop_any", f"SELECT * FROM {MISSING} t WHERE v IS NOT NULL AND kind IS NOT NULL")(lambda s, d: relational.drop_missing(_missing(s, d)))
query("na_drop_threshold", f"SELECT * FROM {MISSING} t WHERE v IS NOT NULL OR kind IS NOT NULL")(lambda s, d: relational.drop_missing(_missing(s, d), at_least=2))
query("na_replace", f"SELECT event_id, v, CASE kind WHEN 'view' THEN 'seen' WHEN 'click' THEN 'hit' ELSE kind END AS kind FROM {MISSING} t")(lambda s, d: relational.replace_values(_missing(s, d), {"view": "seen", "click": "hit"}, ["kind"]))
query(
    "describe_columns",
    """SELECT 'value' AS column_name, CAST(count(value) AS DOUBLE) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events
    UNION ALL SELECT 'user_id', CAST(count(user_id) AS DOUBLE), round(avg(user_id), 6), round(stddev_samp(user_id), 6), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events""",
)(lambda s, d: relational.describe_long(table(s, d, "events"), ["value", "user_id"]).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}))
query("crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")(
    lambda s, d: relational.cross_counts(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
)
query("drop_duplicates_subset", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")(
    lambda s, d: relational.latest(table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])
)
query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())
query("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25))
query("tail_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7")(
    lambda s, d: relational.last_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 7, [F.asc("o_totalprice"), F.asc("o_orderkey")], [F.desc("o_totalprice"), F.desc("o_orderkey")])
)
query("range_rows", "SELECT range AS id, range * range AS square FROM range(0, 1000, 7)")(lambda s, d: s.range(0, 1000, 7).select("id", (F.col("id") * F.col("id")).alias("square")))
query("sql_on_file", "SELECT count(*) AS n FROM events")(lambda s, d: direct(s, "parquet", f"{d}/events.parquet").agg(F.count("*").alias("n")))
query("inline_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")(lambda s, d: s.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
query("repartition_by_key", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")(lambda s, d: table(s, d, "events").repartition("user_id").groupBy("user_id").agg(F.count("*").alias("n")))
query("sort_within_partitions", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").sortWithinPartitions("n_name"))

# ---- joins --------------------------------------------------------------------------------------

for _how in ("inner", "left", "right", "full"):

    def _build(spark, sf_dir, how=_how):
        return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")

    query(f"join_{_how}", f"SELECT c_custkey, o_orderkey FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey")(_build)

both("join_left_semi", "customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
both("join_left_anti", "customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
both("join_cross_small", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_natural", "region", "SELECT r_regionkey, r_name, w FROM region NATURAL JOIN (SELECT 1 AS r_regionkey, 'x' AS w) t")
both("join_lateral", "nation region", "SELECT r_name, n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t")
both("join_theta", "nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
both("join_comma", "nation region", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_NS = """SELECT count(*) AS n FROM (SELECT CASE WHEN event_id < 5 THEN NULL ELSE user_id END AS u FROM events) a
    JOIN (SELECT CASE WHEN event_id < 3 THEN NULL ELSE user_id END AS u FROM events) b ON a.u {same} b.u"""
both("join_null_safe", "events", _NS.format(same="<=>"), _NS.format(same="IS NOT DISTINCT FROM"))
query("join_using", "SELECT event_id, a.user_id, n FROM events a JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) b USING (user_id)")(
    lambda s, d: table(s, d, "events").select("event_id", "user_id").join(table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])
)
query("join_self", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda s, d: (n := table(s, d, "nation")).alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))
)
_TOTALS = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
for _strategy in ("merge", "shuffle_hash", "broadcast"):
    query(f"join_hint_{_strategy}", _TOTALS)(
        lambda s, d, how=_strategy: table(s, d, "customer").join(joins.with_strategy(table(s, d, "nation"), how), F.expr("n_nationkey = c_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    )
query("join_salted", "SELECT event_type, count(*) AS n FROM events JOIN (SELECT DISTINCT event_type AS t FROM events) k ON event_type = t GROUP BY event_type")(
    lambda s, d: joins.salted(table(s, d, "events"), table(s, d, "events").select("event_type").distinct(), ["event_type"], 8).groupBy("event_type").agg(F.count("*").alias("n"))
)
query(
    "join_as_of",
    """SELECT p.event_id, v.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)(lambda s, d: joins.as_of(table(s, d, "events").where("event_type = 'purchase'"), table(s, d, "events").where("event_type = 'view'").withColumnRenamed("value", "last_value"), ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value"))
query(
    "join_range",
    "SELECT p_partkey, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS low, p_size + 0.05 AS high FROM part) r ON value >= low AND value < high GROUP BY p_partkey",
)(
    # ranges start at whole numbers and are shorter than 1, so a point lies in one distinct range at most
    lambda s, d: joins.totals_in_range(table(s, d, "events"), table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("low"), F.expr("p_size + 0.05D").alias("high")), "value", "low", "high", 1.0, "event_id")
    .groupBy("p_partkey").agg(F.sum("n").alias("n"), F.sum("total").alias("ids"))
)

# ---- set operations -----------------------------------------------------------------------------

_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'"
for _name, _op in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    both(f"set_{_name}", "orders", f"{_A} {_op} {_B}")
both("set_minus", "orders", f"{_A} MINUS {_B}", f"{_A} EXCEPT {_B}")
both("set_count_over_chain", "orders", f"SELECT count(*) AS n FROM ({_A} INTERSECT {_B} INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') t")
both("set_union_of_aggregates", "orders lineitem", "SELECT 'orders' AS what, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem")
query("set_union_by_name", "SELECT n_name AS name, n_nationkey AS k, NULL AS r FROM nation UNION ALL SELECT r_name, r_regionkey, r_name FROM region")(
    lambda s, d: table(s, d, "nation").selectExpr("n_name AS name", "n_nationkey AS k").unionByName(table(s, d, "region").selectExpr("r_regionkey AS k", "r_name AS name", "r_name AS r"), True)
)

# ---- subqueries ---------------------------------------------------------------------------------

both("subquery_scalar_in_projection", "orders", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT round(avg(o_totalprice), 4) FROM orders WHERE o_orderstatus = 'O') AS o")
both("subquery_correlated_count", "nation customer", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS n FROM nation")
both("subquery_exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
both("subquery_not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("subquery_not_in_with_null", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)")
both("subquery_in_grouped", "orders lineitem", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 8)")
both("subquery_equals_max_of_derived", "lineitem", "SELECT l_suppkey, q FROM (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t WHERE q = (SELECT max(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) u)")
both("subquery_having_threshold", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 2.0 * avg(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) x)")
both("subquery_full_outer_of_aggregates", "orders", """SELECT count(*) AS n, CAST(sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) b ON a.k = b.k""")
both("subquery_rollup_over_union", "orders customer", """SELECT what, part, count(*) AS n FROM (SELECT 'o' AS what, o_orderpriority AS part FROM orders UNION ALL SELECT 'c', c_mktsegment FROM customer) t GROUP BY ROLLUP (what, part)""")
both("cte_chain", "orders customer", """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
    SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
both("cte_recursive", "region", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")

# ---- windows ------------------------------------------------------------------------------------

_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_RANK = {"row_number": "row_number()", "rank": "rank()", "dense_rank": "dense_rank()", "ntile": "ntile(4)"}
for _name, _f in _RANK.items():
    both(f"window_{_name}", "orders", f"SELECT o_orderkey, CAST({_f} OVER (PARTITION BY o_custkey ORDER BY o_orderpriority{', o_orderkey' if _name in ('row_number', 'ntile') else ''}) AS BIGINT) AS r FROM orders")
for _name in ("percent_rank", "cume_dist"):
    both(f"window_{_name}", "orders", f"SELECT o_orderkey, round({_name}() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 8) AS r FROM orders")
both("window_lag_lead", "orders", f"SELECT o_orderkey, lag(o_totalprice) {_OVER}) AS before, lead(o_totalprice, 2, -1.0) {_OVER}) AS after FROM orders")
both("window_first_last_nth", "orders", f"SELECT o_orderkey, first_value(o_orderkey) {_OVER}) AS f, last_value(o_orderkey) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) {_OVER}) AS s FROM orders")
both("window_ignore_nulls", "events", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events",
     "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events")
both("window_running_sum", "orders", f"SELECT o_orderkey, round(sum(o_totalprice) {_OVER}), 2) AS total, count(*) {_OVER}) AS n FROM orders")
both("window_rows_frame", "orders", f"SELECT o_orderkey, round(avg(o_totalprice) {_OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near FROM orders")
both("window_range_frame", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM events")
both("window_range_interval", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS recent FROM orders")
query("window_whole_partition", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share, max(o_totalprice) OVER () AS top FROM orders")(
    # a window over all rows would gather them in one task: its one value is an aggregate, and comes as a scalar
    lambda s, d: (o := table(s, d, "orders")).withColumn("share", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(windows.frame(["o_custkey"], [])), 8)).join(F.broadcast(o.agg(F.max("o_totalprice").alias("top")))).select("o_orderkey", "share", "top")
)
both("window_named", "orders", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, round(sum(o_totalprice) OVER w, 2) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_over_aggregate", "orders", "SELECT o_custkey, o_orderstatus, count(*) AS n, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey, o_orderstatus")
query("window_global_rank", "SELECT s_suppkey, CAST(rank() OVER (ORDER BY s_acctbal DESC) AS BIGINT) AS r FROM supplier")(
    lambda s, d: windows.global_rank(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal")], "r", shared(s, "ranks")).select("s_suppkey", "r")
)
both("window_ranked_union", "orders lineitem", """SELECT what, k, r FROM (SELECT 'o' AS what, o_custkey AS k, CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey
    UNION ALL SELECT 's', l_suppkey, CAST(rank() OVER (ORDER BY sum(l_quantity) DESC) AS BIGINT) FROM lineitem GROUP BY l_suppkey) t WHERE r <= 10""")
both("window_qualify_top_n", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3")
query(
    "window_sessions",
    """SELECT user_id, s AS session, count(*) AS n FROM (SELECT user_id, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events) t) u GROUP BY user_id, s""",
)(lambda s, d: windows.sessions(table(s, d, "events"), ["user_id"], "ts", 6 * 3600, ["event_id"]).groupBy("user_id", "session").agg(F.count("*").alias("n")))
query(
    "window_islands",
    """SELECT l_suppkey, min(x) AS first, max(x) AS last, count(*) AS size FROM (SELECT l_suppkey, x, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS g
    FROM (SELECT DISTINCT l_suppkey, l_orderkey AS x FROM lineitem) t) u GROUP BY l_suppkey, g""",
)(lambda s, d: windows.islands(table(s, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("x")), ["l_suppkey"], "x"))
query("window_frame_api", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.max("value").over(windows.frame(["user_id"], ["ts", "event_id"], rows=(-3, -1))).alias("m"))
)

# ---- predicates ---------------------------------------------------------------------------------

both("predicate_between", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 950 AND 1000")
both("predicate_distinct_from", "events", "SELECT event_id FROM events WHERE (CASE WHEN event_id % 2 = 0 THEN event_type END) IS DISTINCT FROM 'view'")
both("predicate_like", "part", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%_izmo'")
both("predicate_ilike", "part", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'BRAND#1_'")
both("predicate_like_any_all", "part", "SELECT p_partkey FROM part WHERE p_name LIKE ANY ('red%', '%bolt') AND p_name NOT LIKE ALL ('%x%', '%y%')", "SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE '%bolt') AND p_name NOT LIKE '%x%' AND p_name NOT LIKE '%y%'")
both("predicate_case", "events", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band FROM events")
both("predicate_null_logic", "events", "SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN value END) IS NULL AS missing, NOT (value > 10 AND user_id < 50) AS other FROM events")
both("operators_arithmetic", "events", "SELECT event_id, event_id + user_id AS a, event_id - user_id AS b, event_id * user_id AS c, round(value / (user_id + 1), 8) AS d, event_id % 7 AS e, -event_id AS f FROM events")
both("order_nulls", "events", "SELECT event_id, k FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS k FROM events) t ORDER BY k ASC NULLS LAST, event_id LIMIT 50")
