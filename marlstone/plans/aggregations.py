"""Aggregate functions and grouping forms, and scans of the events and pages kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import aggregates
from marlstone.plans.registry import both, query
from marlstone.sources.readers import table

#: name -> (Spark expression, DuckDB expression where it differs) over events, by event_type
FUNCTIONS = {
    "count_all": ("count(*)", None), "count_distinct": ("count(DISTINCT user_id)", None), "sum": ("round(sum(value), 4)", None), "sum_distinct": ("CAST(sum(DISTINCT user_id) AS BIGINT)", None),
    "avg": ("round(avg(value), 6)", None), "min_max": ("max(value) - min(value)", None), "count_if": ("count_if(value > 20)", "count(*) FILTER (WHERE value > 20)"),
    "stddev_samp": ("round(stddev_samp(value), 6)", None), "stddev_pop": ("round(stddev_pop(value), 6)", None), "var_samp": ("round(var_samp(value), 5)", None), "var_pop": ("round(var_pop(value), 5)", None),
    "variance": ("round(variance(value), 5)", None), "stddev": ("round(stddev(value), 6)", None),
    "skewness": ("round(skewness(value), 5)", "round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 5)"),
    "kurtosis": ("round(kurtosis(value), 4)", "round((avg(value ** 4) - 4 * avg(value) * avg(value ** 3) + 6 * avg(value) ** 2 * avg(value ** 2) - 3 * avg(value) ** 4) / var_pop(value) ** 2 - 3, 4)"),
    "corr": ("round(corr(value, user_id), 6)", None), "covar_pop": ("round(covar_pop(value, user_id), 4)", None), "covar_samp": ("round(covar_samp(value, user_id), 4)", None),
    "regr_slope": ("round(regr_slope(value, user_id), 6)", None), "regr_intercept": ("round(regr_intercept(value, user_id), 4)", None), "regr_r2": ("round(regr_r2(value, user_id), 6)", None), "regr_count": ("regr_count(value, user_id)", "CAST(regr_count(value, user_id) AS BIGINT)"),
    "regr_avgx": ("round(regr_avgx(value, user_id), 4)", None), "regr_avgy": ("round(regr_avgy(value, user_id), 4)", None), "regr_sxx": ("round(regr_sxx(value, user_id), 2)", None), "regr_sxy": ("round(regr_sxy(value, user_id), 2)", None), "regr_syy": ("round(regr_syy(value, user_id), 2)", None),
    "bit_and": ("bit_and(user_id)", None), "bit_or": ("bit_or(user_id)", None), "bit_xor": ("bit_xor(user_id)", None),
    "bool_and": ("bool_and(value >= 0)", None), "bool_or": ("bool_or(value > 100)", None), "any": ("any(value > 100)", "bool_or(value > 100)"), "some": ("some(value < 0)", "bool_or(value < 0)"), "every": ("every(value < 1000)", "bool_and(value < 1000)"),
    "any_value": ("any_value(event_type, true)", "any_value(event_type)"), "first_last": ("max_by(user_id, event_id) - min_by(user_id, event_id)", "arg_max(user_id, event_id) - arg_min(user_id, event_id)"),
    "max_by": ("max_by(value, event_id)", "arg_max(value, event_id)"), "min_by": ("min_by(value, event_id)", "arg_min(value, event_id)"),
    "mode": ("mode() WITHIN GROUP (ORDER BY user_id)", "(SELECT u FROM (SELECT user_id AS u, count(*) AS c FROM events i WHERE i.event_type = events.event_type GROUP BY 1) ORDER BY c DESC, u LIMIT 1)"),
    "median": ("round(median(value), 6)", None), "percentile": ("round(percentile(value, 0.3), 6)", "round(quantile_cont(value, 0.3), 6)"), "percentile_cont": ("round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6)", None), "percentile_disc": ("percentile_disc(0.25) WITHIN GROUP (ORDER BY value)", None),
    "array_agg": ("array_join(transform(array_sort(array_agg(CAST(round(value * 100) AS BIGINT))), x -> CAST(x AS STRING)), ',')", "list_aggregate(list_sort(list(CAST(round(value * 100) AS BIGINT))), 'string_agg', ',')"),
    "collect_set": ("size(collect_set(user_id))", "CAST(count(DISTINCT user_id) AS INTEGER)"), "listagg": ("length(listagg(event_type, '|'))", "CAST(length(string_agg(event_type, '|')) AS INTEGER)"), "string_agg": ("sha2(string_agg(CAST(event_id AS STRING), ',') WITHIN GROUP (ORDER BY event_id), 256)", "sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id))"),
    "try_sum": ("try_sum(user_id)", "CAST(sum(user_id) AS BIGINT)"), "try_avg": ("round(try_avg(user_id), 6)", "round(avg(user_id), 6)"), "product": ("round(ln(product(1 + value / 1e6)), 6)", "round(ln(product(1 + value / 1e6)), 6)"),
    "filter_clause": ("count(*) FILTER (WHERE user_id < 10)", None), "histogram_of_bits": ("bit_count(bit_or(user_id))", "CAST(bit_count(bit_or(user_id)) AS INTEGER)"), "max_struct": ("max(struct(user_id, event_id)).event_id", "max(struct_pack(u := user_id, e := event_id)).e"),
}
for _name, (_spark, _duck) in FUNCTIONS.items():
    if _name == "product":
        query("agg_product", f"SELECT event_type, {_duck} AS v FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.ln(F.product(1 + F.col("value") / 1e6)), 6).alias("v")))
    elif _name == "mode":
        both("agg_mode", "events", f"SELECT event_type, {_spark} AS v FROM events GROUP BY event_type", "SELECT event_type, u AS v FROM (SELECT event_type, user_id AS u, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) t WHERE r = 1")
    else:
        both(f"agg_{_name}", "events", f"SELECT event_type, {_spark} AS v FROM events GROUP BY event_type", f"SELECT event_type, {_duck or _spark} AS v FROM events GROUP BY event_type")

#: Approximate forms: their results differ between engines, so only that they are near the exact value.
for _name, _close in {
    "approx_count_distinct": "abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id)", "approx_percentile": "approx_percentile(value, 0.5, 10000) BETWEEN percentile_disc(0.499) WITHIN GROUP (ORDER BY value) AND percentile_disc(0.501) WITHIN GROUP (ORDER BY value)",
    "hll_sketch": "abs(hll_sketch_estimate(hll_sketch_agg(user_id)) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id)", "histogram_numeric": "size(histogram_numeric(value, 5)) = 5", "count_min_sketch": "octet_length(count_min_sketch(user_id, 0.01D, 0.95D, 7)) > 0",
}.items():
    both(f"agg_{_name}", "events", f"SELECT event_type, {_close} AS ok FROM events GROUP BY event_type", "SELECT DISTINCT event_type, true AS ok FROM events")

both("group_global", "orders", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
both("group_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("group_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("group_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
query("group_rollup_api", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")(lambda s, d: table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
query("group_cube_api", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
both("group_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
both("group_by_all", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
both("group_by_ordinal_and_alias", "orders", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY y, 2")
both("group_aggregate_of_aggregate", "orders", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
both("group_multi_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(*) AS n FROM lineitem GROUP BY l_returnflag")
both("group_null_keys", "events", "SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS k, count(*) AS n FROM events GROUP BY 1")
both("group_distinct_pairs", "events", "SELECT count(DISTINCT user_id, event_type) AS n FROM events", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
query("group_pivot", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS \"2-HIGH\" FROM orders GROUP BY 1")(
    lambda s, d: aggregates.pivot(table(s, d, "orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "2-HIGH"], F.count(F.lit(1)))
)
query("group_conditional_sums", "SELECT l_returnflag, round(sum(CASE WHEN l_quantity < 10 THEN l_extendedprice END), 2) AS small, round(sum(CASE WHEN l_quantity >= 10 THEN l_extendedprice END), 2) AS large FROM lineitem GROUP BY 1")(
    lambda s, d: aggregates.conditional(table(s, d, "lineitem"), ["l_returnflag"], {"small": (F.col("l_quantity") < 10, F.col("l_extendedprice")), "large": (F.col("l_quantity") >= 10, F.col("l_extendedprice"))}).select("l_returnflag", F.round("small", 2).alias("small"), F.round("large", 2).alias("large"))
)
query("group_salted_sum", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS sum_user_id FROM events GROUP BY event_type")(lambda s, d: aggregates.salted_sum(table(s, d, "events").select("event_type", "event_id", "user_id"), ["event_type"], "user_id"))
query("group_mode_api", "SELECT event_type, u AS v FROM (SELECT event_type, user_id AS u, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) t WHERE r = 1")(
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(aggregates.first_mode("user_id").alias("v"))
)

# ---- scans and top-k over events, pages and documents --------------------------------------------

both("hits_count", "events", "SELECT count(*) AS n FROM events")
both("hits_min_max", "events", "SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events")
both("hits_filtered_count", "events", "SELECT count(*) AS n FROM events WHERE event_type <> 'view' AND value > 10")
both("hits_sum_avg", "events", "SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events")
both("hits_top_users", "events", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
both("hits_top_users_by_type", "events", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
both("hits_users_by_minute", "events", "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, user_id, m LIMIT 10")
both("hits_distinct_per_type", "events", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type")
both("hits_host_regexp", "pages", r"SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, count(*) AS n, round(avg(length(url)), 6) AS len FROM pages GROUP BY 1")
both("hits_like_scan", "pages", "SELECT count(*) AS n FROM pages WHERE url LIKE '%example.com%' AND html LIKE '%<title>%'")
both("hits_group_by_url", "pages", "SELECT url, count(*) AS n FROM pages GROUP BY url ORDER BY n DESC, url LIMIT 10")
both("hits_constant_key", "pages", "SELECT 1 AS one, url, count(*) AS n FROM pages GROUP BY 1, 2 ORDER BY n DESC, url LIMIT 10")
both("hits_wide_sums", "events", "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM events")
both("hits_text_length", "documents", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, CAST(max(n_chars) AS BIGINT) AS top FROM documents GROUP BY lang")
both("hits_top_n_wide", "events", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE props LIKE '%9%' ORDER BY ts, event_id LIMIT 10")
both("hits_by_day", "events", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1")
both("hits_filter_offset", "events", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 100")
