"""Decision-support queries over the star schema.

Where the tables lack a column of the published query, another of the same
role takes its place; queries on a missing table keep their shape on others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import both, query
from marlstone.sources.readers import table


@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
        )
    )


SQL = {
    # the least retail price among the suppliers' parts of a type, by a correlated minimum (shape of query 2)
    "tpch_q2_shape": ("part lineitem supplier", """SELECT DISTINCT p.p_partkey, p.p_name, s.s_suppkey, l.l_extendedprice AS best_price
        FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
        WHERE p.p_type = 'PROMO' AND p.p_size < 10 AND l.l_extendedprice = (SELECT min(m.l_extendedprice) FROM lineitem m WHERE m.l_partkey = p.p_partkey)"""),
    "tpch_q3": ("customer orders lineitem", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""),
    "tpch_q4": ("orders lineitem", """SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority"""),
    "tpch_q5": ("customer orders lineitem supplier nation region", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
        WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name"""),
    "tpch_q6": ("lineitem", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""),
    "tpch_q7": ("supplier lineitem orders customer nation", """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
        SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
        WHERE (a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1')) v GROUP BY supp_nation, cust_nation, l_year"""),
    "tpch_q8": ("part supplier lineitem orders customer nation region", """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
        SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, sn.n_name AS nation
        FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region ON r_regionkey = cn.n_regionkey JOIN nation sn ON sn.n_nationkey = s_nationkey
        WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') x GROUP BY o_year"""),
    # profit by nation and year over a name pattern, with a stand-in for the supply cost (shape of query 9)
    "tpch_q9_shape": ("part lineitem supplier orders nation", """SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year,
        round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 2) AS sum_profit
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey
        WHERE p_name LIKE '%ring%' GROUP BY n_name, extract(year FROM o_orderdate)"""),
    "tpch_q10": ("customer orders lineitem nation", """SELECT c_custkey, c_name, n_name, c_acctbal, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
        WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, n_name, c_acctbal ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    # groups above a share of the whole, by an uncorrelated scalar in HAVING (shape of query 11)
    "tpch_q11_shape": ("lineitem supplier nation", """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
        WHERE n_name = 'NATION_7' GROUP BY l_partkey
        HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.002 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7')"""),
    "tpch_q12": ("orders lineitem", """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_linestatus"""),
    "tpch_q13": ("customer orders", """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) x GROUP BY c_count"""),
    "tpch_q14": ("lineitem part", """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'"""),
    "tpch_q15": ("lineitem supplier", """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue
        FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)"""),
    # distinct counts with NOT IN (shape of query 16)
    "tpch_q16_shape": ("part lineitem supplier", """SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS supplier_cnt FROM part JOIN lineitem ON l_partkey = p_partkey
        WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
        AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type"""),
    "tpch_q17": ("lineitem part", """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#23' AND p_type = 'LARGE' AND l_quantity < (SELECT 0.5 * avg(m.l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)"""),
    "tpch_q18": ("customer orders lineitem", """SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
        GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""),
    "tpch_q19": ("lineitem part", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE
        (p_brand = 'Brand#12' AND p_type IN ('SMALL', 'ECONOMY') AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'STANDARD') AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
        OR (p_brand = 'Brand#4' AND p_type IN ('LARGE', 'PROMO') AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)"""),
    # a cascade of IN with a correlated threshold inside (shape of query 20)
    "tpch_q20_shape": ("supplier nation lineitem part", """SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (
        SELECT l.l_suppkey FROM lineitem l WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
        AND l.l_quantity > (SELECT 0.9 * max(m.l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_shipdate >= DATE '1996-01-01'))"""),
    "tpch_q21": ("supplier lineitem orders nation", """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND a.l_returnflag = 'R' AND n_regionkey = 3
        AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R')
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100"""),
    "tpch_q22": ("customer orders", """SELECT substring(c_name, 18, 1) AS code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE substring(c_name, 18, 1) IN ('1', '3', '5') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > DATE '2001-01-01') GROUP BY substring(c_name, 18, 1)"""),
}

for name, (tables, text) in SQL.items():
    both(name, tables, text)
