"""Work and memory of queries that failed on larger tables: they follow the input, at the results of plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import joins, windows
from marlstone.plans import engines
from marlstone.plans.registry import QUERIES, load
from marlstone.streaming import pipeline as streams

load()


def nodes(node) -> list:
    """Nodes of an executed plan, of all its stages."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return nodes(node.plan())
    return [node, *(x for k in range(node.children().size()) for x in nodes(node.children().apply(k)))]


def executed(df) -> list:
    return nodes(df._jdf.queryExecution().executedPlan())


def test_range_join_builds_no_pairs_of_rows(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("event_id"), F.lit(7.01).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(300).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["join_range"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(p, 400, sum(range(400))) for p in range(300)]
    made = [n.metrics().apply("numOutputRows").value() for n in executed(df) if "Join" in n.getClass().getSimpleName()]
    assert made and max(made) <= 700


def test_totals_in_range_equal_nested_loop(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1.0, 1), (1.0, 2), (1.5, None), (-0.0, 4), (nan, 5), (None, 6), (9.9, 7), (2.0, None)], "p double, v long")
    ranges = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 0.0, 1.2), (4, 2.0, 2.1), (5, None, 3.0), (6, 5.0, 5.0), (1, -3.0, 40.0), (7, 50.0, 51.0)], "k int, lo double, hi double")
    brute = points.join(ranges, F.expr("p >= lo AND p < hi")).groupBy("k", "lo", "hi").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    found = joins.totals_in_range(points, ranges, "p", "lo", "hi", 1.0, "v").select(*brute.columns)
    assert sorted(found.collect(), key=str) == sorted(brute.collect(), key=str) and found.count() == 5


@pytest.mark.parametrize("name", ["stream_tumbling_complete", "stream_sliding_complete", "stream_session_complete"])
def test_complete_results_stay_out_of_the_driver(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).inputFiles()


def test_complete_result_is_that_of_the_last_batch(spark, tmp_path):
    for k, (user, time) in enumerate([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 07:00:00"), (1, "2024-01-01 12:00:00")]):
        spark.createDataFrame([(user, time)], "u int, t string").select("u", F.col("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = streams.timed(streams.read_files(spark, f"{tmp_path}/in/*", "u int, ts timestamp_ntz", per_trigger=1), "ts", "1 day")
    found = engines.in_whole(spark, streams.session_counts(read, "ts", "6 hours", ["u"]), "batches").select("u", "n", F.hour("start"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 12), (1, 2, 0), (2, 1, 7)]


def test_islands_hold_no_table_of_rows(spark, sf_dir):
    df = QUERIES["window_islands"](spark, sf_dir)
    df.collect()
    kinds = [n.getClass().getSimpleName() for n in executed(df)]
    assert "WindowExec" in kinds and "SortExec" in kinds and not any("Aggregate" in k for k in kinds)
    assert kinds.count("ShuffleExchangeExec") == kinds.count("SortExec") == 1


def test_large_islands_are_dealt_by_their_size(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, QUERIES["window_islands"](spark, sf_dir).collect()))
    monkeypatch.setattr(windows, "TASK_BYTES", 1 << 10)
    df = QUERIES["window_islands"](spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == whole
    assert df.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_islands_equal_plain_python(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([*range(-9, 30), None])) for _ in range(90)] + [(4, None), (4, None), (5, 7), (5, 7), (5, 8), (6, 2**63 - 1), (6, 2**63 - 1)]
    want, numbers = [], defaultdict(set)
    for k, x in rows:
        numbers[k].add(x)
    for k, xs in numbers.items():
        want += [(k, None, None, 1)] * (None in xs)
        for x in sorted(xs - {None}):
            if x - 1 not in xs:
                last = next(y for y in range(x, 2**63) if y + 1 not in xs)
                want.append((k, x, last, last - x + 1))
    found = windows.islands(spark.createDataFrame(rows, "k int, x long"), ["k"], "x")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
