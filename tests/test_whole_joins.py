"""The joins over whole tables against plain Python: no row is left out."""

from collections import Counter

import pytest

from marlstone.plans.registry import QUERIES, load

load()


@pytest.fixture(scope="module")
def read(spark, sf_dir):
    return lambda name, *columns: list(map(tuple, spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_equi_joins(spark, sf_dir, read, how):
    customers, orders = {c for (c,) in read("customer", "c_custkey")}, read("orders", "o_custkey", "o_orderkey")
    want = Counter((c, o) for c, o in orders if c in customers)
    if how in ("left", "full"):
        want.update((c, None) for c in customers - {c for c, _ in orders})
    if how in ("right", "full"):
        want.update((None, o) for c, o in orders if c not in customers)
    assert Counter(map(tuple, QUERIES[f"join_{how}"](spark, sf_dir).collect())) == want and len(want) >= len(orders)


def test_null_safe_join(spark, sf_dir, read):
    events = read("events", "event_id", "user_id")
    a, b = (Counter(None if e < low else u for e, u in events) for low in (5, 3))
    assert QUERIES["join_null_safe"](spark, sf_dir).first().n == sum(n * b[u] for u, n in a.items())


def test_range_join(spark, sf_dir, read):
    events, want = read("events", "event_id", "value"), {}
    for part, size in read("part", "p_partkey", "p_size"):
        if own := [e for e, v in events if v is not None and size <= v < size + 0.05]:
            want[part] = (len(own), sum(own))
    assert {r.p_partkey: (r.n, r.ids) for r in QUERIES["join_range"](spark, sf_dir).collect()} == want
