import numpy as np
import xxhash

from marlstone.llm.common import components
from marlstone.llm.simhash import build_tree, fingerprints, link, link_leaf, near_duplicates, op9_simhash, route


def fingerprint(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(prints):
    ids = sorted(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    return comp


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in docs}
    got = op9_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == closure(prints)
    small = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), leaf=20).collect()
    assert {r.doc_id: r.component for r in small} == closure(prints)


def test_odd_and_empty(spark, odd_dir, empty_dir):
    got = op9_simhash(spark, odd_dir).collect()
    assert len(got) == 12
    zero = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all(r.fingerprint == "0" * 16 and r.component_id == 1 for r in zero)
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert op9_simhash(spark, empty_dir).collect() == []


def test_tree_covers_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (20, 2))])
    fps = np.unique(np.concatenate([base, near]))
    nodes = build_tree(fps, len(fps), leaf=32)
    row, leaf, home = route(nodes, fps)
    assert sorted(row[home].tolist()) == list(range(len(fps))) and len(set(leaf.tolist())) > 1
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in set(leaf.tolist()):
        own = row[leaf == k]
        label = link_leaf(fps[own], home[leaf == k])
        heads = {}
        for a, b in zip(own.tolist(), label.tolist()):
            x, y = find(a), find(heads.setdefault(b, a))
            parent[max(x, y)] = min(x, y)
    want = closure({i: int(f) for i, f in enumerate(fps)})
    got = {i: find(i) for i in range(len(fps))}
    assert len({(want[i], got[i]) for i in got}) == len(set(want.values())) == len(set(got.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_string_ids_and_links_through_rows_without_ids(spark):
    assert dict(components(spark.createDataFrame([("d2", "d1"), ("d2", "d3"), ("x", "y")], "a string, b string")).collect()) == {"d1": "d1", "d2": "d1", "d3": "d1", "x": "x", "y": "x"}
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    docs = spark.createDataFrame([("d9", text), ("d10", text.upper()), (None, text), ("e", "something else altogether"), (None, "no id")], "doc_id string, text string")
    got = near_duplicates(docs).collect()
    assert sorted(r.component or "-" for r in got) == ["-", "d10", "d10", "d10", "e"]


def test_links_through_a_fingerprint_without_id(spark):
    prints = spark.createDataFrame([(0b0000, "a"), (0b0011, None), (0b1111, "b"), (0b11111111 << 20, "c")], "fp long, rep string")
    found = {frozenset(map(tuple, [r])) for r in components(link(prints)).collect()}
    assert {dict(components(link(prints)).collect()).get(x) for x in (0, 3, 15)} == {0} and len(found) == 3


def test_blocks_of_homes_and_visitors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.component for r in near_duplicates(docs).collect()}
    prints = spark.createDataFrame([(r.fp, r.id) for r in fingerprints(docs).dropDuplicates(["fp"]).collect()], "fp long, rep long")
    for leaf, block in ((20, 7), (1 << 20, 40)):
        joined = dict(components(link(prints, leaf=leaf, block=block)).collect())
        groups = {}
        for fp, rep in prints.collect():
            groups.setdefault(joined.get(fp, fp), set()).add(whole[rep])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(whole.values()))
