import hashlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm.substrings import op3_substrings, remove_repeats, stretches


def brute(docs, window=35):
    parts = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in parts for i in range(len(w) - window + 1))
    out = []
    for d, w in parts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op3_substrings(spark, sf_dir).collect()), key=str)
    want = brute(docs)
    assert got == want and 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_odd_and_empty(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op3_substrings(spark, odd_dir).collect()), key=str) == brute(docs)
    assert op3_substrings(spark, empty_dir).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_repeats(spark, seed, tmp_path):
    rng = np.random.default_rng(seed)
    phrase = [" ".join(rng.choice(list("ab"), rng.integers(1, 30))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(phrase, rng.integers(1, 12)))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"), window=12).collect()), key=str) == brute(docs, 12)


@pytest.mark.parametrize("seed", range(20))
def test_equal_windows_have_equal_symbols_and_places(seed):
    rng = np.random.default_rng(seed)
    alphabet = rng.integers(0, 2**64, rng.choice([1, 2, 3, 50]), dtype=np.uint64)
    shared = rng.choice(alphabet, 60)
    count = rng.integers(0, 200, 6)
    words = rng.choice(alphabet, count.sum())
    for begin, n in zip(np.cumsum(count) - count, count):
        if n > 70:
            at = begin + rng.integers(0, n - 60)
            words[at : at + 60] = shared
    window = 20
    doc, lo, n, symbol, _ = stretches(words, count, window)
    begin = np.cumsum(count) - count
    seen = {}
    for d, a, m, s in zip(doc, lo, n, symbol):
        for i in range(begin[d] + a, begin[d] + a + m):
            assert seen.setdefault(words[i : i + window].tobytes(), s) == s
    assert n.sum() == np.maximum(0, count - window + 1).sum()
