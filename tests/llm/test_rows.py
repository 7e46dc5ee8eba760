"""Row numbers must name the same rows in every job, though each job may split the scan in its own way."""

import hashlib

import pytest
from test_substrings import brute

from marlstone.llm import secrets, simhash, substrings
from marlstone.llm.common import with_row

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def resplit(spark, monkeypatch):
    """After each scratch table the next jobs split their scans otherwise."""
    old, sizes = {k: spark.conf.get(k) for k in KEYS}, [("128m", "4m"), ("8k", "1k"), ("20k", "1k")]
    turn = iter(range(10**6))

    def change():
        for k, v in zip(KEYS, sizes[next(turn) % len(sizes)]):
            spark.conf.set(k, v)

    for module in (substrings, simhash, secrets):

        def scratch(df, name, write=module.scratch):
            out = write(df, name)
            change()
            return out

        monkeypatch.setattr(module, "scratch", scratch)
    yield change
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def docs(spark, sf_dir, tmp_path):
    """Documents in files of several sizes, with a key in each and a few ids and texts that repeat."""
    read = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120)
    rows = [(r.doc_id, f"{r.text} password = 'Zx9{r.doc_id:05d}kQ7wLm2vRt8'", r.lang, r.source) for r in read.collect()]
    for k, part in enumerate((rows[:7], rows[7:60], rows[60:62], rows[62:] + rows[:5])):
        spark.createDataFrame(part, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/docs/k={k}")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_numbers_do_not_depend_on_splits(spark, docs, resplit):
    numbered, seen = with_row(docs), []
    for _ in range(3):
        resplit()
        seen.append({r.row: (r.doc_id, r.text) for r in numbered.collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == docs.count()


def test_rows_of_no_single_scan(spark, docs, resplit):
    both = docs.select("doc_id").join(docs.select("doc_id", "k"), "doc_id").unionByName(docs.select("doc_id", "k"))
    for rows in (both, spark.range(50).selectExpr("id AS doc_id", "1 AS k")):
        numbers = [r.row for r in with_row(rows).collect()]
        assert len(set(numbers)) == len(numbers) == rows.count()


def test_substrings(docs, resplit):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = substrings.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str) == want


def test_near_dedup_keeps_one_row_of_each_component(docs, resplit):
    want = {r.component for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(want)


def test_secrets_are_cut_from_their_own_rows(docs, resplit):
    want = sorted((r.doc_id, r.text) for r in secrets.redact(docs.coalesce(1)).collect())
    got = sorted((r.doc_id, r.text) for r in secrets.redact(docs).collect())
    assert got == want and sum("[SECRET]" in t for _, t in got) > 100
