import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm.packing import first_fit_decreasing, op1_pack, pack_documents, sequences


def expected(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_first_bin_with_room(seed):
    sizes = np.sort(np.random.default_rng(seed).integers(1, 101, 200))[::-1]
    room, want = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(100)
        room[k] -= s
        want.append(k)
    assert first_fit_decreasing(sizes, 100).tolist() == want


def test_every_token_lies_in_one_place(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    rows = op1_pack(spark, odd_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length <= 1024
    for doc_id, text in {(t.doc_id, t.text) for t in texts}:
        ids = np.array(expected(text), "<u4")
        copies = sum(t.doc_id == doc_id for t in texts)
        assert sum(r.length for r in by[doc_id]) == copies * len(ids)
        for r in by[doc_id]:
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_little_padding_and_real_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, group_docs=100).cache()
    tokens = packed.agg({"length": "sum"}).first()[0]
    whole = sequences(packed)
    n = whole.count()
    assert n * 1024 / tokens < 1.03
    row = whole.first()
    assert len(row.ids) == 4 * row.tokens


def test_special_strings_and_empty_table(spark, empty_dir):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert np.frombuffer(pack_documents(docs).first().ids, "<u4").tolist() == expected("a <|endoftext|> b")
    assert op1_pack(spark, empty_dir).collect() == []


def test_long_runs_of_blanks(spark, tmp_path):
    texts = ["a" + " " * 1_100_000 + "b", "\n" * 1_500_000, " \t" * 30_000 + "<|endoftext|>" + "　" * 30_000 + "x " + "\x85" * 25_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for r in pack_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")).orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {k: expected(t) for k, t in enumerate(texts)}


def test_equal_rows_without_ids_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000, "doc_id long, text string")
    rows = pack_documents(docs, group_docs=100).collect()
    of = {}
    for r in rows:
        of[r.sequence_id >> 32] = of.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 3000 and len(of) == 30 and max(of.values()) < 200
