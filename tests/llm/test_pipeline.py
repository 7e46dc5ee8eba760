import corpus_pipeline
import numpy as np
from test_decontaminate import brute as hits
from test_packing import expected
from test_secrets import ASSIGN
from test_simhash import closure, fingerprint

from marlstone.llm.common import scratch


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), "test")
        yield before.collect(), docs.collect(), docs.columns


def test_each_stage_against_brute_force(spark, sf_dir):
    got = list(stages(spark, sf_dir))
    assert len(corpus_pipeline.STAGES) == 5 and all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, c in got[:-1])
    before, after, _ = got[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after, _ = got[1]
    comp = closure({r.doc_id: fingerprint(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(comp.values())) and len(after) < len(before)
    before, after, _ = got[2]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    clean = {h[0] for h in hits([(r.doc_id, r.text) for r in before], items) if not h[-1]}
    assert {r.doc_id for r in after} == clean and len(after) < len(before)
    before, after, _ = got[3]
    old = {r.doc_id: r for r in before}
    assert {r.doc_id for r in after} == set(old)
    for r in after:
        assert r.n_chars == len(r.text)
        assert r.text == old[r.doc_id].text or "[SECRET]" in r.text
        assert not [m for m in ASSIGN.finditer(r.text) if len(m[2]) >= 16]
    before, after, _ = got[4]
    assert {r.doc_id: r.doc_tokens for r in after} == {r.doc_id: len(expected(r.text)) for r in before}
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in final) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in after)


def test_odd_and_empty(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch(stage(spark, docs, odd_dir), "test")
        assert docs.columns == spark.read.parquet(f"{odd_dir}/documents.parquet").columns
    assert {r.doc_id for r in docs.collect()} <= {4, 5, 6, 8, 9, 10, None}
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    assert np.isfinite(sum(r.length for r in corpus_pipeline.run(spark, odd_dir).collect()))
