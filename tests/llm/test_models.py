"""Language ID and the quality classifier: held-out accuracy, and odd inputs."""

import numpy as np

from marlstone.llm.language import fit as fit_languages
from marlstone.llm.language import grams, infer, mixture, op10_language
from marlstone.llm.quality import CHUNK, compressors, cut, drawn, features, fit, op4_quality, score

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_and_empty(spark, odd_dir, empty_dir):
    got = {r.doc_id: r for r in op10_language(spark, odd_dir).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[6].lang_pred != "und"
    assert op10_language(spark, empty_dir).collect() == []


def test_mixtures_name_both_languages():
    p = np.array([[0.9, 0.05, 0.3], [0.05, 0.9, 0.3], [0.05, 0.05, 0.4]])
    assert (infer(p, np.array([300.0, 300.0, 10.0])) > 0.3).tolist() == [True, True, False]
    assert (infer(p, np.array([300.0, 5.0, 5.0])) > 0).tolist() == [True, False, False]


def test_mixtures_name_every_language():
    for k in (4, 6):
        p = np.full((k, k), 0.02) + np.eye(k) * (1 - 0.02 * k)
        share = infer(p, np.full(k, 300.0))
        assert (share > 0).all() and np.allclose(share, 1 / k)


def test_mixtures_are_the_best_of_all_sizes():
    rng = np.random.default_rng(2)
    for k in (2, 3, 4, 5):
        for _ in range(60):
            p = rng.dirichlet(np.full(40, 0.4), k).T + 1e-4
            p /= p.sum(axis=0)
            n = rng.multinomial(int(rng.integers(5, 800)), p @ rng.dirichlet(np.full(k, 0.5))).astype(float)
            order, penalty = np.argsort(-mixture(p, n)[0], kind="stable"), 0.5 * np.log(n.sum() + 1)
            value = lambda size: (mixture(p[:, order[:size]], n)[1] if size > 1 else n @ np.log(p[:, order[0]])) - penalty * size  # noqa: B023, E731
            want = max(range(1, k + 1), key=value)
            assert set(np.flatnonzero(infer(p, n))) == set(order[:want])


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = [r for r in op4_quality(spark, SF).join(labels, "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_odd_and_empty(spark, odd_dir, empty_dir):
    got = op4_quality(spark, odd_dir).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert op4_quality(spark, empty_dir).collect() == []


def test_quality_cuts_keep_every_byte():
    rng = np.random.default_rng(4)
    for n in (0, 1, 199, 200, 201, 400, 599, 600, 601, 50_000):
        text = rng.bytes(n)
        assert b"".join(cut(text)) == text and all(len(c) <= CHUNK + CHUNK // 2 for c in cut(text))


def test_quality_trains_on_the_ends_of_long_texts(spark):
    """Good and bad texts that differ only after 40,000 bytes: the dictionaries must hold words of the ends."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(300)]
    ends = {y: ["".join(rng.choice(list("klmnopqr" if y else "stuvwxyz"), 9)) for _ in range(40)] for y in (0, 1)}
    docs = [(i, " ".join(rng.choice(vocabulary, 5000)) + " " + " ".join(rng.choice(ends[i % 2], 1500))) for i in range(60)]
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int"))
    own = {y: sum(w.encode() in model[name] for w in ends[y]) for y, name in ((1, "good"), (0, "bad"))}
    assert own[0] >= 20 and own[1] >= 20


def test_quality_scores_against_a_direct_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    tools = compressors(model["good"], model["bad"])
    scores = {}
    for r in docs.collect():
        text = (r.text or "").encode()
        want = model["share"]
        if text:
            want = 1 / (1 + np.exp(-np.clip((np.array(features(text, tools)) - model["mean"]) / model["scale"] @ model["weights"], -30, 30)))
        assert abs(got[r.doc_id] - want) < 1e-12 and scores.setdefault(text, got[r.doc_id]) == got[r.doc_id]


def test_quality_one_class_no_class_and_equal_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)] + [(1, "text number 1")] * 300, "doc_id long, text string")
    labels = "doc_id long, quality int"
    assert {r.score for r in score(docs, fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, None)], labels))).collect()} == {1.0}
    assert {r.score for r in score(docs, fit(docs, spark.createDataFrame([(1, 0)], labels))).collect()} == {0.0}
    assert {r.score for r in score(docs, fit(docs, spark.createDataFrame([], labels))).collect()} == {0.5}
    both = [r.score for r in score(docs, fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], labels))).collect()]
    assert len(both) == 320 and len(set(both[19:])) <= 2


def test_quality_bounds_what_the_driver_gets(spark):
    rows = spark.createDataFrame([(i, i % 2, "".join(np.random.default_rng(i).choice(list("abcdef "), 200_000))) for i in range(8)], "id long, y int, text string")
    whole, some = drawn(rows, 1 << 30), drawn(rows, 100_000)
    assert sum(map(len, whole[0])) == 800_000 and 40_000 < sum(map(len, some[0])) < 200_000 and set(some[0]) <= set(whole[0])


def test_language_fit_against_counts(spark):
    docs = spark.createDataFrame([("en", "the cat"), ("en", "The dog!"), ("fr", "le chat"), (None, "nobody"), ("de", None)], "lang string, text string").selectExpr("1L AS doc_id", "*")
    names, p = fit_languages(docs)
    assert names == ["en", "fr"]
    for k, texts in enumerate((["the cat", "The dog!"], ["le chat"])):
        want = np.full(len(p), 0.5)
        for t in texts:
            g, n = grams(t.encode())
            want[g] += n
        assert np.allclose(p[:, k], want / want.sum())
