import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import lm
from marlstone.llm.lm import Model, bucket_of, count_words, log_bilinear_scores, op2_lm, remainder, score, train, vocabulary, words_of


def brute(docs):
    docs = [(d, (t or "").encode().lower().split()) for d, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    c = Counter()
    for (_, w), h in zip(docs, held):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])) for (d, w), h in zip(docs, held)), key=str)


@pytest.mark.parametrize("known", [lm.KNOWN, 500])
def test_base_against_brute_force(spark, sf_dir, known):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text")
    want = brute(docs.collect())
    got = log_bilinear_scores(docs, docs.where(remainder("id", 10) != 0), known=known, head=200)
    got = sorted(((r.id, zlib.crc32(str(r.id).encode()) % 10 == 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got.collect()), key=str)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert np.allclose([r[-1] for r in got], [r[-1] for r in want])


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in op2_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 7} cc{k % 3} d") for k in range(50)], "id long, text string")
    counted = count_words(docs)
    vocab = vocabulary(counted, 50, head=4, known=6)
    model = train(docs, vocab, 4)
    every = np.arange(vocab.classes)
    for context in np.random.default_rng(5).integers(0, vocab.classes, (20, lm.POSITIONS)):
        assert abs((10 ** model.log10(np.repeat(context[None], len(every), axis=0), every)).sum() - 1) < 1e-4
    words = [bytes(r.word) for r in counted.collect()]
    ones = spark.createDataFrame([(k, w.decode()) for k, w in enumerate(words)], "id long, text string")
    assert score(ones, vocab, model, counted).count() == len(words)


def test_noise_contrastive_steps_learn_what_a_position_tells():
    """The next class is told by the word before in half of the texts, by the third one before in the others."""
    for place in (0, 2):
        model, rng = Model(np.full(6, 1 / 6), 8), np.random.default_rng(0)
        for _ in range(600):
            c = rng.integers(0, 6, (256, 3))
            model.train(c, (c[:, place] + 1) % 6, rng)
        c = rng.integers(0, 6, (500, 3))
        assert np.mean(10 ** model.log10(c, (c[:, place] + 1) % 6)) > 0.6


def test_scores_against_a_direct_computation(spark):
    """Every token's class probability over all classes, by a plain softmax in double precision."""
    docs = spark.createDataFrame([(k, f"A b{k % 7} cc{k % 3} d {'rare' + str(k) if k % 4 == 0 else ''}") for k in range(60)] + [(60, None), (61, "")], "id long, text string")
    counted = count_words(docs)
    vocab = vocabulary(counted, 62, head=5, known=9)
    model = train(docs, vocab, 4)
    counts = {bytes(r.word): r.n for r in counted.collect()}
    group = np.arange(vocab.classes) % model.groups
    got = {r.id: r.score for r in score(docs, vocab, model, counted).collect()}
    for r in docs.collect():
        words, total, past = words_of((r.text or "").encode()), 0.0, [vocab.head] * 3
        for w in [*words, None]:
            known = vocab.index.get(w) if w is not None else vocab.end
            k = int(vocab.of[known]) if known is not None else vocab.head + 1 + bucket_of(w, vocab.buckets)
            h = sum(model.r[p].astype(float) * model.c[i] for i, p in enumerate(past))
            e, g = np.exp(model.q @ h + model.b), np.exp(model.gq @ h + model.gb)
            total += math.log10(g[group[k]] / g.sum() * e[k] / e[group == group[k]].sum())
            if k > vocab.head:
                total += math.log10((counts[w] + 0.1)) - vocab.bucket_log[k - vocab.head - 1]
            past = [k, *past[:2]]
        assert abs(got[r.id] - total) < 1e-3


def test_ties_among_the_head_words(spark):
    docs = spark.createDataFrame([(k, "b a d c e") for k in range(9)], "id long, text string")
    v = vocabulary(count_words(docs), 9, head=3)
    assert [w for w, i in sorted(v.index.items(), key=lambda x: x[1])] == [b"a", b"b", b"c", b"d", b"e"] and v.head == 3


def test_odd_and_empty(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in op2_lm(spark, odd_dir).collect()), key=str)
    assert [r[:-1] for r in got] == [r[:-1] for r in brute(docs)] and np.allclose([r[-1] for r in got], [r[-1] for r in brute(docs)])
    assert op2_lm(spark, empty_dir).collect() == []


def plain_vocabulary(words):
    return lm.Vocabulary(words, [9] * len(words), 5, 9 * len(words) + 5, len(words) + 1, np.ones(lm.BUCKETS), np.ones(lm.BUCKETS), 4)


def test_numbers_hold_the_words_of_one_text_at_a_time():
    v = plain_vocabulary([b"w%d" % k for k in range(50)])
    texts = [" ".join(f"w{(k * j) % 60}" for j in range(2000)).encode() for k in range(100)]
    v.numbers(texts)
    tracemalloc.start()
    size, known, classes, rest = v.numbers(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = [[*words_of(t), None] for t in texts]
    flat = [w for t in words for w in t]
    assert size.tolist() == [len(t) for t in words] and rest == [w for w in flat if w is not None and w not in v.index]
    assert known.tolist() == [v.end if w is None else v.index.get(w, -1) for w in flat]
    assert classes.tolist() == [v.head if w is None else v.index[w] if v.index.get(w, 99) < v.head else v.head + 1 + bucket_of(w) for w in flat]
    assert peak < 40 * len(flat)
    assert [len(x) for x in v.numbers([])] == [0, 0, 0, 0] and v.numbers([b""])[1].tolist() == [v.end]


@pytest.mark.parametrize("far", [1, 8])
def test_a_training_step_and_scores_in_double_precision(far):
    rng, share = np.random.default_rng(3), np.arange(1, 12) / 66
    model = Model(share, 8)
    for name in ("r", "q", "gq"):
        setattr(model, name, (rng.standard_normal(getattr(model, name).shape) * far).astype(np.float32))
    c, t = rng.integers(0, 11, (200, lm.POSITIONS)), rng.integers(0, 11, 200)
    r, q, b, gq, gb, w = (getattr(model, k).astype(float) for k in ("r", "q", "b", "gq", "gb", "c"))
    h = sum(r[c[:, k]] * w[k] for k in range(lm.POSITIONS))
    s, g = h @ q.T + b, h @ gq.T + gb
    log_sum = lambda x: x.max(axis=1) + np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1))
    same = np.arange(11) % model.groups == (t % model.groups)[:, None]
    want = s[np.arange(200), t] - log_sum(np.where(same, s, -np.inf)) + g[np.arange(200), t % model.groups] - log_sum(g)
    assert np.allclose(model.log10(c, t), want / math.log(10), rtol=1e-4, atol=1e-3)
    if far > 1:
        return
    again, grad = np.random.default_rng(4), np.zeros_like(h)
    for own, bias, target, odds, noise in ((q, b, t, share, 7), (gq, gb, t % model.groups, model.group_share, 3)):
        drawn = np.searchsorted(np.cumsum(odds), again.random(noise) * odds.sum())
        logistic = lambda at: 1 / (1 + np.exp(-((h @ own.T + bias)[:, at] - np.log(odds[at] * noise))))  # noqa: B023, E731
        true, false = 1 - logistic(target)[np.arange(200), np.arange(200)], logistic(drawn)
        grad += true[:, None] * own[target] - false @ own[drawn]
        of, of_bias = np.zeros_like(own), np.zeros_like(bias)
        np.add.at(of, target, true[:, None] * h)
        np.add.at(of, drawn, -false.T @ h)
        np.add.at(of_bias, target, true)
        np.add.at(of_bias, drawn, -false.sum(axis=0))
        own += of * 0.15 / np.sqrt(0.1 + (of * of).mean(axis=1, keepdims=True))
        bias += of_bias * 0.15 / 4 / np.sqrt(0.1 + of_bias * of_bias)
    of, of_c = np.zeros_like(r), np.zeros_like(w)
    for k in range(lm.POSITIONS):
        np.add.at(of, c[:, k], grad * w[k])
        of_c[k] = (r[c[:, k]] * grad).sum(axis=0)
    r += of * 0.15 / np.sqrt(0.1 + (of * of).mean(axis=1, keepdims=True))
    w += of_c * 0.015 / np.sqrt(0.1 + (of_c * of_c).mean(axis=1, keepdims=True))
    model.train(c, t, np.random.default_rng(4), (7, 3), 0.15)
    for name, x in (("r", r), ("q", q), ("b", b), ("gq", gq), ("gb", gb), ("c", w)):
        assert np.allclose(getattr(model, name), x, rtol=1e-3, atol=1e-4), name
