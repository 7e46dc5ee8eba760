"""Operator 2: a log-bilinear language model trained with noise-contrastive estimation.

Words are counted over the whole training corpus.  The `head` commonest words,
the end of a text and `buckets` classes of all other words (by a hash of their
last two bytes) are the model's classes.  The context of a token is the classes of the
POSITIONS tokens before it (the end stands before a text): their vectors, each
weighted by its position's vector, add up to a prediction h.  The score of a class w is
h . q_w + b_w.  Classes are dealt into about the square root of their number of
groups, which are scored alike; a token's probability is that of its group times
that of its class in the group, both normalised exactly by batched matrix
products.  Within a bucket a word has its smoothed share of the bucket's training tokens.

Training starts from the unigram biases.  Each task runs noise-contrastive
estimation in numpy over its own part of the corpus, for classes and for groups,
and the tasks' parameters are averaged, weighted by tokens, as plain sums in Spark.
All training texts take part.  So `score` depends, besides the texts, on how the
scan is split into tasks; counts and `base_score` don't.

Scoring looks up the `known` commonest words (each of at most WORD_BYTES, so
their size is bounded) in every worker; the counts of all other words come by a
join on the word.  A document's sums are put together by its place in the scan,
so the input must be a stored table.

Null and empty texts are one end token.  A null id counts as the empty text in
the split.  Without training rows every probability is 1 over 1 for the base and
for the model's only class.  Repeated rows get a row each; an empty table gives
no rows; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, release, remainder, scratch, share, sliced, table, taken

HEAD = 6_000
BUCKETS = 256
KNOWN = 150_000
WORD_BYTES = 64
DIMENSIONS = 16
POSITIONS = 3
#: Noise samples of a batch: classes, groups.
NOISE = 64, 16
BATCH = 4096
#: Tokens that are normalised at a time.
ROWS = 1 << 12
RATE = 0.15
ADD = 0.1


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bucket_of(word: bytes, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-2:]) % buckets


class Tails(dict):
    """The buckets of last two bytes, each worked out once."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, tail: bytes) -> int:
        self[tail] = found = bucket_of(tail, self.buckets)
        return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; counts are combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in sliced(batches, "text"):
            for text in as_bytes(batch, "text"):
                total.update(words_of(text))
            if len(total) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The known words, their counts and classes; classes are head words, then the end, then buckets."""

    def __init__(self, words: list[bytes], counts: list[int], texts: int, tokens: int, distinct: int, bucket_n: np.ndarray, bucket_v: np.ndarray, head: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.array([*counts, texts], np.float64)
        self.head = min(head, len(words))
        self.end = len(words)
        self.tokens, self.distinct = tokens, distinct
        self.buckets = len(bucket_n)
        self.classes = self.head + 1 + self.buckets
        self.bucket_n, self.bucket_v = bucket_n, bucket_v
        self.of = np.r_[np.arange(self.head), [self.head + 1 + bucket_of(w, self.buckets) for w in words[self.head :]], self.head].astype(np.int32)
        share = np.r_[self.counts[: self.head], texts, bucket_n] + ADD
        self.share = share / share.sum()
        self.log_base = math.log10(tokens + ADD * (distinct + 1)) if tokens else 0.0
        self.bucket_log = np.log10(bucket_n + ADD * (bucket_v + 1))

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the tokens of some texts, one after the other: tokens in each text, known number (-1: not known), class, and the words that aren't known."""
        get, found, rest = self.index.get, [], []
        # a text at a time, so that its words are looked up while they are in the cache
        for t in texts:
            words = words_of(t)
            own = np.full(len(words) + 1, self.end, np.int64)
            own[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            rest += [words[i] for i in np.flatnonzero(own < 0).tolist()]
            found.append(own)
        size = np.fromiter(map(len, found), np.int64, len(found))
        known = np.concatenate(found) if found else np.zeros(0, np.int64)
        classes = self.of.take(known, mode="wrap")
        if rest:
            tails = Tails(self.buckets)
            classes[known < 0] = np.array([tails[w[-2:]] for w in rest]) + self.head + 1
        return size, known, classes, rest


def vocabulary(counted: DataFrame, texts: int, head: int = HEAD, known: int = KNOWN, buckets: int = BUCKETS) -> Vocabulary:
    own = counted.withColumn("bucket", (F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % buckets).cast("int"))
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    short = F.octet_length("word") <= WORD_BYTES
    steps = counted.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect()
    least, taken = None, 0
    for s in steps:
        if taken + s["v"] > known:
            break
        least, taken = s["level"], taken + s["v"]
    top = counted.where(short & (level >= least)).collect() if taken else []
    top = sorted(((r["n"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
    words, counts = [w for _, w in top], [n for n, _ in top]
    in_head = {w for w in words[:head]}
    n, v = np.zeros(buckets), np.zeros(buckets)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    tokens, distinct = int(n.sum()) + texts, int(v.sum()) + (texts > 0)
    for w, c in zip(words[:head], counts[:head]):
        n[bucket_of(w, buckets)] -= c
        v[bucket_of(w, buckets)] -= 1
    assert len(in_head) == len(words[:head])
    return Vocabulary(words, counts, texts, tokens, distinct, n, v, head)


def contexts(classes: np.ndarray, begin: np.ndarray, end: int) -> np.ndarray:
    """The classes of the POSITIONS tokens before each; begin: where each token's text begins; end stands before it."""
    at = np.arange(len(classes))
    return np.stack([np.where(at - k >= begin, classes[at - k], end) for k in range(1, POSITIONS + 1)], axis=1).astype(np.int32)


class Model:
    """r: context vectors of classes, c: those of positions; q and b: targets; gq and gb: targets of groups."""

    def __init__(self, share: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(share)
        self.groups = max(1, round(math.sqrt(n)))
        # classes g, g + groups, ... are a group
        self.share, self.group_share = share, np.bincount(np.arange(n) % self.groups, share)
        vectors = lambda k: (rng.standard_normal((k, dimensions)) * 0.1).astype(np.float32)
        self.r, self.q, self.gq = vectors(n), vectors(n), vectors(self.groups)
        self.c = np.repeat((1 / np.arange(1, POSITIONS + 1, dtype=np.float32))[:, None], dimensions, axis=1)
        self.b, self.gb = np.log(share).astype(np.float32), np.log(self.group_share).astype(np.float32)
        self.noise: dict = {}
        self.past = {k: np.full(len(getattr(self, k)), 0.1, np.float32) for k in ("r", "q", "b", "gq", "gb", "c")}

    def parameters(self) -> np.ndarray:
        """All of them as one table, a bias in the last column."""
        none = lambda x: np.c_[x, np.zeros(len(x))]
        return np.concatenate([none(self.r), np.c_[self.q, self.b], np.c_[self.gq, self.gb], none(self.c)]).astype(np.float64)

    def take(self, table_: np.ndarray) -> None:
        r, q, gq, c = np.split(table_.astype(np.float32), np.cumsum([len(self.r), len(self.q), len(self.gq)]))
        self.r, self.q, self.b, self.gq, self.gb, self.c = r[:, :-1].copy(), q[:, :-1].copy(), q[:, -1].copy(), gq[:, :-1].copy(), gq[:, -1].copy(), c[:, :-1].copy()

    def vectors(self, context: np.ndarray) -> np.ndarray:
        """Vectors of contexts, those of the positions side by side."""
        return self.r.take(context.ravel(), axis=0).reshape(len(context), -1)

    def weights(self) -> np.ndarray:
        """What makes a prediction of such vectors: the diagonal matrices of the positions, one above the other."""
        return np.concatenate([np.diag(c) for c in self.c])

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of targets after contexts."""
        group = (target % self.groups).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group.take(order), np.arange(self.groups + 1))
        group, inner = group.take(order), target.take(order) // self.groups
        out = np.empty(len(target))
        h = np.empty((len(target), self.r.shape[1] + 1), np.float32)
        # the last column stands for the biases
        h[:, -1] = 1
        weights = self.weights()
        for k in range(0, len(target), ROWS):
            h[k : k + ROWS, :-1] = self.vectors(context.take(order[k : k + ROWS], axis=0)) @ weights
        size = math.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0))

        def logs(rows: np.ndarray, q: np.ndarray, at: np.ndarray, close: bool) -> np.ndarray:
            s = rows @ q
            own = s[np.arange(len(s)), at].astype(np.float64)
            top = 0.0
            if not close:
                top = s.max() - 40
                s -= top
                if s.min() < -40:
                    # far apart: each row by its own greatest score
                    s = s.astype(np.float64)
                    most = s.max(axis=1, keepdims=True)
                    return own - top - most[:, 0] - np.log(np.exp(s - most).sum(axis=1))
            return own - top - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32), dtype=np.float64)

        def table_of(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
            """Vectors with biases, and whether no product with them can leave what single precision can raise e to."""
            q = np.ascontiguousarray(np.c_[q, b].T)
            return q, size * math.sqrt((q * q).sum(axis=0).max()) < 60

        q, close = table_of(self.gq, self.gb)
        for k in range(0, len(target), ROWS):
            out[k : k + ROWS] = logs(h[k : k + ROWS], q, group[k : k + ROWS], close)
        for g in range(self.groups):
            q, close = table_of(self.q[g :: self.groups], self.b[g :: self.groups])
            for k in range(cuts[g], cuts[g + 1], ROWS):
                e = min(k + ROWS, cuts[g + 1])
                out[k:e] += logs(h[k:e], q, inner[k:e], close)
        given = np.empty(len(target))
        given[order] = out / math.log(10)
        return given

    def _step(self, rows: np.ndarray, grads: dict[str, tuple[np.ndarray, float]]) -> None:
        """Add up the gradients of equal rows, for parameters of each name, and step there."""
        order = np.argsort(rows.astype(np.uint16) if len(self.r) < 1 << 16 else rows, kind="stable")
        rows = rows.take(order)
        new = np.empty(len(rows), bool)
        new[0] = True
        np.not_equal(rows[1:], rows[:-1], out=new[1:])
        at = np.flatnonzero(new)
        rows = rows.take(at)
        for name, (grad, rate) in grads.items():
            own, past = getattr(self, name), self.past[name]
            total = np.add.reduceat(grad.take(order, axis=0), at, axis=0)
            sums = past.take(rows)
            sums += np.einsum("ij,ij->i", total, total) * np.float32(1 / total.shape[1]) if total.ndim == 2 else total * total
            past[rows] = sums
            scale = rate / np.sqrt(sums, out=sums)
            total *= scale[:, None] if total.ndim == 2 else scale
            own[rows] = own.take(rows, axis=0) + total

    def _noise(self, q: str, share: np.ndarray, noise: int) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative shares and the logarithm of each one's expected draws, made once."""
        if (q, noise) not in self.noise:
            self.noise[q, noise] = np.cumsum(share), np.log(share * noise).astype(np.float32)
        return self.noise[q, noise]

    def _contrast(self, q: str, b: str, h: np.ndarray, target: np.ndarray, share: np.ndarray, noise: int, rng: np.random.Generator, rate: float) -> np.ndarray:
        """A step of noise-contrastive estimation on targets; the noise, drawn from share, serves the whole batch.  Gives the gradient of h."""
        own, (summed, log_noise) = getattr(self, q), self._noise(q, share, noise)
        drawn = np.searchsorted(summed, rng.random(noise) * summed[-1]).clip(0, len(share) - 1)
        bias = getattr(self, b) - log_noise
        w, x, n = own.take(target, axis=0), own[drawn], len(target)
        true = np.einsum("ij,ij->i", h, w)
        true += bias.take(target)
        true = 1 / (1 + np.exp(np.clip(true, -30, 30, out=true), out=true))
        both = np.empty((n + noise, h.shape[1]), np.float32)
        np.multiply(true[:, None], h, out=both[:n])
        grad = np.multiply(w, true[:, None], out=w)
        # twice the logistic function, which is 1 + tanh of half its argument
        false = h @ (x.T / 2)
        false += bias[drawn] / 2
        np.tanh(false, out=false)
        false += 1
        grad -= false @ (x / 2)
        np.divide(h.T @ false, -2, out=both[n:].T)
        of_bias = np.ones(n, np.float32) @ false / -2
        self._step(np.concatenate([target, drawn]), {q: (both, rate), b: (np.concatenate([true, of_bias]), rate / 4)})
        return grad

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator, noise: tuple[int, int] = NOISE, rate: float = RATE) -> None:
        vectors, weights = self.vectors(context), self.weights()
        h = vectors @ weights
        grad = self._contrast("q", "b", h, target, self.share, noise[0], rng, rate)
        grad += self._contrast("gq", "gb", h, target % self.groups, self.group_share, noise[1], rng, rate)
        # of the products of every two dimensions, those of a dimension with itself
        by_position = np.diagonal((vectors.T @ grad).reshape(POSITIONS, grad.shape[1], -1), axis1=1, axis2=2)
        self._step(context.ravel(), {"r": ((grad @ weights.T).reshape(-1, grad.shape[1]), rate)})
        self._step(np.arange(POSITIONS), {"c": (by_position, rate / 10)})


def train(docs: DataFrame, vocab: Vocabulary, dimensions: int = DIMENSIONS) -> Model:
    """Train in every task over its texts and average."""
    spark = docs.sparkSession
    shared = share(spark, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = taken(shared)
        model = Model(v.share, dimensions)
        rng = np.random.default_rng(17)
        before, targets, held, seen = [], [], 0, 0

        def work(least: int) -> None:
            nonlocal before, targets, held, seen
            if held < least or not held:
                return
            c, t = np.concatenate(before), np.concatenate(targets)
            order = rng.permutation(len(c))
            for k in range(0, len(c), BATCH):
                some = order[k : k + BATCH]
                model.train(c.take(some, axis=0), t.take(some), rng)
            seen += len(c)
            before, targets, held = [], [], 0

        for batch in sliced(batches, "text"):
            size, _, flat, _ = v.numbers(as_bytes(batch, "text"))
            before.append(contexts(flat, np.repeat(np.cumsum(size) - size, size), v.head))
            targets.append(flat)
            held += len(flat)
            work(64 * BATCH)
        work(0)
        if seen:
            names = ["row", "weight", *(f"c{k}" for k in range(dimensions + 1))]
            every = model.parameters() * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(np.full(len(every), float(seen))), *(pa.array(np.ascontiguousarray(c)) for c in every.T)], names)

    kinds = "row long, weight double, " + ", ".join(f"c{k} double" for k in range(dimensions + 1))
    summed = docs.select("text").mapInArrow(run, kinds).groupBy("row").agg(F.sum("weight").alias("weight"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(dimensions + 1))).toArrow()
    model = Model(vocab.share, dimensions)
    if summed.num_rows:
        row, weight = summed.column("row").to_numpy(), summed.column("weight").to_numpy()
        every = np.empty((summed.num_rows, dimensions + 1))
        every[row] = np.stack([summed.column(f"c{k}").to_numpy() for k in range(dimensions + 1)], axis=1) / weight[:, None]
        model.take(every)
    return model


def score(docs: DataFrame, vocab: Vocabulary, model: Model, counted: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row of docs (id, text)."""
    spark = docs.sparkSession
    shared = share(spark, (vocab, model))
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = taken(shared)
        log_count = np.log10(v.counts + ADD)
        inside = np.where(np.arange(len(v.counts)) < v.head, 0.0, log_count - v.bucket_log[np.maximum(v.of - v.head - 1, 0)])
        inside[v.end] = 0.0
        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("row", "word", "n", "own", "n_tokens", "n_known", "base", "score")}
            ids = []
            size, known, flat, unknown = v.numbers(as_bytes(batch, "text"))
            first = np.cumsum(size) - size
            begin = np.repeat(first, size)
            there = known >= 0
            log_model = m.log10(contexts(flat, begin, v.head), flat)
            log_model[there] += inside[known[there]]
            log_model[~there] -= v.bucket_log[flat[~there] - v.head - 1]
            log_own = np.where(there, log_count[known], 0.0)
            by_text = [np.add.reduceat(x, first).tolist() for x in (log_model, log_own, (there & (v.counts[known] > 0)).astype(np.int64), (~there).astype(np.int64))]
            at = 0
            for i, (total, own, n_known, n_rest) in enumerate(zip(*by_text)):
                rest, at = unknown[at : at + n_rest], at + n_rest
                tokens = int(size[i])
                base = own - tokens * v.log_base
                counts = Counter(rest)
                parts_ = 1 + len(counts)
                ids += [i] * parts_
                out["row"] += [row] * parts_
                out["word"] += [b" %d" % row, *counts.keys()]
                out["n"] += [0, *counts.values()]
                out["own"] += [True, *[False] * (parts_ - 1)]
                for k, x in (("n_tokens", tokens), ("n_known", n_known), ("base", base), ("score", total)):
                    out[k] += [x, *[None] * (parts_ - 1)]
                row += 1
            types = {"row": pa.int64(), "word": pa.binary(), "n": pa.int64(), "own": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
            lead = batch.column("id").take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([lead, *(pa.array(out[k], t) for k, t in types.items())], ["id", *types])

    schema = T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    parts = docs.select("id", "text").mapInArrow(run, schema)
    found = parts.join(counted.select("word", F.col("n").alias("c")), "word", "left").select(
        "row", "id", "n_tokens",
        F.when(F.col("own"), F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        *(F.when(F.col("own"), F.col(k)).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias(k) for k in ("base", "score")),
    )
    return found.groupBy("row").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")


def log_bilinear_scores(docs: DataFrame, training: DataFrame, head: int = HEAD, known: int = KNOWN, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from training (id, text) and score docs (id, text)."""
    texts = training.count()
    counted = scratch(count_words(training), "lm-counts")
    release(docs.sparkSession)
    vocab = vocabulary(counted, texts, head, known, buckets)
    model = train(training, vocab, dimensions)
    release(docs.sparkSession)
    return score(docs, vocab, model, counted).withColumn("train_tokens", F.lit(vocab.tokens).cast("long"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = log_bilinear_scores(docs, docs.where(remainder("id", 10) != 0))
    return found.select(F.col("id").alias("doc_id"), (remainder("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
