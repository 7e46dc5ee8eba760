"""Operator 10: language identification as multilingual mixture inference.

Each language has a smoothed distribution over hashed byte n-grams of the
letters.  A document is a mixture of languages: expectation-maximisation over
its n-gram counts estimates the proportions, for the full set of languages and
then for its first one, two, ... and all languages by proportion.  Of these sets
the one with the greatest likelihood less a penalty (half the logarithm of the
n-grams for each language in the set) is kept; larger sets are left out only
where a bound on the likelihood of any mixture shows that none can win.  The predicted language has the largest proportion in that set;
the score is its proportion.

The distributions come from a sample of at most about `sample` labelled rows,
drawn by a hash of id and text; the documents themselves are read whole.

Null text, or text without a letter: `und`, score 0.  Without any labelled row
everything is `und`.  Null languages never train.  Repeated rows get a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, remainder, sliced, table

ORDER = 3
BUCKETS = 1 << 15
SAMPLE = 20_000
SMOOTH = 0.5
ROUNDS = 12
UNDETERMINED = "und"

#: Lower-cases A-Z; what is no letter in ASCII becomes a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def grams(text: bytes, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the folded text, padded with spaces, and their counts; grams of spaces alone are left out."""
    raw = FOLD[np.frombuffer(b" " + text + b" " * (order - 1), np.uint8)]
    keep = np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]
    x = raw[keep].astype(np.uint32)
    if len(x) < order:
        return np.zeros(0, np.int64), np.zeros(0, np.float64)
    code = np.zeros(len(x) - order + 1, np.uint32)
    for k in range(order):
        code = code * np.uint32(2654435761) + x[k : len(x) - order + 1 + k] * np.uint32(40503)
        code ^= code >> np.uint32(15)
    count = np.bincount(code % np.uint32(buckets), minlength=buckets) if len(code) > buckets // 8 else None
    if count is None:
        found, n = np.unique(code % np.uint32(buckets), return_counts=True)
        return found.astype(np.int64), n.astype(np.float64)
    found = np.flatnonzero(count)
    return found, count[found].astype(np.float64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, P[bucket, language]) from the rows whose language isn't null."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.count()
    if not total:
        return [], np.zeros((buckets, 0))
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), id_col, F.length(text_col)), F.lit(1_000_000)) < int(1e6 * sample / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch, "text")):
                g, n = grams(text, buckets=buckets)
                own = total.setdefault(lang, np.zeros(buckets))
                own[g] += n
        for lang, own in total.items():
            g = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(own[g])], ["lang", "gram", "n"])

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram int, n double")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    p = np.full((buckets, len(names)), SMOOTH)
    at = {x: i for i, x in enumerate(names)}
    p[found.column("gram").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return names, p / p.sum(axis=0)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p for n-grams with counts n, and the log-likelihood, by expectation-maximisation."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        joint = p * share
        whole = joint.sum(axis=1)
        share = (n / whole) @ joint / total
    return share, float(n @ np.log(p @ share))


def most_likely(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> float:
    """A bound on the log-likelihood of every mixture of the columns of p, from the proportions of one.

    By concavity no mixture gains more than the n-grams' number times the
    logarithm of the greatest mean ratio of a column to the one given.
    """
    whole = p @ share
    return float(n @ np.log(whole) + n.sum() * np.log(((n / whole) @ p).max() / n.sum()))


def infer(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of all languages, zero outside the chosen set."""
    k = p.shape[1]
    share, _ = mixture(p, n) if k > 1 else (np.ones(1), 0.0)
    order = np.argsort(-share, kind="stable")
    penalty = 0.5 * np.log(n.sum() + 1)
    bound = most_likely(p, n, share)
    out, best = np.zeros(k), -np.inf
    for size in range(1, k + 1):
        if bound - penalty * size <= best:
            break
        own = order[:size]
        part, fit_ = mixture(p[:, own], n) if size > 1 else (np.ones(1), float(n @ np.log(p[:, own[0]])))
        if fit_ - penalty * size > best:
            best = fit_ - penalty * size
            out[:] = 0
            out[own] = part
    return out


def identify(docs: DataFrame, names: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, lang_pred, score, languages, shares) for each row; keep: the rows of docs, as they are, that have a language."""
    shared = docs.sparkSession.sparkContext.broadcast((names, p.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        for batch in sliced(batches, text_col if keep else "text"):
            pred, score, langs, shares = [], [], [], []
            for text in as_bytes(batch, text_col if keep else "text"):
                g, n = grams(text, buckets=len(p)) if names and text and has_letter(text.decode("utf-8", "replace")) else ((), ())
                if not len(g):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    langs.append([])
                    shares.append([])
                    continue
                share = infer(p[g], n)
                top = np.argsort(-share, kind="stable")
                top = top[share[top] > 0]
                pred.append(names[top[0]])
                score.append(min(1.0, float(share[top[0]])))
                langs.append([names[i] for i in top])
                shares.append([float(share[i]) for i in top])
            if keep:
                yield batch.filter(pa.array([x != UNDETERMINED for x in pred], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["id", "lang_pred", "score", "languages", "shares"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, p = fit(docs.where(remainder("doc_id", 4) != 2))
    found = identify(docs, names, p)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages", "shares")
