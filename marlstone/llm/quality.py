"""Operator 4: quality by compression against dictionaries of good and of bad text.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A document compressed with the dictionary that is like it gets smaller;
the difference of the two sizes, over the size without a dictionary and over the
length, for the whole text and for its chunks (mean, least and greatest), is turned
into a probability by logistic regression on labelled rows that no dictionary has
seen.  No other feature takes part.

Labelled rows are sampled by a hash of the id: at most about `sample` of each
class, half for the dictionaries, half for the calibration; where one id has very
many texts, by a hash of the text too.  The dictionaries train on pieces drawn by a
hash over the whole length of the first half's texts, about `train_bytes` of each
class at most, which is all the text that the driver sees; the calibration's
features are made where the rows are.  Documents are compressed whole.

Null and empty texts get the share of label 1 among the labelled ids.  Null
labels, and labels of unknown ids, are ignored; several labels of one id all
train; equal labelled rows train once.  If a class has no row, the score is 1 or 0
by the class that there is, or 0.5 without any label.  Repeated rows get a row each
and texts that are equal get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, forget, remainder, scratch, sliced, table

SAMPLE = 2_000
#: Bytes of the pieces into which training texts are cut, over their whole length; the dictionaries' own size.
PIECE = 2_000
DICTIONARY = 112 << 10
#: Bytes of text of each class from which its dictionary is made.
TRAIN_BYTES = 8 << 20
LEVEL = 3
#: Bytes of the chunks whose sizes show where in a text it turns bad.
CHUNK = 200


def compressors(good: bytes, bad: bytes, level: int = LEVEL) -> list:
    import zstandard as z

    out = []
    for d in (good, bad):
        data = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out.append(z.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False))
    return [*out, z.ZstdCompressor(level=level, write_content_size=False)]


def cut(text: bytes) -> list[bytes]:
    """The chunks of a text; the last has what is left, half a chunk more at most."""
    starts = range(0, max(1, len(text) - CHUNK // 2), CHUNK)
    return [text[k : k + CHUNK] for k in starts[:-1]] + [text[starts[-1] :]]


def features(text: bytes, tools: list) -> list[float]:
    """1, and the difference of the two sizes over the plain size and over the length: of the whole text, and the mean, least and greatest of its chunks."""
    good, bad, plain = (len(t.compress(text)) for t in tools)
    chunks = cut(text)
    sizes = np.array([[len(t.compress(c)) for t in tools] for c in chunks], float)
    more = sizes[:, 1] - sizes[:, 0]
    part, tight = more / sizes[:, 2], more / np.array([len(c) + 20 for c in chunks])
    return [1.0, (bad - good) / plain, (bad - good) / (len(text) + 20), part.mean(), part.min(), part.max(), tight.mean(), tight.min(), tight.max()]


def train_dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; too little text serves as raw content."""
    import zstandard as z

    parts = [p for p in pieces if len(p) >= 8]
    if sum(map(len, parts)) >= 10 * size and len(parts) >= 16:
        try:
            return z.train_dictionary(size, parts, level=LEVEL).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(parts)[-size:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with row weights, which undo the sampling of the classes."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def drawn(rows: DataFrame, limit: int, piece: int = PIECE) -> dict[int, list[bytes]]:
    """Pieces of the texts of rows (id, y, text) by class, about limit bytes of each, drawn over their whole length."""
    from xxhash import xxh64_intdigest

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    bound = {y: int(2**64 * min(1, limit / n)) for y, n in total.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            labels, parts = [], []
            for y, text in zip(batch.column("y").to_pylist(), as_bytes(batch, "text")):
                for k in range(0, len(text), piece):
                    if xxh64_intdigest(text[k : k + piece], k) < bound[y]:
                        labels.append(y)
                        parts.append(text[k : k + piece])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(parts, pa.binary())], ["y", "part"])

    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.select("y", "text").mapInArrow(run, "y int, part binary").collect():
        out[r["y"]].append(bytes(r["part"]))
    return {y: sorted(x) for y, x in out.items()}


def measured(rows: DataFrame, good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of rows (y, text), in an order of their own."""
    tools_of = rows.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(*tools_of.value)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([features(t, tools) for t in as_bytes(batch, "text")], pa.list_(pa.float64()))], ["y", "x"])

    found = sorted((r["y"], r["x"]) for r in rows.select("y", "text").mapInArrow(run, "y int, x array<double>").collect())
    return np.array([x for _, x in found]), np.array([y for y, _ in found], float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES) -> dict:
    """The model: dictionaries, mean and scale of the features, weights, share of label 1."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").distinct()
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"share": float(min(sizes)) if sizes else 0.5}
    share = float(sizes[1]) / (sizes[0] + sizes[1])
    part = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000))
    bound = F.when(F.col("y") == 1, int(1e6 * min(1, sample / sizes[1])) + 1).otherwise(int(1e6 * min(1, sample / sizes[0])) + 1)
    # about 2 * sample ids by the counts above, whatever the input: the texts stay where they are
    few = F.broadcast(own.where(part < bound))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("octet_length(text) > 0").join(few, "id").dropDuplicates(["id", "y", "text"])
    chosen = scratch(chosen.withColumn("first", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2)) == 0), "quality-labelled")
    there = {(r["y"], r["first"]): r["n"] for r in chosen.groupBy("y", "first").agg(F.count("*").alias("n")).collect()}
    if max(there.values(), default=0) > 2 * sample:
        most = F.create_map(*[x for k, n in there.items() for x in (F.concat_ws("-", F.lit(k[0]), F.lit(k[1])), F.lit(int(1e6 * min(1, sample / n)) + 1))])
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(1_000_000)) < most[F.concat_ws("-", F.col("y"), F.col("first"))])
    pieces = drawn(chosen.where("first"), train_bytes)
    good, bad = train_dictionary(pieces[1]), train_dictionary(pieces[0])
    second = chosen.where("NOT first") if {y for y, first in there if not first} == {0, 1} else chosen
    x, y = measured(second, good, bad)
    forget(chosen)
    if len(set(y.tolist())) < 2:
        return {"share": share}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    prior = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    prior /= prior.mean()
    weights = logistic((x - mean) / scale, y, prior)
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "weights": weights, "share": share}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tools = compressors(m["good"], m["bad"]) if "weights" in m else None
        for batch in sliced(batches, "text"):
            out = []
            for text in as_bytes(batch, "text"):
                if not tools or not text:
                    out.append(float(m["share"]))
                    continue
                x = (np.array(features(text, tools)) - m["mean"]) / m["scale"]
                out.append(float(1 / (1 + np.exp(-np.clip(x @ m["weights"], -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], ["id", "score"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    kept = remainder("doc_id", 3) != 1
    model = fit(docs.where(kept), labels.where(kept))
    return score(docs, model).select("doc_id", (~kept).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
