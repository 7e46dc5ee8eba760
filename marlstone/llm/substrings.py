"""Operator 3: removal of long repeated word runs by recompression.

Each document's word sequence is parsed in rounds.  A round gives every symbol
a bit from its name, joins neighbours with bits 0 and 1 into a pair, and what
is left of equal neighbours into a run; pairs and runs get names that are
hashes of what they join, so that names agree over the whole corpus without a
table of them.  Each symbol carries the span of words that its parse depends
on: a symbol whose span lies within a stretch of words is there wherever these
words are.

A window of `window` words is known by the highest such interior symbol in it
(the least hash, then the leftmost, of that level), which equal windows share.
Consecutive windows with one symbol form a stretch.  In Spark:

1. symbols that only one stretch has drop out;
2. stretches that agree as a whole, by a hash of all their words, verify all
   their windows at once;
3. only where stretches with one symbol differ, the windows of one stretch of
   each kind are compared by hashes of their words;
4. the windows found are merged by document and their words removed.

No group is gathered but a document's own stretches; counts combine before the
shuffle, and the joins have plain sides that adaptive execution can split.
Hashes have 64 bits for a symbol and 64 more for the words around it.

Null texts have no words.  Texts of fewer than `window` words keep all.
Repeated rows are copies of each other, so all of their windows go.  An empty
table gives no rows; columns besides the id and the text are ignored.  Rows are
told apart by numbers that don't depend on how a scan is split (`with_row`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, forget, release, scratch, sliced, table, with_row

WINDOW = 35
ROUNDS = 14
#: Bytes of text parsed at a time.
SLICE = 1 << 19
FAR = np.int64(1) << 60
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


#: Words longer than this are hashed one by one.
LONG_WORD = 256
BLANK = np.array([c in b" \t\n\v\f\r" for c in range(256)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one after the other, and the words in each.

    All words take in their next byte at once, the longest ones last.
    """
    from xxhash import xxh64_intdigest

    raw = b"\n".join([b"", *texts, b""])
    byte = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(BLANK[byte].astype(np.int8)))
    start, stop = edge[::2] + 1, edge[1::2] + 1
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    count = np.diff(np.searchsorted(start, begin))
    size = stop - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1).astype(np.int16), kind="stable")
    at, sorted_size = start[order], size[order]
    h = sorted_size.astype(np.uint64) * BASE
    longer = len(at) - np.searchsorted(sorted_size[::-1], np.arange(min(LONG_WORD, int(sorted_size[0])) if len(at) else 0), "right")
    table = mixed(np.arange(256, dtype=np.uint64), 11)
    for k, n in enumerate(longer.tolist()):
        now = h[:n]
        now ^= table[byte[at[:n] + k]]
        now *= np.uint64(0xFF51AFD7ED558CCD)
        now ^= now >> np.uint64(32)
    out = np.empty(len(h), np.uint64)
    out[order] = mixed(h, 12)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxh64_intdigest(raw[start[i] : stop[i]], 1)
    return out, count


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit values that looks random."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """Symbols of a round: names, first word, the words [low, high) that the parse depends on, document."""

    def __init__(self, name, start, low, high, doc):
        self.name, self.start, self.low, self.high, self.doc = name, start, low, high, doc

    def next(self, seed: int) -> Level:
        n = len(self.name)
        near = np.zeros(n + 1, bool)  # near[i]: i and i-1 are in one document
        near[1:n] = self.doc[1:] == self.doc[:-1]
        bit = (mixed(self.name, seed) >> np.uint64(63)).astype(bool)
        left = np.zeros(n, bool)
        left[:-1] = ~bit[:-1] & bit[1:] & near[1:n]
        right = np.r_[False, left[:-1]]
        equal = np.zeros(n + 1, bool)  # equal[i]: i and i-1 have one name
        equal[1:n] = (self.name[1:] == self.name[:-1]) & near[1:n]
        joined = np.zeros(n, bool)
        joined[1:] = equal[1:n] & ~right[:-1] & ~left[1:]
        first = np.flatnonzero(~right & ~joined)
        last = np.r_[first[1:], n] - 1
        size = last - first + 1
        pair = left[first] & (size == 2)
        name = self.name[first].copy()
        name[pair] = mixed(name[pair] * np.uint64(3) ^ mixed(self.name[last[pair]], 2), 3)
        run = (size > 1) & ~pair
        name[run] = mixed(name[run] ^ mixed(size[run].astype(np.uint64), 5), 4)
        # what isn't a pair must see both neighbours, and one more beyond an equal one
        a = np.where(pair, first, first - 1 - (equal[first] & (first > 0)))
        b = np.where(pair, last, last + 1 + equal[last + 1])
        low = np.where((a < 0) | (self.doc[np.maximum(a, 0)] != self.doc[first]), -FAR, self.low[np.maximum(a, 0)])
        high = np.where((b >= n) | (self.doc[np.minimum(b, n - 1)] != self.doc[first]), FAR, self.high[np.minimum(b, n - 1)])
        return Level(name, self.start[first], low, high, self.doc[first])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n + 1, BASE), np.full(n + 1, BASE_INVERSE)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def prefix_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arrays from which span_hash reads the hash of any span of words."""
    p, q = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[:-1], out=total[1:])
    return total, q


def span_hash(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total, q = prefix
    return (total[b] - total[a]) * q[a]


def stretches(words: np.ndarray, count: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, symbol, hash) of each stretch; words: hashes of all documents' words, count: words in each."""
    n = len(words)
    end = np.cumsum(count)
    begin = end - count
    doc = np.repeat(np.arange(len(count)), count)
    open_ = np.arange(n) + window <= end[doc] if n else np.zeros(0, bool)
    valid = open_.copy()
    level = Level(words, np.arange(n), np.arange(n), np.arange(n) + 1, doc)
    levels = [level]
    for k in range(ROUNDS):
        if not len(level.name) or not (level.high - level.low <= window).any():
            break
        level = level.next(k)
        levels.append(level)
    symbol, place = np.zeros(n, np.uint64), np.full(n, -1)
    for level in reversed(levels):
        if not open_.any():
            break
        fits = np.flatnonzero(level.high - level.low <= window)
        a = np.maximum(level.high[fits] - window, begin[level.doc[fits]])
        b = np.minimum(level.low[fits], end[level.doc[fits]] - window)
        left = np.r_[0, np.cumsum(open_)]
        use = (a <= b) & (left[np.maximum(b + 1, 0)] > left[np.minimum(a, n)])
        fits, a, b = fits[use], a[use], b[use]
        if not len(fits):
            continue
        many = b - a + 1
        at = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        who = np.repeat(fits, many)
        keep = open_[at]
        at, who = at[keep], who[keep]
        rank = mixed(level.name[who], 99)
        best = np.full(n, np.uint64(2**64 - 1))
        np.minimum.at(best, at, rank)
        won = rank == best[at]
        at, who = at[won], who[won]
        first = np.full(n, n)
        np.minimum.at(first, at, level.start[who])
        place[at] = first[at]
        lead = level.start[who] == first[at]
        symbol[at[lead]] = level.name[who[lead]]
        open_[at] = False
    starts = np.flatnonzero(valid)
    new = np.r_[True, (np.diff(starts) > 1) | (place[starts[1:]] != place[starts[:-1]]) | (symbol[starts[1:]] != symbol[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])] if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    many = np.diff(np.r_[at, len(starts)])
    lo = starts[at]
    whole = span_hash(prefix_hashes(words), lo, lo + many + window - 1)
    whole = mixed(whole ^ mixed(many.astype(np.uint64) * np.uint64(1 << 20) + (place[lo] - lo).astype(np.uint64), 6), 7)
    return doc[lo], lo - begin[doc[lo]], many, symbol[lo], whole


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[DataFrame]]:
    """(row, lo, n): windows lo .. lo + n - 1 of that row start elsewhere too, and the tables it is read from.  rows: (row, id, text)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words, count = word_hashes(as_bytes(batch, "text"))
            doc, lo, n, symbol, whole = stretches(words, count, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc, pa.int64())), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(symbol.view(np.int64)), pa.array(whole.view(np.int64))],
                ["row", "lo", "n", "symbol", "whole"],
            )

    spark = rows.sparkSession
    found = scratch(rows.select("row", "text").mapInArrow(parse, "row long, lo int, n int, symbol long, whole long"), "substrings-stretches")
    shared = scratch(found.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1").select("symbol"), "substrings-symbols")
    release(spark)
    candidates = scratch(found.join(shared, "symbol", "left_semi"), "substrings-candidates")
    forget(found)
    forget(shared)
    release(spark)
    kinds = scratch(candidates.groupBy("symbol", "whole").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "n")).alias("one")), "substrings-kinds")
    several = scratch(kinds.groupBy("symbol").agg(F.count("*").alias("kinds")).where("kinds > 1").select("symbol"), "substrings-several")
    verified = candidates.join(kinds.where("c > 1").select("symbol", "whole"), ["symbol", "whole"], "left_semi").select("row", "lo", "n")
    differ = kinds.join(several, "symbol", "left_semi").select("symbol", F.least("c", F.lit(2)).cast("int").alias("weight"), "one.row", "one.lo", "one.n")
    asked = differ.groupBy("row").agg(F.collect_list(F.struct("symbol", "weight", "lo", "n")).alias("asked"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words, count = word_hashes(as_bytes(batch, "text"))
            prefix, begin = prefix_hashes(words), np.cumsum(count) - count
            column = batch.column("asked")
            of_row, own = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy()), column.flatten()
            symbol, weight, lo, n = (own.field(k).to_numpy() for k in ("symbol", "weight", "lo", "n"))
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(of_row, n)
            value = span_hash(prefix, begin[doc] + at, begin[doc] + at + window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc)), pa.array(at, pa.int32()), pa.array(np.repeat(symbol, n)), pa.array(np.repeat(weight, n)), pa.array(value.view(np.int64))],
                ["row", "lo", "symbol", "weight", "words"],
            )

    compared = scratch(rows.select("row", "text").join(asked, "row").mapInArrow(windows, "row long, lo int, symbol long, weight int, words long"), "substrings-windows")
    release(spark)
    again = scratch(compared.groupBy("symbol", "words").agg(F.sum("weight").alias("w")).where("w > 1").select("symbol", "words"), "substrings-again")
    single = compared.where("weight = 1").join(again, ["symbol", "words"], "left_semi").select("row", "lo", F.lit(1).alias("n"))
    return verified.unionByName(single), [candidates, kinds, several, compared, again]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): kept has the words that stay, joined by single spaces."""
    rows = with_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found, tables = repeated_windows(rows, window)
    spans = scratch(found.groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "substrings-spans")
    for t in tables:
        forget(t)
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            total, gone, kept = [], [], []
            for text, own in zip(as_bytes(batch, "text"), batch.column("spans").to_pylist()):
                words = text.split()
                total.append(len(words))
                if own:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["lo"] for x in own], 1)
                    np.add.at(edge, [x["lo"] + x["n"] + window - 1 for x in own], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.join(spans, "row", "left").mapInArrow(cut, out).withColumnRenamed("id", id_col)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
