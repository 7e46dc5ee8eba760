"""Operator 8: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of the benchmark items;
an item of fewer words is one pattern.  Patterns of one length share a table:
the shift of a block of two words is its least distance from the end of any
pattern, and an absent block shifts past all positions it could touch.  Words
are numbered (absent words get 0), one cursor per document runs in lockstep
with the others of its batch, and a shift of zero looks up the bucket of the
suffix that ends there, by a hash of all its words, so that very frequent blocks
select few patterns, which are then compared word by word.

The benchmark reaches the executors in blocks of at most `block_bytes` of
normalised text, by broadcast; a worker builds a block's tables once.  The tables
are arrays over the items' words (about 40 bytes a word, besides the distinct
words).  One block is the usual case, and more blocks repeat the scan and merge
the spans by document.

Null or wordless texts have no words and no hits; items without words are never
found; repeated rows get a row each; repeated items count by their ids, once
each; a null item id is ignored; an empty table or benchmark gives no rows or no hits.
Columns besides the ids and the texts are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, scratch, share, sliced, table, taken

WINDOW = 10
BLOCK_BYTES = 4 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z, and every ASCII byte that no word holds to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Numbers(dict):
    """Word numbers; a word of no pattern is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def suffix_hash(words: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words before each end."""
    h = np.zeros(len(end), np.uint64)
    for k in range(length):
        h = (h ^ words[end - length + k].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class Matcher:
    """Tables of one block of patterns, by their length."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.numbers = Numbers()
        self.items = sorted({str(item) for item, _ in items})
        place = {x: i for i, x in enumerate(self.items)}
        words, owners = [], []
        for item, text in items:
            w = words_of(text)
            if w:
                words.append(np.fromiter((self.numbers.setdefault(x, len(self.numbers) + 1) for x in w), np.int32, len(w)))
                owners.append(place[str(item)])
        self.base = np.int64(len(self.numbers) + 1)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        size = np.array([len(w) for w in words], np.int64)
        first, owners = np.cumsum(size) - size, np.array(owners, np.int32)
        length, many = np.minimum(size, window), np.maximum(1, size - window + 1)
        self.tables = []
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            starts = np.repeat(first[own], many[own]) + np.arange(many[own].sum()) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            self.tables.append(self._table(starts, np.repeat(owners[own], many[own]), n))

    def _key(self, at: np.ndarray, block: int) -> np.ndarray:
        """Keys of the blocks that end before the places given."""
        return self.words[at - 1].astype(np.int64) if block == 1 else self.words[at - 2] * self.base + self.words[at - 1]

    def _table(self, starts: np.ndarray, owner: np.ndarray, length: int) -> tuple:
        block = min(2, length)
        # equal patterns become one, with all their owners
        order = np.lexsort([self.words[starts + k] for k in reversed(range(length))])
        starts, owner = starts[order], owner[order]
        new = np.ones(len(starts), bool)
        new[1:] = False
        for k in range(length):
            w = self.words[starts + k]
            new[1:] |= w[1:] != w[:-1]
        pattern = np.cumsum(new) - 1
        pairs = np.unique(pattern * np.int64(len(self.items)) + owner)
        owned = np.searchsorted(pairs, np.arange(pattern[-1] + 2, dtype=np.int64) * len(self.items))
        owner = (pairs % len(self.items)).astype(np.int32)
        starts = starts[new]
        bucket = suffix_hash(self.words, starts + length, length)
        order = np.argsort(bucket, kind="stable")
        keys, shifts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for end in range(length, block - 1, -1):
            # the shift that comes first is the least
            found = np.setdiff1d(self._key(starts + end, block), keys)
            at = np.searchsorted(keys, found)
            keys, shifts = np.insert(keys, at, found), np.insert(shifts, at, length - end)
        return length, block, keys, shifts, starts[order], bucket[order], owned[:-1][order], owned[1:][order], owner

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, set], np.ndarray]:
        """Words in each text, their running total, the items found in each text that has some, and whether each word is hit."""
        number = self.numbers.__getitem__
        ids = []
        for text in texts:
            w = words_of(text)
            ids.append(np.fromiter(map(number, w), np.int64, len(w)))
        n = np.array([len(x) for x in ids], np.int64)
        last = np.cumsum(n)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        edge = np.zeros(len(flat) + 1, np.int32)
        found: dict[int, set] = defaultdict(set)
        for starts, which, length, low, high, owner in self.search(flat, last - n, last):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + length, -1)
            for d, p in set(zip(np.searchsorted(last, starts, "right").tolist(), which.tolist())):
                found[d].update(owner[low[p] : high[p]].tolist())
        return n, last, found, np.cumsum(edge[:-1]) > 0

    def search(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
        """ids: the words of a batch; first and last: the bounds of each document.  Gives (starts, pattern, length, and where the owners of each pattern lie)."""
        for length, block, keys, shifts, at_word, buckets, low, high, owner in self.tables:
            end = first + length
            live = end <= last
            end, stop = end[live], last[live]
            absent = length - block + 1
            starts, hits = [], []
            while len(end):
                key = ids[end - 1] if block == 1 else ids[end - 2] * self.base + ids[end - 1]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                move = np.where(keys[at] == key, shifts[at], absent)
                zero = np.flatnonzero(move == 0)
                if len(zero):
                    e = end[zero]
                    bucket = suffix_hash(ids, e, length)
                    lo, hi = np.searchsorted(buckets, bucket), np.searchsorted(buckets, bucket, "right")
                    many = hi - lo
                    e = np.repeat(e, many)
                    p = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    for k in range(length):
                        same = ids[e - length + k] == self.words[at_word[p] + k]
                        e, p = e[same], p[same]
                    starts.append(e - length)
                    hits.append(p)
                end = end + np.maximum(move, 1)
                live = end <= stop
                if not live.all():
                    end, stop = end[live], stop[live]
            if starts:
                yield np.concatenate(starts), np.concatenate(hits), length, low, high, owner


class Block:
    """A block of items as it is broadcast; its tables are built in the worker, once."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.items, self.window, self.own = items, window, None

    def matcher(self) -> Matcher:
        if self.own is None:
            self.own, self.items = Matcher(self.items, self.window), None
        return self.own


def scan(docs: DataFrame, items: list[tuple[object, bytes]], window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, spans [(first, last)] of hit words merged, items that occur (sorted as strings)."""
    block = share(docs.sparkSession, Block(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = taken(block).matcher()
        for batch in sliced(batches, "text"):
            n, last, found, hit = matcher.hits(as_bytes(batch, "text"))
            first = last - n
            spans = []
            for d in range(len(n)):
                own = []
                if d in found:
                    x = np.diff(np.r_[False, hit[first[d] : last[d]], False].astype(np.int8))
                    own = [{"first": a, "last": b} for a, b in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist())]
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([[matcher.items[i] for i in sorted(found.get(d, ()))] for d in range(len(n))], pa.list_(pa.string()))],
                ["row", "id", "n_words", "spans", "items"],
            )

    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    out = T.StructType([docs.schema["row"], docs.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, out)


def _items(benchmark: DataFrame, item_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-size // block_bytes))


def _block(items: DataFrame, k: int, blocks: int) -> list[tuple[object, bytes]]:
    return [(r["item"], r["text"].encode()) for r in items.where(F.expr(f"pmod(xxhash64(item), {blocks}L) = {k}")).collect()]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, as they are, in which no window occurs."""
    items, blocks = _items(benchmark, item_col, block_bytes)

    def without(own: list[tuple[object, bytes]]):
        block = share(docs.sparkSession, Block(own, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = taken(block).matcher()
            for batch in sliced(batches, text_col):
                texts = as_bytes(batch, text_col)
                _, last, found, _ = matcher.hits(texts)
                yield batch.filter(pa.array([d not in found for d in range(len(texts))], pa.bool_()))

        return run

    for k in range(blocks):
        docs = docs.mapInArrow(without(_block(items, k, blocks)), docs.schema)
    return docs


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans of hit words (first inclusive, last exclusive), items found."""
    items, blocks = _items(benchmark, item_col, block_bytes)
    plain = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    if blocks == 1:
        return scan(plain, _block(items, 0, 1), window).select(F.col("id").alias(id_col), "n_words", "spans", "items")
    numbered = scratch(plain.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = None
    for k in range(blocks):
        one = scratch(scan(numbered, _block(items, k, blocks), window), "decontaminate-block")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "s", F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.select(F.col("id").alias(id_col), "n_words", joined.alias("spans"), "items")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))
