"""Operator 1: pack documents into token sequences by first-fit decreasing.

Every document is tokenised once and cut into pieces of `length` tokens and a
rest.  Documents are dealt into randomised groups (a hash of the row) of about
`group_docs`; each group packs its pieces alone, longest first, each into the
first bin with room, which a tournament tree over the bins' free room finds in
a logarithmic number of steps.  Pieces go to groups by their rows' places in the
stored table (rows that aren't stored are written first), so equal ids or rows
spread too; groups run anywhere and nothing global is needed but one count.

Null text packs as an empty document (its end token alone); a null id stays
null; repeated rows are packed once each; an empty table gives no rows.
Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import math
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, scratch, sliced, stored, table

LENGTH = 1024
GROUP_DOCS = 4096
END_ID = 0
SPECIAL = "<|endoftext|>"
#: A run of white space, as the vocabulary's pattern has it, from the length on where the library's own matching would run out of stack.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(ranks_path: str | None):
    """The byte-level BPE, kept for the life of the worker; tiktoken's form of the vocabulary of byte_bpe_50k.json."""
    kept = sys.__dict__.setdefault("_marlstone_kept", {})
    if ranks_path not in kept:
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[ranks_path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})
    return kept[ranks_path]


def encode(encoder, text: str) -> list[int]:
    """The ids of a text.

    Long runs of white space are one piece of the pattern each, but for their last
    character where a word follows, and are encoded as such.
    """
    ids: list[int] = []
    at = 0
    for run in LONG_BLANK.finditer(text):
        last = run.end() == len(text) or text.startswith(SPECIAL, run.end())
        stop = run.end() if last else run.end() - 1
        ids += encoder.encode(text[at : run.start()], allowed_special="all")
        ids += encoder._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + encoder.encode(text[at:] if at else text, allowed_special="all")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes must be in decreasing order and at most capacity."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k] = node - width
        tree[node] -= size
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            top = left if left >= right else right
            if tree[node] == top:
                break
            tree[node] = top
    return bins


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenise and cut: id, start, length, ids (little-endian unsigned 32-bit) or their crc32, doc_tokens, salt (a hash of the row)."""
    docs = docs if stored(docs) else scratch(docs.select(id_col, text_col), "pack-documents")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        end = np.array([END_ID], "<u4")
        for batch in sliced(batches, "text"):
            rows, start, size, ids, crc, total = [], [], [], [], [], []
            for i, text in enumerate(as_bytes(batch, "text")):
                found = np.concatenate([np.asarray(encode(encoder, text.decode("utf-8", "replace")), "<u4"), end])
                for at in range(0, len(found), length):
                    part = found[at : at + length].tobytes()
                    rows.append(i)
                    start.append(at)
                    size.append(len(part) // 4)
                    ids.append(part) if with_ids else crc.append(zlib.crc32(part))
                    total.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()) if with_ids else pa.array(crc, pa.int64()), pa.array(total, pa.int64()), batch.column("salt").take(pa.array(rows, pa.int64()))],
                ["id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "salt"],
            )

    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()) if with_ids else T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("salt", T.LongType())])
    salt = F.xxhash64(F.lit(17), "_metadata.file_path", "_metadata.row_index")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), salt.alias("salt")).mapInArrow(cut, out).withColumnRenamed("id", id_col)


def pack(cut: DataFrame, groups: int, id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces; each group is packed by itself."""

    def place(part: pa.Table) -> pa.Table:
        size = part.column("length").to_numpy()
        order = np.lexsort((part.column("start").to_numpy(), part.column("salt").to_numpy(), -size))
        part, size = part.take(pa.array(order)), size[order]
        full = int((size >= length).sum())
        bins = np.concatenate([np.arange(full), full + first_fit_decreasing(size[full:], length)])
        by_bin = np.argsort(bins, kind="stable")
        before = np.cumsum(size[by_bin]) - size[by_bin]
        first = np.r_[True, np.diff(bins[by_bin]) > 0]
        offset = np.empty_like(size)
        offset[by_bin] = before - np.maximum.accumulate(np.where(first, before, 0))
        group = part.column("grp").to_numpy()
        part = part.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return part.drop_columns(["grp", "salt"])

    salted = cut.withColumn("grp", F.expr(f"pmod(salt, {groups}L)"))
    out = T.StructType([*(f for f in cut.schema.fields if f.name != "salt"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return salted.groupBy("grp").applyInArrow(place, out)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_docs: int = GROUP_DOCS, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it is from, where it lies, and its ids (with_ids=False: only their crc32)."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    return pack(pieces(docs, id_col, text_col, length, ranks_path, with_ids), groups, id_col, length)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of a packing with ids; a sequence holds at most `length` tokens, so the gathered list is small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("tokens"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
