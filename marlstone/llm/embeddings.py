"""Operator 6: near-duplicate embeddings by product quantisation.

Equal vectors are folded first.  Coarse centroids, fitted on a bounded sample,
give each vector a home list; it also probes every list that lies within half
the angle of `cosine` behind the plane between the two centroids (`probed`).  Of
two vectors within that angle on either side of such a plane, one is within
half of it, so every pair of any data meets.  In a list, homes are kept as codes of
their residual's subspaces; the product of what the codes stand for with a batch of
queries gives asymmetric estimates.  As the angle between a home and what its codes
stand for is known, the angle from there to a linked query is at most that plus the
angle of `cosine` (`reach`), so the filter loses no pair that meets, and
an exact cosine in double precision decides.  Every pair is decided in one list
only, so link counts are the same from both sides.  A list gives back counts and
links to a local representative, never all pairs; star contraction joins them.

A list with more than `block` homes or visitors is worked on in blocks, each
block of homes against each block of the list's rows, so no task holds more than
two blocks, however few lists there are.  All vectors are indexed; only centroids
and codes come from the sample.  No pair is lost at any number of lists or components; where vectors
have no clusters, most lists are probed and work grows nearly with the square
of the vectors (figures in README).

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component.  Shorter vectors count as padded with
zeros.  Equal vectors link with each other, repeated rows too.  Links are between
distinct vectors, so a null id links too, but has no component unless another id
is reachable.  Ids may have any type that can be ordered.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, scratch, share, table, taken

COSINE = 0.9
SAMPLE = 16_384
PER_LIST = 512
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 256
BLOCK = 8192
#: Probing vectors that Python gives on at a time.
VISITS = 1 << 16
#: Rows of a list that look up at a time.
QUERIES = 256


def folded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the components as little-endian bytes, null if the vector can't link."""
    wide = vectors.schema[vector_col].dataType.elementType != T.FloatType()
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat, at = column.flatten(), column.offsets.to_numpy()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            base, out = at[0], []
            for i, ok in enumerate(column.is_valid().to_pylist()):
                x = values[at[i] - base : at[i + 1] - base]
                out.append((x + 0.0).astype(kind).tobytes() if ok and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    out = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("vec", T.BinaryType())])
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, out)


def matrix(raw: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of unit length, in double precision, from little-endian bytes."""
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)
    size = np.diff(at) // np.dtype(kind).itemsize
    if (size == width).all():
        out = flat.reshape(-1, width).astype(np.float64)
    else:
        out = np.zeros((len(raw), width))
        out[np.arange(width) < size[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, sphere: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(axis=1) - 2 * (x[i : i + 4096] @ c.T)).argmin(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        c[near[order][at]] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.r_[at, len(x)])[:, None]
        if sphere:
            c /= np.sqrt((c * c).sum(axis=1, keepdims=True)) + 1e-12
    return c


def probed(near: np.ndarray, coarse: np.ndarray, cosine: float, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Home list and lists to probe, for vectors with products `near` with the centroids.

    A vector of another list is behind the plane through the origin between the
    two centroids; the product's lack over the centroids' distance is the sine
    of the angle to that plane.  `margin` and the rounding of distances add to it.
    """
    home = near.argmax(axis=1)
    square = (coarse * coarse).sum(axis=1)
    apart = np.sqrt(np.maximum(0, square[home][:, None] + square - 2 * (coarse[home] @ coarse.T)))
    return home, near.max(axis=1, keepdims=True) - near <= np.sqrt(max(0.0, 1 - cosine) / 2) * apart + (margin + 1e-7)


class Index:
    """Coarse centroids and the codes of residual subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.coarse = k_means(sample, lists, 6, rng, sphere=True)
        residual = sample - self.coarse[(sample @ self.coarse.T).argmax(axis=1)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.codes = [k_means(np.ascontiguousarray(residual[:, p]), codes, 5, rng) for p in self.parts]

    def encode(self, residual: np.ndarray) -> np.ndarray:
        """Codes of residuals."""
        out = np.empty((len(residual), len(self.parts)), np.int32)
        for j, p in enumerate(self.parts):
            c = self.codes[j]
            out[:, j] = ((c * c).sum(axis=1) - 2 * (residual[:, p] @ c.T)).argmin(axis=1)
        return out

    def decode(self, which: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of homes of a list stand for."""
        return self.coarse[which] + np.concatenate([c[codes[:, j]] for j, c in enumerate(self.codes)], axis=1)


def reach(x: np.ndarray, guess: np.ndarray, cosine: float) -> np.ndarray:
    """The least product with guess, in single precision, of any unit vector whose cosine with x is `cosine` or more.

    Angles obey the triangle inequality: such a vector is no farther from guess than x is, plus the angle of `cosine`.
    """
    size = np.sqrt((guess * guess).sum(axis=1))
    off = np.arccos(np.clip((x * guess).sum(axis=1) / np.maximum(size, 1e-300), -1, 1))
    angle = off + np.arccos(np.clip(cosine, -1, 1))
    # what rounding to single precision can take away
    slack = 1e-5 + (x.shape[1] + 2) * 2.0**-23 * size
    return np.where((angle < np.pi) & (size > 1e-9), size * np.cos(angle) - slack, -np.inf).astype(np.float32)


def deal(routed: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """(i, j, as_home, as_row) for each row: rows of a list go with all its blocks of homes, homes with all its blocks of rows."""
    sizes = counts.groupBy("list").agg(F.sum("homes").alias("homes"), F.sum("rows").alias("rows")).where(F.col("rows") > block)
    # one row a list, of which there are MOST_LISTS at most
    large = sizes.select("list", F.greatest(F.lit(1), F.ceil(F.col("homes") / block).cast("int")).alias("h"), F.ceil(F.col("rows") / block).cast("int").alias("r"))
    routed = routed.join(F.broadcast(large), "list", "left").withColumns({"h": F.coalesce("h", F.lit(1)), "r": F.coalesce("r", F.lit(1))})
    routed = routed.withColumns({"at_home": F.col("home") == F.col("list"), "own_h": F.expr("int(pmod(xxhash64(node), h))"), "own_r": F.expr("int(pmod(xxhash64(node, 1), r))")})
    as_row = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(i.alias("i"), F.col("own_r").alias("j"), (F.col("at_home") & (i == F.col("own_h"))).alias("as_home"), F.lit(True).alias("as_row")))
    as_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("r") - 1), lambda j: F.col("at_home") & (j != F.col("own_r"))), lambda j: F.struct(F.col("own_h").alias("i"), j.alias("j"), F.lit(True).alias("as_home"), F.lit(False).alias("as_row")))
    return routed.select("list", "home", "probes", "node", "n", "vec", F.inline(F.concat(as_row, as_home)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, margin: float = 0.0, per_list: int = PER_LIST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component) of each row."""
    spark = vectors.sparkSession
    rows = scratch(folded(vectors, id_col, vector_col), "embeddings-rows")
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    reps = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = scratch(reps.select("*", F.monotonically_increasing_id().alias("node"), F.xxhash64("vec").alias("k")), "embeddings-distinct")
    total, width = reps.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    width //= 4 if kind == "<f4" else 8
    some = reps.where(F.expr(f"pmod(k, 1000000000L) <= {int(1e9 * min(1, sample / total))}")).orderBy("k", "vec").select("vec").toArrow().column("vec")
    some = some if len(some) else reps.orderBy("k", "vec").limit(1).select("vec").toArrow().column("vec")
    index = share(spark, Index(matrix(some.cast(pa.binary()), kind, width), min(MOST_LISTS, max(1, total // per_list))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = taken(index).coarse
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                near = matrix(part.column("vec").cast(pa.binary()), kind, width) @ coarse.T
                home, probe = probed(near, coarse, cosine, margin)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(probe.sum(axis=1))].astype(np.int32)), pa.array(np.nonzero(probe)[1].astype(np.int32)))
                whole = np.nonzero(probe)
                for a in range(0, len(whole[0]), VISITS):
                    who, to = whole[0][a : a + VISITS], whole[1][a : a + VISITS]
                    # only the row in the home list is asked for its probes
                    asked = pa.array(np.where(to == home[who], who, len(home)), mask=to != home[who])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.astype(np.int32)), pa.array(home[who].astype(np.int32)), lists.take(asked), *(part.column(c).take(pa.array(who)) for c in ("node", "n", "vec"))],
                        ["list", "home", "probes", "node", "n", "vec"],
                    )

    routed = reps.select("node", "n", "vec").mapInArrow(route, "list int, home int, probes array<int>, node long, n long, vec binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = taken(index).coarse
        homes, all_ = np.zeros(len(coarse), np.int64), np.zeros(len(coarse), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                home, probe = probed(matrix(batch.slice(k, 1024).column("vec").cast(pa.binary()), kind, width) @ coarse.T, coarse, cosine, margin)
                homes += np.bincount(home, minlength=len(coarse))
                all_ += probe.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(coarse), dtype=np.int32)), pa.array(homes), pa.array(all_)], ["list", "homes", "rows"])

    dealt = deal(routed, reps.select("vec").mapInArrow(count, "list int, homes long, rows long"), block)

    def compare(key_: tuple, part: pa.Table) -> pa.Table:
        which = key_[0].as_py()
        idx = taken(index)
        x = matrix(part.column("vec").cast(pa.binary()), kind, width)
        home, node, n = part.column("home").to_numpy(), part.column("node").to_numpy(), part.column("n").to_numpy()
        inside = np.flatnonzero(part.column("as_home").to_numpy(zero_copy_only=False))
        asking = np.flatnonzero(part.column("as_row").to_numpy(zero_copy_only=False))
        links, label, touched = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
        if len(inside):
            # a home's probes tell which visitors it meets again in their own list
            probes = part.column("probes").combine_chunks().take(pa.array(inside))
            flat, at = probes.flatten().to_numpy(), probes.offsets.to_numpy()
            lists = len(idx.coarse)
            again = np.unique(np.repeat(np.arange(len(inside)), np.diff(at)) * lists + flat)
            guess = idx.decode(which, idx.encode(x[inside] - idx.coarse[which]))
            least = reach(x[inside], guess, cosine)[:, None]
            guess = guess.astype(np.float32)
        for a in range(0, len(asking), QUERIES) if len(inside) else ():
            q = asking[a : a + QUERIES]
            to, who = np.nonzero(guess @ x[q].T.astype(np.float32) >= least)
            who, other = q[who], inside[to]
            # two homes of one list meet twice, in the order of their nodes only once
            ok = np.where(home[who] == which, node[who] < node[other], home[who] > which)
            lower = np.flatnonzero((home[who] != which) & ~ok)
            key = to[lower] * lists + home[who[lower]]
            ok[lower] = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] != key
            who, other = who[ok], other[ok]
            exact = np.empty(len(who))
            for b in range(0, len(who), 1 << 14):
                exact[b : b + (1 << 14)] = np.einsum("ij,ij->i", x[who[b : b + (1 << 14)]], x[other[b : b + (1 << 14)]])
            ok = exact >= cosine
            who, other = who[ok], other[ok]
            np.add.at(links, who, n[other])
            np.add.at(links, other, n[who])
            touched[who] = touched[other] = True
            order = np.argsort(who, kind="stable")
            who, other = who[order], other[order]
            cuts = np.flatnonzero(np.r_[True, np.diff(who) > 0]) if len(who) else np.zeros(0, np.int64)
            for s, e in zip(cuts.tolist(), np.r_[cuts[1:], len(who)].astype(int).tolist()):
                seen = np.unique(label[np.r_[who[s], other[s:e]]])
                if len(seen) > 1:
                    label[np.isin(label, seen)] = seen[0]
        out = np.flatnonzero(touched)
        order = out[np.argsort(label[out], kind="stable")]
        first = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0]) if len(order) else np.zeros(0, np.int64)
        root = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        return pa.table({"node": node[order], "root": node[root], "links": links[order]})

    found = scratch(dealt.groupBy("list", "i", "j").applyInArrow(compare, "node long, root long, links long"), "embeddings-links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "embeddings-groups")
    named = reps.select("vec", "rep", "n", "node").join(counted, "node", "left").join(groups, "node", "left")
    named = scratch(named.select("vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("root")), "embeddings-named")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").select("vec", "links", "component")
    return rows.join(named, "vec", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
