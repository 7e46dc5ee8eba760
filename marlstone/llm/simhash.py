"""Operator 9: SimHash near-duplicates, linked exactly through a vantage-point tree.

A document's fingerprint takes, bit by bit, the majority of the XXH64 hashes of
its word shingles.  Equal fingerprints are folded first.  The distinct ones are
dealt out by a vantage-point tree: an inner node splits by Hamming distance to
its vantage point, each fingerprint has one home leaf, and a ball of the search
radius that crosses a split (the triangle bound tells) also visits the leaf on
the other side.  So every pair within the radius meets in the home leaf of
either of the two.  A leaf compares its homes with the rows in it, again pruned
by the distance to a vantage point, and gives back links to the smallest member
of each local cluster instead of all pairs.  Distributed star contraction joins
the links of all leaves.

The tree is built from a sample of bounded size; that only sets how even the
leaves are, never which pairs are found.  The sample, and so the leaves, grow with
the fingerprints up to MOST_SAMPLE.  A leaf with more than `block` homes or
visitors is worked on in blocks of both, each block of homes against each block
of the leaf's rows, so no task holds more than two blocks.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows keep their own rows in the result.  Links are between fingerprints,
so rows with null ids link too; they get a component if an id is reachable, else
null.  Ids may have any type that can be ordered.  An empty table gives no rows.  Columns besides
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, components, scratch, sliced, table, with_row

SHINGLE = 3
RADIUS = 2
SEED = 42
SAMPLE = 16_384
#: 8 MB of fingerprints at most reach the driver.
MOST_SAMPLE = 1 << 20
LEAF = 4096
BLOCK = 32_768


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """(id, fp, and row if row_col is given): 64 majority bits over the hashes of all word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in sliced(batches, "text", 2 << 20):
            hashes, counts = [], []
            for text in as_bytes(batch, "text"):
                words = text.lower().split()
                if len(words) <= shingle:
                    own = [h(b" ".join(words), SEED)] if words else []
                else:
                    own = [h(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))]
                hashes.append(np.array(own, np.uint64))
                counts.append(len(own))
            n = np.array(counts)
            fp = np.zeros(len(n), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                bits = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8)).reshape(-1, 64)
                at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                fp[some] = np.packbits(2 * ones > n[some][:, None], axis=1).view(">u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64)), *(batch.column("row") for _ in row)], ["id", "fp", *row])

    row = ["row"] if row_col else []
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), *(T.StructField("row", T.LongType()) for _ in row)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(row_col).alias("row") for _ in row)).mapInArrow(run, out)


def build_tree(sample: np.ndarray, total: int, leaf: int = LEAF, radius: int = RADIUS, seed: int = 7) -> list:
    """Nodes [vantage point, split, left, right]; a leaf is [number].

    Among some vantage points and splits, takes the one with the fewest
    comparisons left; stops where a split would no longer pay.
    """
    rng = np.random.default_rng(seed)
    nodes: list = []
    leaves = 0

    def grow(home: np.ndarray, visit: np.ndarray, depth: int) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append(None)
        best = None
        if len(home) > 1 and len(home) / len(sample) * total > leaf and depth < 40:
            now = len(home) * len(visit)
            for point in rng.choice(home, min(len(home), 12), replace=False):
                dh, dv = np.bitwise_count(home ^ point), np.bitwise_count(visit ^ point)
                h, v = np.cumsum(np.bincount(dh, minlength=68)), np.cumsum(np.bincount(dv, minlength=68))
                for mu in range(64):
                    hl = h[mu]
                    if 0.1 * len(home) <= hl <= 0.9 * len(home):
                        vl, vr = v[mu + radius], v[-1] - (v[mu - radius] if mu >= radius else 0)
                        cost = hl * vl + (h[-1] - hl) * vr
                        if best is None or cost < best[0]:
                            best = (cost, point, mu)
            if best and best[0] > 0.9 * now:
                best = None
        if best is None:
            nodes[me] = [leaves]
            leaves += 1
            return me
        _, point, mu = best
        dh, dv = np.bitwise_count(home ^ point), np.bitwise_count(visit ^ point)
        left = grow(home[dh <= mu], visit[dv <= mu + radius], depth + 1)
        right = grow(home[dh > mu], visit[dv > mu - radius], depth + 1)
        nodes[me] = [int(point), mu, left, right]
        return me

    grow(sample, sample, 0)
    return nodes


def route(nodes: list, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of each visit."""
    rows, leaf, homes = [], [], []

    def go(node: int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if len(nodes[node]) == 1:
            rows.append(at)
            leaf.append(np.full(len(at), nodes[node][0]))
            homes.append(home)
            return
        point, mu, left, right = nodes[node]
        d = np.bitwise_count(fps[at] ^ np.uint64(point)).astype(np.int64)
        to = d <= mu + radius
        go(left, at[to], home[to] & (d[to] <= mu))
        to = d > mu - radius
        go(right, at[to], home[to] & (d[to] > mu))

    go(0, np.arange(len(fps)), np.ones(len(fps), bool))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(leaf or [np.zeros(0, np.int64)]), np.concatenate(homes or [np.zeros(0, bool)])


def link_leaf(fps: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A label for each row of a leaf; rows with one label are joined by links of a home to any row."""
    n = len(fps)
    label = np.arange(n)
    if not n:
        return label
    far = fps[np.argmax(np.bitwise_count(fps ^ fps[0]))]
    d = np.bitwise_count(fps ^ far).astype(np.int64)
    order = np.argsort(d, kind="stable")
    d, f = d[order], fps[order]
    lo, hi = np.searchsorted(d, d - radius), np.searchsorted(d, d + radius, "right")
    own = np.arange(n)
    for i in np.flatnonzero(home[order]).tolist():
        a = lo[i]
        near = np.flatnonzero(np.bitwise_count(f[a : hi[i]] ^ f[i]) <= radius)
        if len(near) > 1:
            seen = own[near + a]
            if (seen != seen[0]).any():
                seen = np.unique(seen)
                own[np.isin(own, seen)] = seen[0]
    label[order] = own
    return label


def link(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links of fingerprints that connect all that are within the radius; fps has distinct fp."""
    total = fps.count()
    share = min(1.0, min(MOST_SAMPLE, max(sample, total * 16 // leaf)) / max(total, 1))
    some = fps.where(F.expr(f"pmod(xxhash64(fp), 1000000000L) <= {int(share * 1e9)}")).select("fp").toArrow().column("fp").to_numpy().view(np.uint64)
    nodes = build_tree(np.sort(some), total, leaf, radius) if len(some) else [[0]]
    tree = fps.sparkSession.sparkContext.broadcast(nodes)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fp").to_numpy().view(np.uint64)
            row, to, home = route(tree.value, f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(f[row].view(np.int64)), pa.array(to, pa.int64()), pa.array(home)], ["fp", "leaf", "home"])

    routed = scratch(fps.select("fp").mapInArrow(visits, "fp long, leaf long, home boolean"), "simhash-visits")
    sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).where(F.col("rows") > block)
    # one row a leaf, of which there are MOST_SAMPLE at most
    large = sizes.select("leaf", F.ceil(F.col("homes") / block).cast("int").alias("h"), F.ceil(F.col("rows") / block).cast("int").alias("r"))
    routed = routed.join(F.broadcast(large), "leaf", "left").withColumns({"h": F.greatest(F.coalesce("h", F.lit(1)), F.lit(1)), "r": F.coalesce("r", F.lit(1))})
    # each row goes with all blocks of homes, and each home with all blocks of rows; it is both where the two meet
    own_h, own_r = F.expr("int(pmod(xxhash64(fp), h))"), F.expr("int(pmod(xxhash64(fp, 1), r))")
    routed = routed.withColumns({"own_h": own_h, "own_r": own_r})
    as_row = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(i.alias("i"), F.col("own_r").alias("j"), (F.col("home") & (i == F.col("own_h"))).alias("as_home"), F.lit(True).alias("as_row")))
    as_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("r") - 1), lambda j: F.col("home") & (j != F.col("own_r"))), lambda j: F.struct(F.col("own_h").alias("i"), j.alias("j"), F.lit(True).alias("as_home"), F.lit(False).alias("as_row")))
    dealt = routed.select("fp", "leaf", F.inline(F.concat(as_row, as_home)))

    def link_part(part: pa.Table) -> pa.Table:
        f = part.column("fp").to_numpy().view(np.uint64)
        label = link_leaf(f, part.column("as_home").to_numpy(zero_copy_only=False), radius)
        sorted_by = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(label[sorted_by]) > 0]) if len(label) else np.zeros(0, np.int64)
        root = np.repeat(sorted_by[starts], np.diff(np.r_[starts, len(label)]))
        to = sorted_by != root
        return pa.table({"a": f[sorted_by[to]].view(np.int64), "b": f[root[to]].view(np.int64)})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(link_part, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, leaf: int = LEAF, row_col: str | None = None) -> DataFrame:
    """(id, fp, component, and row if row_col is given): every row of docs, its fingerprint, and the smallest id reachable through links."""
    prints = scratch(fingerprints(docs, id_col, text_col, row_col=row_col), "simhash-prints")
    reps = scratch(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    groups = components(link(reps, radius, leaf), "simhash-links").withColumnsRenamed({"node": "fp", "component": "root"})
    member = scratch(reps.join(groups, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-members")
    least = member.groupBy("root").agg(F.min("rep").alias("component"))
    named = member.join(least, "root").select("fp", "component", "root")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component", *(["row", "root"] if row_col else []))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that stand for their group: one row of the smallest id.

    Of a group without any id, one row stays too.
    The last join is a hash join of shuffled sides at every size: its texts
    need no sort, and the row numbers spread evenly.
    """
    row = "marlstone_row"
    rows = with_row(docs, row)
    found = near_duplicates(rows, id_col, text_col, row_col=row)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("row").alias(row))
    return rows.join(scratch(first.select(row), "simhash-kept").hint("shuffle_hash"), row, "left_semi").drop(row)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
