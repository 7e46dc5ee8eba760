"""Operator 5: secret scans by corpus-wide ownership frequency; DataFrame and SQL functions only.

Every text is scanned whole for candidates: assignments of credentials, access
key ids, long hex runs, and keys with a vendor's prefix.  A candidate's value is
hashed; over the corpus each hash counts its distinct owners and, within each,
its distinct repositories.  A value of `common` owners or more, or of two owners and
`spread` repositories or more, is a widely copied example; else it is its owners'
own, live if it looks random, however many of their repositories hold it.  Candidates
of the base kinds always stay; vendor keys are added unless they are examples.

Positions are running sums, by row and kind, of the lengths of matches and of what
lies between, in code points and in bytes; work is in proportion to the text.
Counts are combined before each shuffle (hash, owner and repository first, then
hash and owner, then hash), so a value that a third of all rows hold is
no hot key; the join back has plain sides that adaptive execution can split.

Null and empty texts have no spans.  Null owners count as one owner, null
repositories as one repository.  Repeated rows get a row each.  An empty table
gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, with_row

#: Owners from which on a value is a widely copied example.
COMMON = 3
#: Repositories from which on a value of two owners is one.
SPREAD = 20
#: kind, pattern, group of the value, least length of the value.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
    ("vendor", r"((?:gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.|npm_|hf_)[A-Za-z0-9_.-]+)", 1, 24),
]
BASE = ("assign", "access", "hex")
#: A text without this has no candidate; it spares most texts the exact patterns.
HINT = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.|npm_|hf_"
#: Each kind's own cheap test.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{32}", "vendor": r"gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.|npm_|hf_"}
PART = "array<struct<kind:int,place:int,gap:int,gap_bytes:int,size:int,size_bytes:int,fits:boolean,hash:string,random:boolean>>"


def _of_kind(text: str, number: int) -> Column:
    """Matches of a kind in order: lengths of the gap before and of the match, hash of the value, whether it is long enough and looks random."""
    _, pattern, group, least = KINDS[number]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def one(x: Column, place: Column) -> Column:
        v = x["value"]
        random = (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8)
        return F.struct(
            F.lit(number).alias("kind"), place.alias("place"), F.length(x["gap"]).alias("gap"), F.octet_length(x["gap"]).alias("gap_bytes"), F.length(x["whole"]).alias("size"), F.octet_length(x["whole"]).alias("size_bytes"),
            (F.length(v) >= least).alias("fits"), F.sha2(v.cast("binary"), 256).alias("hash"), random.alias("random"),
        )

    # the last gap has no match after it
    return F.filter(F.transform(parts, one), lambda x: x["size"].isNotNull())


def candidates(text: str) -> Column:
    """The matches of all kinds in a text column."""
    none = F.array().cast(PART)
    return F.concat(*(F.when(F.col(text).rlike(HINTS[k[0]]), _of_kind(text, i)).otherwise(none) for i, k in enumerate(KINDS)))


def placed(found: DataFrame) -> DataFrame:
    """A row for each fitting match of found (row, ..., found): start and stop in code points and in bytes, kind, hash, random."""
    each = found.select(*(c for c in found.columns if c != "found"), F.inline("found"))
    before = W.partitionBy("row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop, stop_bytes = F.sum(F.col("gap") + F.col("size")).over(before), F.sum(F.col("gap_bytes") + F.col("size_bytes")).over(before)
    each = each.withColumns({"stop": stop.cast("int"), "stop_bytes": stop_bytes.cast("int")}).where("fits")
    return each.withColumns({"start": F.col("stop") - F.col("size"), "start_bytes": F.col("stop_bytes") - F.col("size_bytes")}).drop("place", "gap", "gap_bytes", "size", "size_bytes", "fits")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of spans (hash, owner, repository)."""
    per_owner = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("c")).groupBy("hash", "owner").agg(F.count("*").alias("r"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", common: int = COMMON, spread: int = SPREAD, row_col: str | None = None) -> DataFrame:
    """(id, spans, and row if row_col is given): by start, then kind; each with kind, start, stop (code points, stop exclusive), hash, owners, repositories, verdict, and both ends in bytes."""
    none = F.array().cast(PART)
    read = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    found = scratch(read.withColumn("found", F.when(F.col("text").rlike(HINT), candidates("text")).otherwise(none)).drop("text"), "secrets-found")
    each = scratch(placed(found.where(F.size("found") > 0)), "secrets-spans")
    counts = scratch(ownership(each), "secrets-owners")
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    example = (F.col("owners") >= common) | ((F.col("owners") > 1) & (F.col("repositories") >= spread))
    verdict = F.when(example, "example").when(F.col("random"), "live").otherwise("weak")
    span = F.struct("start", F.col("kind").alias("order"), F.element_at(names, F.col("kind") + 1).alias("kind"), "stop", "hash", "owners", "repositories", "verdict", "start_bytes", "stop_bytes")
    judged = each.join(counts, "hash").withColumn("verdict", verdict).where((F.col("kind") < len(BASE)) | (F.col("verdict") != "example"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.where(F.size("found") > 0).select("row", "id").join(spans, "row", "left")
    empty = spans.schema["spans"].dataType.simpleString()
    lead = [F.col("id").alias(id_col), *(["row"] if row_col else [])]
    return out.select(*lead, F.coalesce("spans", F.array().cast(empty)).alias("spans")).unionByName(found.where(F.size("found") == 0).select(*lead, F.array().cast(empty).alias("spans")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", common: int = COMMON, spread: int = SPREAD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that is no widely copied example replaced by a mark; overlapping spans share one.

    Only rows with a candidate are joined.  A text is cut at the bytes of its
    spans, once each.
    """
    row = "marlstone_row"
    rows = with_row(docs, row)
    hinted = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    found = find_secrets(rows, id_col, text_col, owner_col, repository_col, common, spread, row)
    each = found.select("row", F.inline(F.filter("spans", lambda s: s["verdict"] != "example"))).select("row", "start_bytes", "stop_bytes")
    upto = W.partitionBy("row").orderBy("start_bytes", "stop_bytes")
    each = each.withColumn("reach", F.max("stop_bytes").over(upto.rowsBetween(W.unboundedPreceding, -1)))
    each = each.withColumn("part", F.count_if(F.col("reach").isNull() | (F.col("start_bytes") >= F.col("reach"))).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = each.groupBy("row", "part").agg(F.min("start_bytes").alias("a"), F.max("stop_bytes").alias("b"))
    spans = scratch(merged.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("marlstone_spans")), "secrets-redact")

    def cut(raw: Column) -> Column:
        m = F.col("marlstone_spans")

        def piece(i: Column) -> Column:
            a = F.when(i > 0, F.get(m, i - 1)["b"]).otherwise(0)
            b = F.coalesce(F.get(m, i)["a"], F.octet_length(raw))
            return F.substring(raw, a + 1, b - a).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), piece), mark)

    # a lambda's variable holds the bytes without copying them for every span
    whole = F.get(F.transform(F.array(F.col(text_col).cast("binary")), cut), F.lit(0))
    joined_ = rows.where(hinted).join(spans, row, "left").withColumn(text_col, F.when(F.col("marlstone_spans").isNotNull(), whole).otherwise(F.col(text_col)))
    return rows.where(~hinted).select(*docs.columns).unionByName(joined_.select(*docs.columns))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    having = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), having("live").alias("n_live"), having("example").alias("n_example"),
    )
