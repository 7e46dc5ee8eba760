import hashlib
import re

from marlstone.llm.secrets import find_secrets, op5_secrets, redact

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort()
    n = [sum(k == i for _, k, _ in out) for i in range(3)]
    return (*n, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out).encode()).hexdigest())


def check(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op5_secrets(spark, sf_dir)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(((d, *base(t)) for d, t in docs), key=str)
    return got


def test_against_brute_force(spark):
    assert check(spark, "/root/testdata/sf0.01").agg({"n_assign": "sum"}).first()[0] > 0


def test_odd_and_empty(spark, odd_dir, empty_dir):
    check(spark, odd_dir)
    assert op5_secrets(spark, empty_dir).collect() == []


def test_hard_texts(spark, tmp_path):
    h = "0123456789abcdef" * 2
    texts = [
        f"\U0001f600é token = '{h}' x", "token=a.token:longvalue123", "PassWD: \"abcdefgh\" secret=short", "AKIA" + "A" * 12 + "AKIAZZ AKIA12", h * 3, "apikey=api_key=12345678 API_KEY:x",
        "token =\n12345678", "secret=" + "x" * 50_000, f"{h}g{h}", "ghp_" + "a1B2c3D4" * 5,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in check(spark, str(tmp_path)).collect()}
    assert rows[9].spans == "vendor:0:44" and rows[9].n_live == 1


def test_ownership_separates_examples_from_live_keys(spark):
    live, example = "a1B2c3D4e5F6g7H8", "x9Y8z7W6v5U4t3S2"
    rows = [(1, f"token={live}", "o1"), (2, f"token={live}", "o1"), *((10 + i, f"token={example} npm_{'q1W2' * 8}", f"o{i}") for i in range(5)), (3, "password=aaaaaaaa", None)]
    got = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s.verdict, s.owners, s.repositories) for s in got[1]] == [("live", 1, 2)]
    assert [(s.verdict, s.owners, s.repositories, s.kind) for s in got[12]] == [("example", 5, 5, "assign")]
    assert [s.verdict for s in got[3]] == ["weak"]


def test_two_owners_and_many_repositories_make_an_example(spark):
    rows = [(i, "token=a1B2c3D4e5F6g7H8", f"o{i % 2}") for i in range(24)] + [(100 + i, "token=Z1B2c3D4e5F6g7H8", "o1") for i in range(24)]
    got = {r.doc_id: r.spans[0] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i].verdict for i in range(24)} == {"example"} and {got[100 + i].verdict for i in range(24)} == {"live"}


def test_texts_with_very_many_matches(spark, tmp_path):
    many = " é ".join(f"token: {i:012d} {'ab' * 16}{i % 16:x}" for i in range(30_000))
    spark.createDataFrame([(1, many, "s"), (2, many[: 1 << 19], "t")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))


def test_redaction_cuts_overlapping_spans_once(spark):
    h = "0123456789abcdef" * 2
    text = f"é token={h} ß secret: '{h}z' AKIA{'Q' * 14} \U0001f600 password=abc tail " * 300 + "é"
    docs = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "plain", None), (4, f"x{h}", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    spans = sorted([(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(m.start(), m.end()) for p in ("AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}") for m in re.finditer(p, text)])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert got == {1: "".join(out) + text[at:], 2: None, 3: "plain", 4: "x[SECRET]"}
