import hashlib
import re

from marlstone.llm.decontaminate import find_benchmark, op8_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = sorted(map(tuple, op8_decontaminate(spark, sf_dir).collect()), key=str)
    want = brute(docs, items)
    assert got == want and any(r[-1] for r in want)
    parts = find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_bytes=2000).collect()
    assert sorted((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), len(r["items"])) for r in parts) == sorted(r[:4] for r in want)


def test_odd_and_empty(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [r for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").collect() if r.item_id is not None]
    assert sorted(map(tuple, op8_decontaminate(spark, odd_dir).collect()), key=str) == brute(docs, items)
    assert op8_decontaminate(spark, empty_dir).collect() == []


def test_long_items_common_blocks_and_repeated_items(spark):
    long = " ".join(f"w{i % 977} of the" for i in range(20_000))
    items = [(1, long), (2, "of the " * 50), (3, "of the " * 50), (4, "w1 of the"), (5, "lone"), (5, "w5 of the w6"), (6, " ".join(f"w{i} of the" for i in range(5, 9)))]
    texts = [long[777:9000], "of the " * 3000, "x w5 of the w6 lone y " * 4, "w1 OF-the! w2", "", None, " ".join(f"w{i} of the" for i in range(900, 980)), "a lone b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [r[:4] for r in brute(list(enumerate(texts)), items)]
    assert sorted((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), len(r["items"])) for r in got) == want


def test_patterns_with_common_ends():
    from marlstone.llm import decontaminate

    items = [(i, f"same start {i} middle words here for all same end") for i in range(300)]
    matcher = decontaminate.Matcher([(i, t.encode()) for i, t in items])
    texts = [f"x same start {i} middle words here for all same end y".encode() for i in (0, 5, 299, 300)] * 20
    n, last, found, hit = matcher.hits(texts)
    assert [sorted(matcher.items[i] for i in found.get(d, ())) for d in range(4)] == [["0"], ["5"], ["299"], []] and hit.sum() == 60 * 10
