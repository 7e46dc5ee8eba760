import pytest

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "de", None), (4, "one", None, "b"), (5, "one two", "en", "b"), (5, "one two", "en", "b"),
    (6, "The quick brown fox jumps over the lazy dog. " * 40, "en", "c"), (7, "the quick brown fox jumps over the lazy dog. " * 40, "en", "c"), (None, "no id here at all", "en", None),
    (8, "ha " * 3000, "en", "d"), (9, "w" * 200_000, "en", "d"), (10, "été ça où — ß \U0001f600 !!!", "fr", "e"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, wordless, long and repeated texts, with columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, 0, "x", 1.5, "y") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, id string, fp double, word string").repartition(3)


@pytest.fixture(scope="session")
def odd_dir(odd, spark, tmp_path_factory):
    """A data folder whose documents are the odd ones, with small tables beside them."""
    top = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 0, 0), (9, 0, None), (4, None, None), (None, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog the quick"), (2, "ha"), (3, None), (4, ""), (None, "one two")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty_dir(odd_dir, spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{top}/{t}.parquet")
    return str(top)
