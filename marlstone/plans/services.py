"""Catalog calls, SHOW and DESCRIBE statements, table forms, Delta snapshots and registered sources as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.engines import fresh
from marlstone.plans.registry import query
from marlstone.services.catalog import FolderCatalog
from marlstone.sources import delta, readers, sinks
from marlstone.sources.readers import shared, table

# ---- tables of every managed format ---------------------------------------------------------------


def _named(spark: SparkSession, stem: str, columns: str, fmt: str = "parquet", **options) -> str:
    name = fresh(spark, stem)
    sinks.create_table(spark, name, columns, fmt, **options)
    return name


for _fmt in ("csv", "json", "orc", "parquet"):

    def _create(spark, sf_dir, fmt=_fmt):
        name = _named(spark, f"f{fmt}", "k BIGINT, seg STRING, bal DOUBLE", fmt, if_not_exists=True)
        sinks.insert_into(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), name)
        return spark.table(name)

    query(f"table_format_{_fmt}", "SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer")(_create)


@query("table_if_not_exists", "SELECT n_nationkey AS k FROM nation")
def _(spark, sf_dir):
    name = _named(spark, "again", "k INT")
    sinks.create_table(spark, name, "k INT, other STRING", if_not_exists=True)
    sinks.insert_into(table(spark, sf_dir, "nation").select("n_nationkey"), name)
    return spark.table(name)


def _partitioned(spark: SparkSession, sf_dir: str) -> str:
    name = _named(spark, "parts", "p_partkey BIGINT, p_size INT, p_type STRING", partitioned_by=["p_type"])
    sinks.insert_into(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type").repartition("p_type"), name)
    return name


@query("table_partitioned", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def _(spark, sf_dir):
    return spark.table(_partitioned(spark, sf_dir)).groupBy("p_type").agg(F.count("*").alias("n"))


@query("table_insert_overwrite", "SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1")
def _(spark, sf_dir):
    name = _named(spark, "over", "k INT")
    sinks.insert_into(table(spark, sf_dir, "nation").select("n_nationkey"), name)
    sinks.insert_into(table(spark, sf_dir, "region").where("r_regionkey > 1").select("r_regionkey"), name, overwrite=True)
    return spark.table(name)


@query("table_insert_overwrite_partition", "SELECT p_type, CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END AS p_size, p_partkey FROM part")
def _(spark, sf_dir):
    name = _partitioned(spark, sf_dir)
    table(spark, sf_dir, "part").createOrReplaceTempView("marlstone_part")
    spark.sql(f"INSERT OVERWRITE {name} PARTITION (p_type = 'PROMO') SELECT p_partkey, 0 FROM marlstone_part WHERE p_type = 'PROMO'")
    return spark.table(name).select("p_type", "p_size", "p_partkey")


# ---- SHOW, DESCRIBE, USE, EXPLAIN, ANALYZE ----------------------------------------------------------

query("catalog_show_partitions", "SELECT DISTINCT 'p_type=' || p_type AS partition FROM part")(lambda s, d: s.sql(f"SHOW PARTITIONS {_partitioned(s, d)}"))


@query("catalog_show_columns", "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS col_name")
def _(spark, sf_dir):
    name = fresh(spark, "cols")
    sinks.create_as_select(table(spark, sf_dir, "customer"), name)
    return spark.sql(f"SHOW COLUMNS IN {name}")


@query("catalog_show_databases", "SELECT 'default' AS namespace")
def _(spark, sf_dir):
    return spark.sql("SHOW DATABASES LIKE 'default'")


@query("catalog_show_catalogs", "SELECT 'spark_catalog' AS catalog")
def _(spark, sf_dir):
    return spark.sql("SHOW CATALOGS").where("catalog = 'spark_catalog'")


@query("catalog_show_views", "SELECT 'marlstone_seen' AS \"viewName\", true AS \"isTemporary\"")
def _(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("marlstone_seen")
    return spark.sql("SHOW VIEWS LIKE 'marlstone_seen'").select("viewName", "isTemporary")


@query("catalog_show_functions", "SELECT unnest(['abs', 'acos']) AS function")
def _(spark, sf_dir):
    return spark.sql("SHOW SYSTEM FUNCTIONS LIKE 'a*s'").where("function IN ('abs', 'acos')")


@query("catalog_show_properties", "SELECT * FROM (VALUES ('origin', 'here'), ('use', 'tests')) t(key, value)")
def _(spark, sf_dir):
    name = _named(spark, "props", "k INT", properties={"origin": "here", "use": "tests"})
    return spark.sql(f"SHOW TBLPROPERTIES {name}").where("key IN ('origin', 'use')")


@query("catalog_show_create_table", "SELECT true AS same_columns, true AS same_comment")
def _(spark, sf_dir):
    name = _named(spark, "made", "k INT COMMENT 'the key', v STRING", comment="it's made", partitioned_by=["v"])
    text = F.lower("createtab_stmt")
    return spark.sql(f"SHOW CREATE TABLE {name}").select((text.contains("k int comment 'the key'") & text.contains("partitioned by (v)") & text.contains("using parquet")).alias("same_columns"), text.contains("made'").alias("same_comment"))


@query("catalog_recreate_table", "SELECT unnest(['k', 'v']) AS col_name, unnest(['int', 'string']) AS data_type")
def _(spark, sf_dir):
    name, again = _named(spark, "orig", "k INT, v STRING", "json"), fresh(spark, "copy")
    spark.sql(spark.sql(f"SHOW CREATE TABLE {name}").first()[0].replace(name, again))
    return spark.sql(f"DESCRIBE TABLE {again}").select("col_name", "data_type")


@query("catalog_describe_extended", "SELECT * FROM (VALUES ('Comment', 'about'), ('Provider', 'orc'), ('Type', 'MANAGED')) t(col_name, data_type)")
def _(spark, sf_dir):
    name = _named(spark, "ext", "k INT", "orc", comment="about")
    return spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name IN ('Comment', 'Provider', 'Type')").select("col_name", "data_type")


@query("catalog_describe_partition", "SELECT 'PROMO' AS v")
def _(spark, sf_dir):
    name = _partitioned(spark, sf_dir)
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name} PARTITION (p_type = 'PROMO')").where("col_name = 'Partition Values'")
    return found.select(F.regexp_extract("data_type", r"p_type=(\w+)", 1).alias("v"))


@query("catalog_describe_json", "SELECT unnest(['k', 'v']) AS name")
def _(spark, sf_dir):
    name = _named(spark, "json", "k INT, v STRING")
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON")
    return text.select(F.explode(F.from_json(F.col(text.columns[0]), "columns array<struct<name:string>>")["columns"]).alias("c")).select("c.name")


@query("catalog_describe_query", "SELECT * FROM (VALUES ('n', 'bigint'), ('t', 'string')) t(col_name, data_type)")
def _(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql("DESCRIBE QUERY SELECT event_type AS t, count(*) AS n FROM events GROUP BY event_type").select("col_name", "data_type")


@query("catalog_describe_database", "SELECT 'Namespace Name' AS info_name, 'default' AS info_value")
def _(spark, sf_dir):
    return spark.sql("DESCRIBE DATABASE default").where("info_name = 'Namespace Name'")


@query("catalog_describe_function", "SELECT true AS known")
def _(spark, sf_dir):
    return spark.sql("DESCRIBE FUNCTION upper").agg(F.bool_or(F.col("function_desc").contains("upper")).alias("known"))


@query("catalog_use", "SELECT 'spark_catalog' AS c, true AS there, 'default' AS back")
def _(spark, sf_dir):
    name = fresh(spark, "db")
    spark.sql(f"CREATE DATABASE {name}")
    before = spark.catalog.currentDatabase()
    spark.sql(f"USE {name}")
    there = spark.catalog.currentDatabase() == name
    spark.sql(f"USE spark_catalog.{before}")
    spark.sql(f"DROP DATABASE {name}")
    return spark.createDataFrame([(spark.catalog.currentCatalog(), there, spark.catalog.currentDatabase())], "c string, there boolean, back string")


@query("catalog_api", "SELECT * FROM (VALUES ('catalog', true), ('database', true), ('table', true), ('column', true), ('function', true), ('no table', false), ('no database', false)) t(what, there)")
def _(spark, sf_dir):
    name, c = _named(spark, "api", "k INT, v STRING"), spark.catalog
    c.setCurrentCatalog("spark_catalog")
    c.setCurrentDatabase("default")
    rows = [
        ("catalog", "spark_catalog" in [x.name for x in c.listCatalogs()]), ("database", c.databaseExists("default") and c.getDatabase("default").name == "default"), ("table", c.tableExists(name) and c.getTable(name).name == name),
        ("column", [x.name for x in c.listColumns(name)] == ["k", "v"]), ("function", c.functionExists("upper")), ("no table", c.tableExists("marlstone_none")), ("no database", c.databaseExists("marlstone_none")),
    ]
    return spark.createDataFrame(rows, "what string, there boolean")


@query("catalog_explain", "SELECT true AS pushed, true AS pruned, true AS aggregated")
def _(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    plan = spark.sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
    text = F.col("plan")
    return plan.select(text.contains("GreaterThan(o_totalprice,100000.0)").alias("pushed"), text.rlike(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double>").alias("pruned"), text.contains("HashAggregate").alias("aggregated"))


@query("catalog_analyze", "SELECT count(*) AS n FROM part")
def _(spark, sf_dir):
    name = _partitioned(spark, sf_dir)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS p_partkey")
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Statistics'")
    return found.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("n"))


@query("catalog_view_guard", "SELECT true AS refused")
def _(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("marlstone_guarded")
    try:
        sinks.temp_view(table(spark, sf_dir, "nation"), "marlstone_guarded", replace=False)
    except Exception as e:  # noqa: BLE001 - the error is the result
        return spark.createDataFrame([("ALREADY_EXISTS" in str(e),)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


@query("catalog_analysis", "SELECT * FROM (VALUES ('version', true), ('local', true), ('streaming', false), ('same', true), ('inputs', true)) t(what, holds)")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    rows = [("version", spark.version.startswith("4.")), ("local", spark.sql("VALUES (1), (2)").isLocal()), ("streaming", df.isStreaming), ("same", df.select("r_name").sameSemantics(df.select("r_name")) and df.semanticHash() == table(spark, sf_dir, "region").semanticHash()), ("inputs", len(df.inputFiles()) >= 1)]
    return spark.createDataFrame(rows, "what string, holds boolean")


# ---- registered sources, external catalogs, Delta ---------------------------------------------------


@query("source_register_parquet", "SELECT count(*) AS n FROM nation")
def _(spark, sf_dir):
    readers.register_parquet(spark, "marlstone_registered", f"{sf_dir}/nation.parquet")
    return spark.sql("SELECT count(*) AS n FROM marlstone_registered")


@query("source_register_batches", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)")
def _(spark, sf_dir):
    import pyarrow as pa

    readers.register(spark, "marlstone_batches", readers.inline(spark, pa.table({"k": pa.array([1, 2], pa.int32()), "v": ["a", "b"]})))
    return spark.sql("SELECT * FROM marlstone_batches")


@query("source_register_samples", "SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    readers.register_samples(spark, sf_dir, ("supplier", "nation"), "marlstone_s_")
    return spark.sql("SELECT count(*) AS n FROM marlstone_s_supplier JOIN marlstone_s_nation ON s_nationkey = n_nationkey")


@query("source_catalog_provider", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    root, _, namespace = sf_dir.rstrip("/").rpartition("/")
    found = FolderCatalog(spark, root)
    assert found.table_exists(namespace, "nation")
    n, r = (found.load_table(spark, namespace, t) for t in ("nation", "region"))
    return n.join(r, F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name")


def _delta(spark: SparkSession, sf_dir: str) -> str:
    """A table of three versions: small parts, then the rest, then only the promoted ones."""
    path, part = shared(spark, "delta"), table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    delta.write(part.where("p_size <= 10"), path, ["p_type"])
    delta.write(part.where("p_size > 10"), path, ["p_type"])
    delta.write(part.where("p_type = 'PROMO'"), path, ["p_type"], overwrite=True)
    return path


query("delta_latest", "SELECT p_partkey, p_size, p_type FROM part WHERE p_type = 'PROMO'")(lambda s, d: delta.read(s, _delta(s, d)).select("p_partkey", "p_size", "p_type"))
query("delta_pinned_version", "SELECT p_partkey, p_size, p_type FROM part")(lambda s, d: delta.read(s, _delta(s, d), 1).select("p_partkey", "p_size", "p_type"))
query("delta_first_version_pruned", "SELECT p_type, count(*) AS n FROM part WHERE p_size <= 10 AND p_type < 'M' GROUP BY p_type")(lambda s, d: delta.read(s, _delta(s, d), 0).where("p_type < 'M'").groupBy("p_type").agg(F.count("*").alias("n")))
query("sink_dataframe_writer_v2", "SELECT s_suppkey, s_nationkey FROM supplier")(lambda s, d: _written(s, table(s, d, "supplier").select("s_suppkey", "s_nationkey")))


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    name = fresh(spark, "v2")
    df.write.mode("errorifexists").format("parquet").saveAsTable(name)
    return spark.table(name)
