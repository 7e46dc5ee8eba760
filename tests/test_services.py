"""Delta logs, catalog providers, statements over HTTP and as tools, the command line, redaction."""

import json
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from marlstone.__main__ import main, statements_of
from marlstone.services.catalog import FolderCatalog, RestCatalog
from marlstone.services.http import answer_rpc, serve
from marlstone.services.statements import Statements
from marlstone.sources import delta
from marlstone.sources.sinks import show_string


def test_delta_versions_checkpoints_and_pruning(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "id % 3 AS part")
    assert [delta.write(rows(0, 10), path, ["part"]), delta.write(rows(10, 20), path, ["part"]), delta.write(rows(5, 8), path, ["part"], overwrite=True), delta.write(rows(90, 91), path, ["part"])] == [0, 1, 2, 3]
    read = lambda v=None: sorted(r.id for r in delta.read(spark, path, v).collect())
    assert read() == [5, 6, 7, 90] and read(1) == list(range(20)) and read(0) == list(range(10)) and read(2) == [5, 6, 7]
    plan = delta.read(spark, path, 0).where("part = 1")
    assert "PartitionFilters: [isnotnull(part#" in plan._jdf.queryExecution().toString() and sorted(r.id for r in plan.collect()) == [1, 4, 7]
    assert delta.checkpoint(spark, path) == 3
    for v in (0, 1, 2):
        (tmp_path / f"t/_delta_log/{v:020d}.json").unlink()
    assert delta.write(rows(100, 102), path, ["part"]) == 4 and read() == [5, 6, 7, 90, 100, 101] and read(3) == [5, 6, 7, 90]
    with pytest.raises(ValueError):
        delta.read(spark, path, 1)


def test_folder_catalog(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/ns/a.parquet")
    spark.range(4).write.json(f"{tmp_path}/ns/b.json")
    delta.write(spark.range(5), f"{tmp_path}/ns/c.delta")
    c = FolderCatalog(spark, str(tmp_path))
    assert c.list_namespaces() == ["ns"] and c.list_tables("ns") == ["a", "b", "c"] and c.table_exists("ns", "a") and not c.table_exists("no", "a")
    assert c.attach(spark, "ns", "cat_") == ["cat_a", "cat_b", "cat_c"]
    assert [spark.table(f"cat_{t}").count() for t in "abc"] == [3, 4, 5]
    with pytest.raises(LookupError):
        c.load_table(spark, "ns", "zz")


def test_rest_catalog(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/t")
    answers = {
        "/v1/namespaces": {"namespaces": [["db"], ["db", "inner"]]}, "/v1/namespaces/db/tables": {"identifiers": [{"namespace": ["db"], "name": "t"}]},
        "/v1/namespaces/db/tables/t": {"metadata": {"location": f"{tmp_path}/t", "properties": {"provider": "parquet"}}},
    }

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            body = json.dumps(answers[self.path]).encode()
            self.send_response(200 if self.headers["Authorization"] == "Bearer x" else 401)
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = RestCatalog(f"http://127.0.0.1:{server.server_port}", "x")
    assert c.list_namespaces() == ["db", "db.inner"] and c.table_exists("db", "t") and c.load_table(spark, "db", "t").count() == 7
    with pytest.raises(urllib.error.HTTPError):
        RestCatalog(f"http://127.0.0.1:{server.server_port}").list_namespaces()
    server.shutdown()


def test_statements_over_http(spark):
    server = serve(spark)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, method=None):
        request = urllib.request.Request(top + path, data=None if body is None else json.dumps(body).encode(), method=method)
        with urllib.request.urlopen(request, timeout=60) as a:
            return a.read().decode()

    key = json.loads(ask("/statements", {"statement": "SELECT 1 AS a, 'x' AS b"}))["id"]
    assert ask(f"/statements/{key}/result?format=csv") == "a,b\n1,x\n" and json.loads(ask(f"/statements/{key}/result")) == {"a": 1, "b": "x"}
    assert json.loads(ask(f"/statements/{key}"))["state"] == "FINISHED" and key in [s["id"] for s in json.loads(ask("/statements"))]
    assert json.loads(ask("/api/v1/applications"))[0]["id"] == spark.sparkContext.applicationId and json.loads(ask("/api/v1/applications/x/executors"))
    assert "spark_catalog" in json.loads(ask("/catalogs"))
    assert len(json.loads(ask("/mcp", {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}))["result"]["tools"]) == 5
    for path, code in (("/statements/none", 404), ("/other", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == code
    bad = json.loads(ask("/statements", {"statement": "SELECT nothing"}))["id"]
    with pytest.raises(urllib.error.HTTPError) as e:
        ask(f"/statements/{bad}/result")
    assert e.value.code == 409
    server.shutdown()


def test_cancel_and_tools(spark):
    s = Statements(spark)
    key = json.loads(answer_rpc(s, {"id": 1, "method": "tools/call", "params": {"name": "run_sql", "arguments": {"statement": "SELECT count(*) FROM range(100000000000) WHERE hash(id) % 7 = 3"}}})["result"]["content"][0]["text"])["id"]
    got = answer_rpc(s, {"id": 2, "method": "tools/call", "params": {"name": "cancel_statement", "arguments": {"id": key}}})
    assert json.loads(got["result"]["content"][0]["text"])["state"] == "CANCELLED"
    s.kept[key]["thread"].join(60)
    assert not s.kept[key]["thread"].is_alive()
    assert answer_rpc(s, {"id": 3, "method": "tools/call", "params": {"name": "statement_status", "arguments": {"id": "none"}}})["result"]["isError"]
    assert answer_rpc(s, {"id": 4, "method": "nope"})["error"]["code"] == -32601 and answer_rpc(s, {"id": 5, "method": "initialize"})["result"]["serverInfo"]["name"] == "marlstone"


def test_command_line(spark, tmp_path, capsys, sf_dir):
    assert statements_of("SELECT ';' AS a; -- x; y\nSELECT `b;` ; ;") == ["SELECT ';' AS a", "SELECT `b;`"]
    assert main(["sql", "-e", "SELECT 1 AS a; SELECT 'q' AS b", "--format", "csv"]) == 0
    assert capsys.readouterr().out == "a\n1\nb\nq\n"
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM region")
    assert main(["sql", "-f", str(tmp_path / "q.sql"), "--format", "json", "--data", sf_dir]) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 5}
    assert main(["sql", "-e", "SELECT 2 AS two"]) == 0 and "|two|" in capsys.readouterr().out


def test_show_and_redaction(spark):
    from marlstone.session import DEFAULTS

    assert show_string(spark.sql("SELECT 1 AS a"), 5) == "+---+\n|  a|\n+---+\n|  1|\n+---+\n"
    before = spark.conf.get("spark.sql.redaction.string.regex", None)
    spark.conf.set("spark.sql.redaction.string.regex", DEFAULTS["spark.sql.redaction.string.regex"])
    try:
        text = spark.range(1).selectExpr("'password=hunter2' AS p", "id").where("concat('token=', id) <> 'token=abc'")._jdf.queryExecution().toString()
        assert "hunter2" not in text
    finally:
        spark.conf.unset("spark.sql.redaction.string.regex") if before is None else spark.conf.set("spark.sql.redaction.string.regex", before)


@pytest.mark.parametrize("name,pushed,exchanges", [("tpch_q3", "PushedFilters: [IsNotNull", 12), ("tpch_q5", "PushedFilters: [IsNotNull", 16), ("tpch_q18", "PushedFilters", 16), ("tpch_q21", "PushedFilters: [IsNotNull", 18)])
def test_plans_push_filters_and_have_no_products(spark, sf_dir, name, pushed, exchanges):
    from marlstone.plans.registry import QUERIES, load

    QUERIES or load()
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan and "CartesianProduct" not in plan and "Python" not in plan and plan.count("Exchange") <= exchanges
