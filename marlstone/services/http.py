"""Statements over HTTP and as tools of a model context protocol server; application status beside them.

GET /catalogs, /statements, /statements/ID, /statements/ID/result?format=csv, /api/v1/applications...;
POST /statements {"statement": TEXT}, POST /mcp (JSON-RPC); DELETE /statements/ID.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from marlstone.services.statements import Statements

TOOLS = {
    "run_sql": ("Submit a statement and give its id.", {"statement": "string"}), "statement_status": ("State of a statement.", {"id": "string"}),
    "list_statements": ("All statements of this session.", {}), "cancel_statement": ("Cancel a statement.", {"id": "string"}), "statement_result": ("Rows as JSON lines.", {"id": "string"}),
}


def applications(spark: SparkSession) -> list[dict]:
    sc = spark.sparkContext
    return [{"id": sc.applicationId, "name": sc.appName, "attempts": [{"startTimeEpoch": sc.startTime, "sparkUser": sc.sparkUser(), "completed": False, "appSparkVersion": spark.version}]}]


def activity(spark: SparkSession, what: str) -> list[dict]:
    """Active jobs or stages, or executors, by the status tracker."""
    tracker = spark.sparkContext.statusTracker()
    if what == "jobs":
        found = ((j, tracker.getJobInfo(j)) for j in tracker.getActiveJobsIds())
        return [{"jobId": j, "status": i.status, "stageIds": list(i.stageIds)} for j, i in found if i]
    if what == "stages":
        found = ((s, tracker.getStageInfo(s)) for s in tracker.getActiveStageIds())
        return [{"stageId": s, "name": i.name, "numTasks": i.numTasks, "numActiveTasks": i.numActiveTasks, "numCompleteTasks": i.numCompletedTasks, "numFailedTasks": i.numFailedTasks} for s, i in found if i]
    if what == "executors":
        hosts = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
        return [{"hostPort": f"{h.host()}:{h.port()}", "activeTasks": h.numRunningTasks()} for h in hosts]
    raise LookupError(what)


def call_tool(statements: Statements, name: str, arguments: dict) -> object:
    if name == "run_sql":
        return {"id": statements.submit(arguments["statement"])}
    if name == "list_statements":
        return statements.list()
    if name == "statement_status":
        return statements.status(arguments["id"])
    if name == "statement_result":
        return statements.result(arguments["id"])
    if name == "cancel_statement":
        statements.cancel(arguments["id"])
        return statements.status(arguments["id"])
    raise LookupError(name)


def answer_rpc(statements: Statements, request: dict) -> dict:
    """One JSON-RPC request of the model context protocol."""
    base = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return base | {"result": {"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "marlstone", "version": "1"}}}
    if method == "tools/list":
        return base | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": list(p)}} for n, (d, p) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            text = call_tool(statements, params["name"], params.get("arguments") or {})
            return base | {"result": {"content": [{"type": "text", "text": text if isinstance(text, str) else json.dumps(text)}], "isError": False}}
        except (LookupError, RuntimeError) as e:
            return base | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    return base | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not running yet; call serve_forever() in a thread."""
    statements = Statements(spark)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            pass

        def send(self, value: object, code: int = 200, kind: str = "application/json") -> None:
            body = value.encode() if isinstance(value, str) else json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handle_(self, act) -> None:
            try:
                act()
            except LookupError as e:
                self.send({"error": f"not found: {e}"}, 404)
            except (RuntimeError, ValueError) as e:
                self.send({"error": str(e)}, 409)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            parts = [p for p in url.path.split("/") if p]

            def act() -> None:
                if parts == ["catalogs"]:
                    self.send([c.name for c in spark.catalog.listCatalogs()])
                elif parts[:3] == ["api", "v1", "applications"]:
                    self.send(applications(spark) if len(parts) == 3 else activity(spark, parts[-1]))
                elif parts[:1] != ["statements"]:
                    raise LookupError(url.path)
                elif len(parts) == 1:
                    self.send(statements.list())
                elif len(parts) == 2:
                    self.send(statements.status(parts[1]))
                else:
                    fmt = parse_qs(url.query).get("format", ["json"])[0]
                    self.send(statements.result(parts[1], fmt), kind="text/csv" if fmt == "csv" else "application/x-ndjson")

            self.handle_(act)

        def do_POST(self) -> None:
            def act() -> None:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if self.path == "/mcp":
                    self.send(answer_rpc(statements, body))
                elif self.path == "/statements":
                    self.send({"id": statements.submit(body["statement"])}, 201)
                else:
                    raise LookupError(self.path)

            self.handle_(act)

        def do_DELETE(self) -> None:
            def act() -> None:
                key = self.path.rstrip("/").rpartition("/")[2]
                statements.cancel(key)
                self.send(statements.status(key))

            self.handle_(act)

    return ThreadingHTTPServer((host, port), Handler)
