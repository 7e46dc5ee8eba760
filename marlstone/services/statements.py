"""Statements submitted by text: submit, list, status, result and cancel, by job tags."""

from __future__ import annotations

import threading
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


class Statements:
    """Statements of one session; results are kept up to `rows` rows, for display."""

    def __init__(self, spark: SparkSession, rows: int = 1000):
        self.spark, self.rows = spark, rows
        self.kept: dict[str, dict] = {}

    def submit(self, text: str) -> str:
        key = uuid.uuid4().hex
        state = self.kept[key] = {"id": key, "text": text, "state": "RUNNING", "submitted": time.time(), "error": None, "result": None}

        def run() -> None:
            try:
                self.spark.sparkContext.addJobTag(key)
                df = self.spark.sql(text).limit(self.rows)
                # collect() runs in this thread, which has the tag; Arrow's way would run in another
                rows, schema = df.collect(), to_arrow_schema(df.schema)
                result = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], names=df.columns)
                if state["state"] == "RUNNING":
                    state["result"], state["state"] = result, "FINISHED"
            except Exception as e:  # noqa: BLE001 - reported to the caller through the state
                if state["state"] == "RUNNING":
                    state["state"], state["error"] = "FAILED", str(e)

        state["thread"] = threading.Thread(target=run, daemon=True)
        state["thread"].start()
        return key

    def status(self, key: str) -> dict:
        return {k: v for k, v in self.kept[key].items() if k not in ("thread", "result")}

    def list(self) -> list[dict]:
        return [self.status(k) for k in self.kept]

    def result(self, key: str, fmt: str = "json", wait: float | None = None) -> str:
        """The rows as JSON lines or CSV, once the statement has finished."""
        state = self.kept[key]
        state["thread"].join(wait)
        if state["state"] != "FINISHED":
            raise RuntimeError(state["error"] or state["state"])
        frame = state["result"].to_pandas()
        return frame.to_csv(index=False) if fmt == "csv" else frame.to_json(orient="records", lines=True, date_format="iso")

    def cancel(self, key: str) -> None:
        if self.kept[key]["state"] == "RUNNING":
            self.kept[key]["state"] = "CANCELLED"

            def stop() -> None:
                # a job that starts after the first interrupt must end too
                while self.kept[key]["thread"].is_alive():
                    self.spark.sparkContext.cancelJobsWithTag(key)
                    time.sleep(0.2)

            threading.Thread(target=stop, daemon=True).start()


def catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS")


def tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    return spark.sql(f"SHOW TABLES LIKE '{pattern}'").select("tableName", "isTemporary")


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {name}").select("col_name", "data_type")


def complete(spark: SparkSession, prefix: str) -> list[str]:
    """Names of tables and functions that start with a prefix."""
    found = {t.name for t in spark.catalog.listTables(pattern=f"{prefix}*")} | {f.name for f in spark.catalog.listFunctions(pattern=f"{prefix}*")}
    return sorted(found)
