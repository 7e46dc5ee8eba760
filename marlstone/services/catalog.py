"""Catalog providers: namespaces and tables from a folder or from a REST catalog, attached as views."""

from __future__ import annotations

import json
import urllib.request
from abc import ABC, abstractmethod
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


class CatalogProvider(ABC):
    """What an external catalog must offer."""

    @abstractmethod
    def list_namespaces(self) -> list[str]: ...

    @abstractmethod
    def list_tables(self, namespace: str) -> list[str]: ...

    @abstractmethod
    def load_table(self, spark: SparkSession, namespace: str, name: str) -> DataFrame: ...

    def table_exists(self, namespace: str, name: str) -> bool:
        return namespace in self.list_namespaces() and name in self.list_tables(namespace)

    def attach(self, spark: SparkSession, namespace: str, prefix: str = "") -> list[str]:
        """A temporary view of each table of a namespace."""
        names = self.list_tables(namespace)
        for name in names:
            self.load_table(spark, namespace, name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in names]


class FolderCatalog(CatalogProvider):
    """Folders of a shared store as namespaces, their name.format entries as tables."""

    def __init__(self, spark: SparkSession, root: str, formats: tuple[str, ...] = ("parquet", "orc", "json", "csv", "delta")):
        self.spark, self.root, self.formats = spark, root.rstrip("/"), formats

    def _entries(self, path: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []

    def list_namespaces(self) -> list[str]:
        return [n for n in self._entries(self.root) if not n.startswith(("_", ".")) and n.rpartition(".")[2] not in self.formats]

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(n.rpartition(".")[0] for n in self._entries(f"{self.root}/{namespace}") if n.rpartition(".")[2] in self.formats)

    def load_table(self, spark: SparkSession, namespace: str, name: str) -> DataFrame:
        from marlstone.sources import delta

        found = [n for n in self._entries(f"{self.root}/{namespace}") if n.rpartition(".")[0] == name and n.rpartition(".")[2] in self.formats]
        if not found:
            raise LookupError(f"no table {namespace}.{name}")
        fmt, path = found[0].rpartition(".")[2], f"{self.root}/{namespace}/{found[0]}"
        return delta.read(spark, path) if fmt == "delta" else spark.read.format(fmt).load(path)


class RestCatalog(CatalogProvider):
    """The public REST catalog protocol's listing and loading calls; tables load by the format that their properties name."""

    def __init__(self, uri: str, token: str | None = None, timeout: float = 30):
        self.uri, self.token, self.timeout = uri.rstrip("/"), token, timeout

    def _get(self, path: str) -> dict:
        request = urllib.request.Request(f"{self.uri}/v1/{path}", headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)

    def list_namespaces(self) -> list[str]:
        return sorted(".".join(n) for n in self._get("namespaces")["namespaces"])

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(x["name"] for x in self._get(f"namespaces/{quote(namespace, safe='')}/tables")["identifiers"])

    def load_table(self, spark: SparkSession, namespace: str, name: str) -> DataFrame:
        meta = self._get(f"namespaces/{quote(namespace, safe='')}/tables/{quote(name, safe='')}")["metadata"]
        return spark.read.format(meta.get("properties", {}).get("provider", "iceberg")).load(meta["location"])
