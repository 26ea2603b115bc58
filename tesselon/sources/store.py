"""Versioned store: one folder of Parquet tables per version, and a pointer written last."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import NotIndexedError

SCHEMA_VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        at = self._jpath(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written beside and renamed, so a reader sees the old file or the new one."""
        temporary, final = self._jpath(f"{self.path}/.{name}.{time.time_ns()}"), self._jpath(f"{self.path}/{name}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(final, False)
        self._fs.rename(temporary, final)

    def meta(self) -> dict | None:
        """The current version's description; null if there is none or it has another schema."""
        try:
            text = self._read_text("current.json")
            if text is None:
                return None
            value = json.loads(text)
        except (ValueError, Py4JJavaError):  # broken, or its checksum is wrong
            return None
        return value if value.get("schema_version") == SCHEMA_VERSION else None

    def write(self, tables: dict[str, DataFrame], meta: dict) -> dict:
        version = f"v{time.time_ns()}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        old = self.meta()
        meta = {**meta, "schema_version": SCHEMA_VERSION, "version": version, "tables": sorted(tables)}
        self._write_text("current.json", json.dumps(meta))
        if old:
            self._fs.delete(self._jpath(f"{self.path}/{old['version']}"), True)
        return meta

    def read(self, name: str) -> DataFrame:
        meta = self.meta()
        if meta is None or name not in meta["tables"]:
            raise NotIndexedError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/{name}")

    def sizes(self) -> dict[str, int]:
        meta = self.meta()
        if meta is None:
            return {}
        return {t: self._fs.getContentSummary(self._jpath(f"{self.path}/{meta['version']}/{t}")).getLength() for t in meta["tables"]}

    def append_json(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").json(f"{self.path}/{name}")


