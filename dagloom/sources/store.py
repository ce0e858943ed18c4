"""Parquet stores with immutable runs and one manifest that names the current one."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables of a pipeline below one URI; a publication swaps the manifest in one step."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.fs, self.path = fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.path, recursive=True)

    def manifest(self) -> dict:
        at = f"{self.path}/manifest.json"
        if self.fs.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def publish(self, stage: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
        """Write all tables of a stage to a new run, then name it in the manifest."""
        run = f"run-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.uri}/{stage}/{run}/{name}")
        now = self.manifest() | {stage: {"run": run, "tables": sorted(tables), "settings": settings or {}}}
        tmp = f"{self.path}/manifest-{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(tmp) as f:
            f.write(json.dumps(now, sort_keys=True).encode())
        self.fs.move(tmp, f"{self.path}/manifest.json")

    def done(self, stage: str, settings: dict | None = None) -> bool:
        """Whether the stage was published with these settings."""
        got = self.manifest().get(stage)
        return got is not None and got["settings"] == (settings or {})

    def read(self, stage: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{stage}/{self.manifest()[stage]['run']}/{table}")

    def remaining(self, paths: DataFrame, stage: str, table: str, column: str = "path") -> DataFrame:
        """Rows of ``paths`` that a published table does not have yet."""
        if stage not in self.manifest():
            return paths
        return paths.join(self.read(stage, table).select(column).distinct(), column, "left_anti")


def partition_sink(df: DataFrame, roles: DataFrame, out: str) -> None:
    """Rows by the role of their theorem, one folder per role."""
    df.join(roles, "thm").write.partitionBy("role").parquet(out)


def exact_json(counts: dict[str, int]) -> str:
    """JSON in which naturals beyond 2^53 are hex strings."""
    return json.dumps({k: v if v < 1 << 53 else hex(v) for k, v in counts.items()}, sort_keys=True)


def summary(df: DataFrame) -> DataFrame:
    """Rows and bytes of every binary or string column."""
    sized = [c for c, t in df.dtypes if t in ("string", "binary")]
    return df.agg(F.count("*").alias("rows"), *[F.sum(F.octet_length(c)).alias(f"{c}_bytes") for c in sized])
