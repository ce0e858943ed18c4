"""Incremental ingest of theorem files: what is there now, each file once, then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.theorems import expr_table, stream_theorems, transition_table


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Append new files of ``source`` to ``exprs`` and ``trns`` below ``out``.

    A batch overwrites its own folder, so one that runs again after a failure
    leaves the same rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        for name, table in (("exprs", expr_table(batch)), ("trns", transition_table(batch))):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    q = stream_theorems(spark, source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
