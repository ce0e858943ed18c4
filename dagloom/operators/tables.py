"""Tables written once and read by several branches of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
_CHOSEN: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without a scheme is of the session's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, with its scheme.

    Where the session names none, a local session gets a temporary folder and
    any other one a folder below ``spark.sql.warehouse.dir``, which executors
    share too.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _CHOSEN:
            local = spark.sparkContext.master.startswith("local")
            _CHOSEN[app] = "file://" + tempfile.mkdtemp(prefix="dagloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_dagloom"
        at = _CHOSEN[app]
    return qualified(spark, at)


def settle(df: DataFrame, what: str = "settled") -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back.

    What follows starts from files, so a lost executor costs a re-read and a
    plan with several branches does not compute them again.  The table is removed
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df``, which is cheap to count, has ``rows`` rows or fewer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
