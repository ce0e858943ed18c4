"""Sessions: defaults for local runs, and the package's own code for workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of one batch between Spark and Python, about.
BATCH_BYTES = 4 << 20


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "dagloom") -> SparkSession:
    """A local session with adaptive execution on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Batches between Spark and Python are bounded by bytes, as texts may be long:
    executors hold them on both sides.  A session's own smaller bound is kept.
    """
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower().rstrip("b")
    size = int(bound.rstrip("kmg") or 0) << {"k": 10, "m": 20, "g": 30}.get(bound[-1:], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    at = os.path.join(tempfile.mkdtemp(prefix="dagloom-code-"), "dagloom_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)
