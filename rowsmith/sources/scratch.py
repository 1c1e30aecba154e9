"""Where queries and tests put files: the folder that all of a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from rowsmith.errors import IncorrectOption


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of `spark.checkpoint.dir`; a temporary one only where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise IncorrectOption("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/rowsmith-{os.getpid()}"
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what a scratch path holds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package also where the driver found it through sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
