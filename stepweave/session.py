"""A session for local use, and what any session needs to run this package's Python code on its workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("stepweave")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this file system import the package, wherever the driver was started."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own if there is one machine, else an error."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="stepweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
