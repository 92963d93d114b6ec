"""Session defaults and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "profilerec", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and a UTC session zone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where nothing is set, a local master gets a fresh local folder; any other master is an error,
    because executors on other machines would not see what is written there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="profilerec-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/profilerec/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str = "step"):
    """The rows as a new table in the shared folder; the result survives the loss of any executor.

    A written table also gives the next plan real sizes, and unlike a checkpoint carries none of
    the partitioning and constraints of the old plan, which grow in iterative operators.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StepTables:
    """Intermediate tables of one operator run; each is dropped as soon as later ones replace it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[str, str] = {}

    def write(self, df, name: str):
        """Writes ``df`` below the shared folder and returns the table read back; replaces ``name``."""
        path = scratch_path(self.spark, f"{self.name}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables; frames that still read them can no longer be used."""
        for name in names:
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
