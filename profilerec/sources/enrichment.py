"""Answers of paid or slow text models, kept across runs in an append-only keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EnrichmentStore:
    """(cache_key, values) in batches below ``path``, a folder that driver and executors share.

    A batch is one folder of Parquet files, named by a fingerprint of its keys: adding the same keys again
    writes the same folder, so a repeated run or a retried commit leaves one batch. A batch counts once its
    files are complete; what a broken write leaves is ignored and replaced by the next try. Batches are never
    rewritten. If two batches answer one key, the batch whose name comes first counts.
    """

    def __init__(self, spark: SparkSession, path: str, values: Sequence[str]):
        self.spark, self.path, self.values = spark, path.rstrip("/"), list(values)
        self.schema = ", ".join(f"`{c}` string" for c in ("cache_key", *self.values))

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath() for s in files.listStatus(folder) if s.isDirectory()]
        return sorted(str(p) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """(cache_key, values) of all complete batches, one row per key."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(self.schema).parquet(*batches).withColumn("from", F.input_file_name())
        first = stored.groupBy("cache_key").agg(F.min_by(F.struct(*self.values), "from").alias("v"))
        return first.select("cache_key", *[F.col("v")[c].alias(c) for c in self.values])

    def append(self, answers: DataFrame) -> DataFrame:
        """Adds (cache_key, values) rows as one batch and returns them read back; no rows add no batch."""
        marks = answers.agg(F.count("*").alias("n"), F.sum(F.xxhash64("cache_key").cast("decimal(38,0)")).alias("s")).first()
        if not marks["n"]:
            return self.spark.createDataFrame([], self.schema)
        target = f"{self.path}/batch-{marks['n']}-{int(marks['s']) % 2**64:016x}"
        answers.select("cache_key", *self.values).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)
