"""Target-distribution importance resampling: documents drawn by the likelihood ratio of hashed n-grams.

Tasks run Arrow kernels over whole batches of texts: ``ascii_lower``, ``split_pattern_regex`` at the characters
between words, ``list_flatten`` and ``dictionary_encode``. Runs of words are pairs of dictionary indices, each
shifted against the one before; only distinct pairs are spelled out and hashed (CRC-32 of the UTF-8 bytes,
modulo the bucket count), and ``take`` gives every run its bucket. A bucket's gain is the logarithm of its
smoothed share in the target texts over its share in all documents; the weight of a document is the floored
mean of its gains. Gumbel noise from a hash of the document's id makes the draw of the highest scores a
weighted sample without replacement that does not depend on the partitioning.

The only table that travels with tasks has one gain per bucket. The drawn rows are numbered by a range
partition, however many they are.

Defined results: null and empty texts have no features and weight 0. A null id is hashed as empty text and
comes last among equal scores. Repeated rows are scored and drawn each on its own. An empty table gives no
rows; an empty target gives every bucket the count 0. Other columns of the documents are kept, but for those
named like an added one, which are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.session import StepTables

#: What lies between words: ASCII but for digits and letters (texts are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleOptions:
    """``grams`` longest run of words; ``least_words`` of a document that can be drawn; ``percent`` of these to draw."""

    grams: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


class Features:
    """Words and buckets of a batch of texts."""

    def __init__(self, texts: pa.Array, options: ResampleOptions):
        n = len(texts)
        words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
        row, flat = pc.list_parent_indices(words), pc.list_flatten(words)
        real = pc.not_equal(flat, "")  # a text that begins or ends between words
        row = row.filter(real).to_numpy(zero_copy_only=False)
        coded = flat.filter(real).dictionary_encode()
        self.n_words = np.bincount(row, minlength=n)
        plain, first = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelled, index = plain, first
        rows, buckets = [row], [self._take(spelled, index, options.buckets)]
        for size in range(2, options.grams + 1):
            whole = row[: len(row) - size + 1] == row[size - 1 :] if len(row) >= size else np.zeros(0, bool)
            # An n-gram is the n-gram before it, by index, and one word more.
            pair = index[: len(whole)] * len(plain) + first[size - 1 :]
            known, at = np.unique(pair[whole], return_inverse=True)
            spelled = [f"{spelled[p // len(plain)]} {plain[p % len(plain)]}" for p in known.tolist()]
            index = np.zeros(len(whole), np.int64)
            index[whole] = at
            rows.append(row[: len(whole)][whole])
            buckets.append(self._take(spelled, at, options.buckets))
        self.row, self.bucket = np.concatenate(rows), np.concatenate(buckets)
        if options.grams > 1:
            order = np.argsort(self.row, kind="stable")
            self.row, self.bucket = self.row[order], self.bucket[order]
        self.n_features = np.bincount(self.row, minlength=n)

    @staticmethod
    def _take(distinct: list[str], index: np.ndarray, buckets: int) -> np.ndarray:
        hashed = np.fromiter((zlib.crc32(g.encode()) % buckets for g in distinct), np.int64, len(distinct))
        return hashed[index] if len(distinct) else np.zeros(0, np.int64)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of gains per text: one segment per text with features."""
        out = np.zeros(len(self.n_features), np.int64)
        some = np.flatnonzero(self.n_features)
        if len(some):
            starts = (np.cumsum(self.n_features) - self.n_features)[some]
            out[some] = np.add.reduceat(gains[self.bucket], starts)
        return out


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    texts = batch.column(batch.schema.get_field_index(column))
    for first, n, data, offsets in tokens.groups(texts):
        # Built anew from zero: the kernels lower and split a slice of a column wrongly.
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        yield batch.slice(first, n), pa.Array.from_buffers(pa.large_string(), n, buffers)


def bucket_counts(texts: DataFrame, options: ResampleOptions) -> DataFrame:
    """(bucket, n) of all n-grams of ``text``; a task sends at most one row per bucket."""

    def count(batches):
        total = np.zeros(options.buckets, np.int64)
        for batch in batches:
            for _, piece in _pieces(batch, "text"):
                total += np.bincount(Features(piece, options).bucket, minlength=options.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, options: ResampleOptions) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed target share over its share in all documents."""
    count = np.zeros((2, options.buckets), np.int64)
    for side, texts in enumerate((target, docs)):
        for r in bucket_counts(texts, options).toLocalIterator():  # one row per bucket, at most
            count[side, r["bucket"]] = r["n"]
    (t, s), k = count, options.buckets
    big_t, big_s = int(t.sum()), int(s.sum())
    return np.array([
        math.floor(1000 * math.log(((int(a) + 1) * float(big_s + k)) / ((int(b) + 1) * float(big_t + k)))) for a, b in zip(t, s)
    ], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, options: ResampleOptions | None = None) -> DataFrame:
    """All rows of ``docs`` with n_words, n_features and weight."""
    options = options or ResampleOptions()
    added = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        for batch in batches:
            for piece, texts in _pieces(batch, "text"):
                found = Features(texts, options)
                weight = found.sums(gains) // np.maximum(found.n_features, 1)
                columns = [pa.array(c, pa.int64()) for c in (found.n_words, found.n_features, weight)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*kept, *added])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in added]]))


def noisy_score(weight, seed: int):
    """The weight with Gumbel noise, in thousandths, from the first 32 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return (weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, options: ResampleOptions | None = None, with_text: bool = True) -> DataFrame:
    """Documents with n_words, n_features, weight, score and rank; rank is null for those not drawn.

    ``rank`` counts 1, 2, 3 ... from the highest score down, equal scores by id. The result reads a
    table in the shared folder.
    """
    options = options or ResampleOptions()
    steps = StepTables(docs.sparkSession, "resample")
    weighed = weigh(docs, bucket_gains(docs, target, options), options)
    scored = weighed.withColumn("score", noisy_score(F.col("weight"), options.seed))
    if not with_text:
        scored = scored.drop("text")
    kept = [c for c in scored.columns if c != "rank"]
    scored = scored.select(*[F.col(f"`{c}`") for c in kept])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = steps.write(scored, "scored")
    fit = F.col("n_words") >= options.least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_words")]
    ranged = steps.write(
        written.where(fit).repartitionByRange(parts, *order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("part")), "ranged"
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    totals = counts.select(
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"),
        F.floor(F.sum("n").over(W.partitionBy()) * options.percent / 100).alias("draw"),
    )
    local = F.row_number().over(W.partitionBy("part").orderBy(F.desc("row.score"), F.asc_nulls_last("row.doc_id"), "row.n_words"))
    # One row per range partition: a bounded broadcast.
    placed = ranged.withColumn("local", local).join(F.broadcast(totals), "part").withColumn("at", F.col("skip") + F.col("local"))
    ranked = placed.select("row.*", F.when(F.col("at") <= F.col("draw"), F.col("at")).cast("long").alias("rank"))
    return ranked.unionByName(written.where(~fit).withColumn("rank", F.lit(None).cast("long")))
