"""Row order at scale: positions, ordered fills, temporal splits and bounded heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.operators.stats import kth_value
from profilerec.session import cut_lineage

def global_row_index(df: DataFrame, order: Sequence, name: str = "row_index") -> DataFrame:
    """0-based position in a total order, as ``name``; all other columns stay as they are.

    The table is range partitioned and written once, because range bounds are sampled again on every
    run; then each partition is numbered on its own and shifted by the count of those before it.
    """
    part, local, offset, n = free_names(df.columns, "part", "local", "offset", "n")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part).agg(F.count("*").alias(n))
        .select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    )
    number = F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1
    numbered = placed.withColumn(local, number).join(F.broadcast(offsets), part)
    return numbered.select(
        *[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(offset) + F.col(local)).cast("bigint").alias(name)
    )


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names for working columns that none of ``taken`` can clash with, whatever their case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + w for w in wanted]


def index_within(
    df: DataFrame, key: str, ts: str, tie: Sequence[str], grain: str = "hour"
) -> DataFrame:
    """1-based time position of every row within its key (``_idx``) and the key's size (``_total``).

    Rows are numbered per (key, time slice) and shifted by the key's earlier slices, so a key with
    a large share of the rows is spread over as many tasks as it has slices. Rows without a time
    come first, in the order of ``tie``; rows without a key are one key.
    """
    sliced = df.withColumn("_slice", F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz"))
    counts = sliced.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    per_key = W.partitionBy(key)
    offsets = counts.select(
        F.col(key).alias("_key"), F.col("_slice").alias("_of"),
        F.coalesce(
            F.sum("_n").over(per_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(per_key).alias("_total"),
    )
    local = F.row_number().over(W.partitionBy(key, "_slice").orderBy(ts, *tie))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_of")))
        .withColumn("_idx", F.col("_offset") + F.col("_local"))
        .drop("_slice", "_local", "_offset", "_key", "_of")
    )


def per_user_split(
    df: DataFrame, ts: str, tie: Sequence[str], ratio: float = 0.8, key: str = "user_id"
) -> DataFrame:
    """Adds ``split``: the first int(n * ratio) rows of each user train, the rest test."""
    cut = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(ratio)))
    cut = F.least(cut, F.col("_total") - 1)
    return (
        index_within(df, key, ts, tie)
        .withColumn("split", F.when((F.col("_total") < 2) | (F.col("_idx") <= cut), "train").otherwise("test"))
        .drop("_idx", "_total")
    )


def global_split(df: DataFrame, ts: str, tie: Sequence[str], ratio: float = 0.8) -> DataFrame:
    """Adds ``split``: the first int(n * ratio) rows in (ts, tie) order train, the rest test.

    The boundary row is found by counting, so the split is a filter and moves no rows. ``tie`` are
    numeric columns that make the order total. Rows without a time do not count and are train.
    """
    n = df.where(F.col(ts).isNotNull()).count()
    if not n:
        return df.withColumn("split", F.lit("train"))
    last = max(1, min(n - 1, int(n * ratio))) - 1
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    inside, train = df.where(F.col(ts).isNotNull()), F.col(ts).isNull()
    prefix = F.lit(True)
    for i, value in enumerate([micros, *[F.col(c) for c in tie]]):
        boundary, below, equal = kth_value(inside, value, last)
        train = train | (prefix & (value < F.lit(boundary)))
        last -= below
        if last == equal - 1 or i == len(tie):
            train = train | (prefix & (value == F.lit(boundary)))
            break
        inside = inside.where(value == F.lit(boundary))
        prefix = prefix & (value == F.lit(boundary))
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def fill_ordered(df: DataFrame, cols: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """Forward fill, then backward fill, in the order of a unique numeric column.

    Rows are cut into equally filled slices of ``order``. A slice only needs the last known value
    of the slices before it, one row per slice; rows with no known value before them take the
    first known value of the table.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(order, probs, 1.0 / (4 * buckets)))) if probs else []
    splits = [-float("inf"), *bounds, float("inf")]
    if bounds:
        sliced = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice").transform(
            df.withColumn("_order", F.col(order).cast("double"))
        ).drop("_order")
    else:
        sliced = df.withColumn("_slice", F.lit(0.0))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    known = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in cols}
    last_known = sliced.groupBy("_slice").agg(*[F.max_by(c, known[c]).alias(f"_last_{c}") for c in cols])
    carried = last_known.select(
        "_slice", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in cols]
    )
    first_known = df.agg(F.struct(*[F.min_by(c, known[c]).alias(c) for c in cols])).scalar()
    so_far = W.partitionBy("_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(so_far), F.col(f"_carry_{c}"), first_known[c]
        )
        for c in cols
    }
    return sliced.join(F.broadcast(carried), "_slice").select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return head_per_group(df, keys, order, 1).drop("rank")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first in the order of all plain columns."""
    plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "vector", "binary"))]
    return first_per_key(df, [key], plain)


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; every task keeps at most ``n`` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Fixed-size random sample that does not depend on the partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)


def limit_users(users: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    return users.select(key).distinct().orderBy(key).limit(n) if n > 0 else users.select(key).distinct()
