"""Equi-joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
SALTS = 256


def join_hot(
    rows: DataFrame,
    other: DataFrame,
    key: str | Sequence[str],
    weights: DataFrame,
    weight: str,
    salt_on: Sequence[str],
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join of ``rows`` with a much smaller ``other``; ``weights`` holds rows per key.

    Keys above ``hot_share`` of all rows are spread over ``salts`` sub-keys and their few rows of
    ``other`` are repeated per sub-key. At most ``1 / hot_share`` keys can be that heavy, so
    broadcasting their names is bounded whatever the data size. ``salt_on`` are columns that tell
    the rows of one key apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total = weights.agg(F.sum(weight)).scalar()
    hot = F.broadcast(
        weights.where(F.col(weight) > total * F.lit(hot_share)).select(*keys, F.lit(True).alias("_hot"))
    )
    row_salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")).otherwise(0)
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", row_salt).drop("_hot")
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_per_key(
    rows: DataFrame, per_key: DataFrame, key: str | Sequence[str], weight: str, salt_on: Sequence[str]
) -> DataFrame:
    """:func:`join_hot` where ``other`` has one row per key and carries its own weight."""
    return join_hot(rows, per_key.drop(weight), key, per_key, weight, salt_on)
