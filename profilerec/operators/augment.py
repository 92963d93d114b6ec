"""Noisy copies of rows, reproducible for any partitioning because the noise is a hash of the key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _uniform(*parts: Column) -> Column:
    steps = 2**52
    return (F.pmod(F.xxhash64(*parts), F.lit(steps)).cast("double") + 0.5) / float(steps)


def gaussian(*parts: Column) -> Column:
    """Standard normal draw determined by ``parts``."""
    radius = F.sqrt(-2.0 * F.log(_uniform(*parts, F.lit("radius"))))
    return radius * F.cos(2.0 * math.pi * _uniform(*parts, F.lit("angle")))


def with_copies(df: DataFrame, n_copies: int) -> DataFrame:
    """The rows (copy 0) and ``n_copies`` further copies, numbered by ``copy_id``."""
    return df.withColumn("copy_id", F.explode(F.sequence(F.lit(0), F.lit(n_copies))))


def augment_gaussian(
    df: DataFrame, cols: Sequence[str], key: Sequence[str],
    noise_factor: float = 0.05, n_copies: int = 2, seed: int = 42,
) -> DataFrame:
    """Copies whose numeric columns get N(0, noise_factor * sample deviation); constants stay."""
    spread = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in cols])).scalar()
    parts = [F.col(k) for k in key]

    def noisy(c: str) -> Column:
        draw = gaussian(*parts, F.col("copy_id"), F.lit(c), F.lit(seed))
        noise = draw * F.coalesce(spread[c], F.lit(0.0)) * noise_factor
        return F.when(F.col("copy_id") == 0, F.col(c).cast("double")).otherwise(F.col(c) + noise)

    return with_copies(df, n_copies).withColumns({c: noisy(c) for c in cols})


def augment_interactions(
    df: DataFrame, labels: Sequence[str], key: Sequence[str], n_copies: int = 2,
    noise: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Copies with a jittered event code and a timestamp later by one minute per copy."""
    copies = with_copies(df, n_copies)
    decode = F.array(*[F.lit(v) for v in labels])
    draw = gaussian(*[F.col(k) for k in key], F.col("copy_id"), F.lit(seed)) * noise
    code = F.bround(F.col("event_type_encoded") + draw, 0).cast("int")
    code = F.least(F.greatest(code, F.lit(0)), F.lit(len(labels) - 1))
    code = F.when(F.col("copy_id") == 0, F.col("event_type_encoded")).otherwise(code)
    return copies.withColumn("event_type_encoded", code).withColumns(
        {
            "event_type": F.element_at(decode, F.col("event_type_encoded") + 1),
            "ts": F.col("ts") + F.make_dt_interval(mins=F.col("copy_id")),
        }
    )
