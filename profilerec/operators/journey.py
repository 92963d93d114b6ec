"""Current funnel stage per user from the trailing session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.functions.ids import format_ts
from profilerec.functions.rules import STAGES, journey_stage
from profilerec.operators.skew import join_per_key

SESSION_MINUTES = 30


def last_events(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def last_event_per_user(interactions: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Latest row per user; ``tie`` makes the order total."""
    newest = F.struct("ts", *tie)
    return interactions.groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.max_by("product_id", newest).alias("last_product_id"),
        F.max_by("event_type", newest).alias("last_event_type"),
    )


def trailing_session(interactions: DataFrame, tie: Sequence[str], minutes: int = SESSION_MINUTES) -> DataFrame:
    """Rows at most ``minutes`` before the user's last event, with ``last_ts``."""
    joined = join_per_key(interactions, last_events(interactions), "user_id", "n_events", ["ts", *tie])
    return joined.where(F.col("ts") >= F.col("last_ts") - F.make_dt_interval(mins=F.lit(minutes)))


def _session_counts() -> list:
    kind = F.col("event_type")
    return [
        F.count_if(kind == "view").alias("session_view_count"),
        F.count_if(kind == "like").alias("session_like_count"),
        F.count_if(kind == "purchase").alias("session_purchase_count"),
        F.count("*").alias("session_total_count"),
    ]


def trailing_session_counts(interactions: DataFrame, tie: Sequence[str], minutes: int = SESSION_MINUTES) -> DataFrame:
    return trailing_session(interactions, tie, minutes).groupBy("user_id").agg(*_session_counts())


def journey_profiles(
    interactions: DataFrame, tie: Sequence[str], minutes: int = SESSION_MINUTES, dormant_days: int = 60
) -> DataFrame:
    """Last event, trailing-session counts, idle days and stage per user."""
    newest = F.struct("ts", *tie)
    latest = interactions.agg(F.max("ts")).scalar()
    tail = trailing_session(interactions, tie, minutes).groupBy("user_id", "last_ts").agg(
        F.max_by("product_id", newest).alias("last_interacted_product_id"),
        F.max_by("event_type", newest).alias("last_interaction_type"),
        *_session_counts(),
    )
    staged = tail.withColumn("days_since_last", F.timestamp_diff("DAY", F.col("last_ts"), latest))
    stage = journey_stage(
        F.col("last_interaction_type"), F.col("days_since_last"), F.col("session_view_count"),
        F.col("session_like_count"), F.col("session_purchase_count"), dormant_days,
    )
    return staged.select(
        "user_id",
        "last_interacted_product_id",
        "last_interaction_type",
        format_ts(F.col("last_ts")).alias("last_interaction_timestamp"),
        "session_view_count", "session_like_count", "session_purchase_count", "session_total_count",
        "days_since_last",
        stage.alias("current_journey_stage"),
        stage.alias("journey_stage"),
    )


def stage_distribution(profiles: DataFrame, stage: str = "current_journey_stage") -> DataFrame:
    """Users and percent per stage, all stages in report order including empty ones."""
    counts = profiles.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    stages = profiles.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("stage_order", "stage")
    )
    users = F.coalesce("n", F.lit(0).cast("bigint"))
    return stages.join(counts, "stage", "left").select(
        "stage_order", "stage", users.alias("n_users"),
        F.round(users * 100.0 / F.nullif(total, F.lit(0)), 1).alias("pct"),
    )
