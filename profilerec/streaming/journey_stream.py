"""Streaming forms: running journey stages, activity windows and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from profilerec.functions.rules import journey_stage
from profilerec.operators.journey import SESSION_MINUTES

_COUNTED = ("view", "like", "purchase")
_OUTPUT = (
    "user_id string, last_interacted_product_id string, last_interaction_type string, last_ts timestamp, "
    "session_view_count bigint, session_like_count bigint, session_purchase_count bigint, "
    "session_total_count bigint, idle boolean"
)
# Per user: newest event, and counts per timestamp and type of the trailing window.
_STATE = (
    "last_micros bigint, last_order bigint, last_product string, last_type string, "
    "at array<bigint>, kind array<string>, n array<bigint>"
)


def event_stream(spark: SparkSession, directory: str, file_filter: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a directory as a stream; zone-less timestamps become session-zone ones."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, order: str, minutes: int = SESSION_MINUTES, idle_days: int = 60) -> DataFrame:
    """One row per user and batch: newest event and counts of its trailing session.

    ``events`` has user_id, product_id, event_type, ts and a numeric ``order`` that breaks ties.
    The state of a user is a count per distinct timestamp of the last ``minutes``, so repeats do
    not grow it. After ``idle_days`` of event time without an event the user is emitted once more
    as idle and the state is dropped. Put a watermark on ``events`` first.
    """
    span = minutes * 60 * 1_000_000
    wait = idle_days * 86_400_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, kept = (None, None, None, None), {}
        if state.exists:
            saved = state.get
            newest = tuple(saved[:4])
            kept = dict(zip(zip(saved[4], saved[5]), saved[6]))
        if state.hasTimedOut:
            state.remove()
            yield _session_row(key[0], newest, kept, True)
            return
        for pdf in batches:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            top = pdf.assign(micros=micros).sort_values(["micros", "ord"]).iloc[-1]
            candidate = (int(top["micros"]), int(top["ord"]), top["product_id"], top["event_type"])
            if newest[0] is None or candidate[:2] > newest[:2]:
                newest = candidate
            counts = pd.Series(1, index=pd.MultiIndex.from_arrays([micros, pdf["event_type"]])).groupby(level=[0, 1]).sum()
            for (at, kind), n in counts.items():
                kept[(int(at), kind)] = kept.get((int(at), kind), 0) + int(n)
        kept = {k: n for k, n in kept.items() if k[0] >= newest[0] - span}
        state.update((*newest, [k[0] for k in kept], [k[1] for k in kept], list(kept.values())))
        state.setTimeoutTimestamp(max(newest[0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield _session_row(key[0], newest, kept, False)

    rows = events.select("user_id", "product_id", "event_type", "ts", F.col(order).cast("bigint").alias("ord"))
    return rows.groupBy("user_id").applyInPandasWithState(
        update, _OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def _session_row(user: str, newest: tuple, kept: dict, idle: bool) -> pd.DataFrame:
    per_type = {t: sum(n for (_at, kind), n in kept.items() if kind == t) for t in _COUNTED}
    return pd.DataFrame({
        "user_id": [user], "last_interacted_product_id": [newest[2]], "last_interaction_type": [newest[3]],
        "last_ts": [pd.Timestamp(newest[0], unit="us")],
        **{f"session_{t}_count": [per_type[t]] for t in _COUNTED},
        "session_total_count": [sum(kept.values())], "idle": [idle],
    })


def journey_stream(events: DataFrame, order: str, minutes: int = SESSION_MINUTES, dormant_days: int = 60) -> DataFrame:
    """Current stage per user after each batch; an idle user is Dormant."""
    rows = sessions(events, order, minutes, dormant_days)
    days = F.when(F.col("idle"), F.lit(dormant_days)).otherwise(F.lit(0))
    return rows.withColumn("current_journey_stage", journey_stage(
        F.col("last_interaction_type"), days, F.col("session_view_count"), F.col("session_like_count"),
        F.col("session_purchase_count"), dormant_days))


def activity_windows(events: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str = "30 minutes",
                     gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Event counts per window: tumbling, sliding or session (per user)."""
    if watermark and events.isStreaming:
        events = events.withWatermark("ts", watermark)
    if kind == "session":
        keys = [F.session_window("ts", gap).alias("w"), "user_id"]
    elif kind == "sliding":
        keys = [F.window("ts", size, slide).alias("w"), "event_type"]
    else:
        keys = [F.window("ts", size).alias("w"), "event_type"]
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys[1:], "n")


def dedupe_stream(events: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """First row per key within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains the stream into a parquet table and returns it; each batch adds its number as ``batch``."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
