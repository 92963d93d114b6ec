"""Streaming queries over the event file, drained once and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.profiles import JOURNEY_EV
from profilerec.catalog.registry import EV, register
from profilerec.session import scratch_path
from profilerec.sources import adapters as A
from profilerec.streaming import journey_stream as S


def stream(spark, sf):
    raw = A.table(spark, sf, "events")
    events = S.event_stream(spark, sf, "events.parquet", raw.schema)
    return events.select(*A.event_columns())


def drained(spark, df, name, mode="append"):
    return S.run_to_table(df, scratch_path(spark, name), scratch_path(spark, f"{name}-progress"), mode)


@register("journey_stream", f"""
WITH {JOURNEY_EV} SELECT user_id, last_interacted_product_id, last_interaction_type, session_view_count, session_like_count,
  session_purchase_count, session_total_count, current_journey_stage FROM js""")
def _(spark, sf):
    events = stream(spark, sf).withWatermark("ts", "1 hour")
    rows = drained(spark, S.journey_stream(events, "event_id"), "journey", "update")
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "user_id"]), "batch").alias("r"))
    return newest.select("user_id", "r.last_interacted_product_id", "r.last_interaction_type", "r.session_view_count",
                         "r.session_like_count", "r.session_purchase_count", "r.session_total_count", "r.current_journey_stage")


_WINDOWS = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  CASE WHEN event_type = 'click' THEN 'like' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1, 2, 3"""


@register("activity_windows", _WINDOWS)
def _(spark, sf):
    return S.activity_windows(A.interactions_ev(spark, sf))


@register("activity_windows_sliding", """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start,
  CASE WHEN event_type = 'click' THEN 'like' ELSE event_type END AS event_type FROM events) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return S.activity_windows(A.interactions_ev(spark, sf), "sliding")


_SESSIONS = f"""WITH {EV}, g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts)
  AS sid FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n
FROM s GROUP BY user_id, sid"""


@register("activity_windows_session", _SESSIONS)
def _(spark, sf):
    return S.activity_windows(A.interactions_ev(spark, sf), "session")


@register("activity_windows_stream", _WINDOWS)
def _(spark, sf):
    """Each batch writes the windows that it changed, those still open included; the last state of a window counts."""
    rows = drained(spark, S.activity_windows(stream(spark, sf)), "windows", "update")
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return rows.groupBy(*ends, "event_type").agg(F.max_by("n", "batch").alias("n"))


@register("dedupe_stream", f"WITH {EV} SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM ev")
def _(spark, sf):
    """Every event twice in the stream, once out."""
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    rows = drained(spark, S.dedupe_stream(twice, ["event_id"]), "dedupe")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))
