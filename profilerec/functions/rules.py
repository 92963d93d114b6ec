"""Profile rules: ratings, age bins, segments, journey stages and score weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal strength per event type, other types count as a view.
RATING_BY_EVENT = {"view": 1.0, "like": 3.0, "purchase": 5.0}

# Upper age bounds (inclusive) and their labels.
AGE_BOUNDS = ((19, "10s"), (29, "20s"), (39, "30s"), (49, "40s"), (59, "50s"), (200, "60+"))

# Journey stages in report order.
STAGES = ("Dormant", "Awareness", "Interest", "Desire", "Action", "Post-Purchase", "Unknown")

# Segments whose users are weighted towards text similarity.
HIGH_ENGAGEMENT_SEGMENTS = ("VIP Explorer", "New Explorer")

# Purchase motive per segment.
MOTIVE_BY_SEGMENT = {
    "VIP Explorer": "novelty, quality, and breadth of choice",
    "Low-Value Loyal": "repeat convenience and dependable value",
    "At-Risk High-Value": "premium preference with declining recent engagement",
    "New Explorer": "discovery and onboarding curiosity",
    "Dormant": "reactivation triggers and event-driven demand",
    "Regular": "stable, routine everyday needs",
    "Unclassified": "limited observed behavior",
}
DEFAULT_MOTIVE = "balanced everyday demand"


def implicit_rating(event_type: Column) -> Column:
    value = F.lit(1.0)
    for name, rating in RATING_BY_EVENT.items():
        value = F.when(event_type == name, F.lit(rating)).otherwise(value)
    return value


def age_group(age: Column) -> Column:
    in_range = (age >= 0) & (age <= AGE_BOUNDS[-1][0])
    label = F.lit("unknown")
    for bound, name in reversed(AGE_BOUNDS):
        label = F.when(age <= bound, F.lit(name)).otherwise(label)
    return F.when(in_range, label).otherwise(F.lit("unknown"))


def preferred_size(size: Column) -> Column:
    return F.coalesce(size.cast("string"), F.lit("unknown"))


def segment_label(recency, frequency, monetary, diversity, medians: dict[str, Column]) -> Column:
    """Label of a cluster centre against the population medians."""
    recent = recency <= medians["recency"]
    frequent = frequency >= medians["frequency"]
    valuable = monetary >= medians["monetary"]
    diverse = diversity >= medians["involvement_diversity"]
    return (
        F.when(recent & frequent & valuable & diverse, "VIP Explorer")
        .when(recent & frequent & ~diverse, "Low-Value Loyal")
        .when(~recent & valuable & frequent, "At-Risk High-Value")
        .when(recent & ~frequent & diverse, "New Explorer")
        .when(~recent & ~frequent, "Dormant")
        .otherwise("Regular")
    )


def journey_stage(last_action, days_since_last, views, likes, purchases, dormant_days: int = 60) -> Column:
    return (
        F.when(days_since_last >= dormant_days, "Dormant")
        .when(last_action == "purchase", "Post-Purchase")
        .when(purchases > 0, "Action")
        .when((last_action == "like") & (views >= 3), "Desire")
        .when(last_action == "like", "Interest")
        .when((last_action == "view") & (likes == 0), "Awareness")
        .otherwise("Unknown")
    )


def cf_weight(involvement: Column, median_involvement: Column, segment: Column) -> Column:
    """Weight of the collaborative score; the text score gets the rest."""
    engaged = (involvement >= median_involvement) | segment.isin(*HIGH_ENGAGEMENT_SEGMENTS)
    return F.when(engaged, F.lit(0.4)).otherwise(F.lit(0.7))


def llm_weight(involvement: Column, median_involvement: Column, segment: Column) -> Column:
    engaged = (involvement >= median_involvement) | segment.isin(*HIGH_ENGAGEMENT_SEGMENTS)
    return F.when(engaged, F.lit(0.6)).otherwise(F.lit(0.3))


def purchase_motive(segment: Column) -> Column:
    value = F.lit(DEFAULT_MOTIVE)
    for name, motive in MOTIVE_BY_SEGMENT.items():
        value = F.when(segment == name, F.lit(motive)).otherwise(value)
    return value


def tercile(value: Column, edges: list[Column]) -> Column:
    """low / mid / high by (min, q1/3, q2/3, max); all mid when two edges coincide."""
    low, first, second, high = edges
    collapsed = (low >= first) | (first >= second) | (second >= high)
    return (
        F.when(collapsed, "mid").when(value <= first, "low").when(value <= second, "mid").otherwise("high")
    )
