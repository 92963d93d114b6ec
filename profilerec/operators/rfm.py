"""Recency, frequency, spend and diversity per user, and the behaviour segments built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.functions.rules import segment_label
from profilerec.operators.clean import minmax_scale
from profilerec.operators.stats import medians

#: Rows of a partition in K-Means fits: with few rows, a task costs more to start than to run.
FIT_ROWS = 1 << 15
FEATURES = ("recency", "frequency", "monetary", "involvement_diversity")


def activity(interactions: DataFrame) -> DataFrame:
    """Last event, purchase count and distinct viewed or liked products per user."""
    engaged = F.when(F.col("event_type").isin("view", "like"), F.col("product_id"))
    return interactions.groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("event_type") == "purchase").alias("frequency"),
        F.countDistinct(engaged).alias("involvement_diversity"),
    )


def recency(interactions: DataFrame) -> DataFrame:
    """Whole days from each user's last event to the last event of all."""
    latest = interactions.agg(F.max("ts")).scalar()
    last = interactions.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.select("user_id", F.timestamp_diff("DAY", F.col("last_ts"), latest).alias("recency"))


def monetary(customers: DataFrame) -> DataFrame:
    return customers.groupBy("user_id").agg(F.avg("spend").alias("monetary"))


def assemble_rfm(interactions: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per user of the log; users without a customer row get spend 0."""
    latest = interactions.agg(F.max("ts")).scalar()
    return (
        activity(interactions)
        .join(monetary(customers), "user_id", "left")
        .select(
            "user_id",
            F.timestamp_diff("DAY", F.col("last_ts"), latest).alias("recency"),
            "frequency",
            F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
            "involvement_diversity",
        )
    )


def cluster_means(rfm: DataFrame, cluster: str = "behavior_cluster", cols: Sequence[str] = FEATURES) -> DataFrame:
    return rfm.groupBy(cluster).agg(*[F.round(F.avg(c), 3).alias(c) for c in cols])


def label_segments(rfm: DataFrame, cluster: str = "behavior_cluster") -> DataFrame:
    """(cluster, label): rounded cluster means against the medians of all users."""
    middle = {c: F.lit(v) for c, v in medians(rfm, FEATURES).items()}
    means = cluster_means(rfm, cluster)
    return means.withColumn(
        f"{cluster}_label", segment_label(*[F.col(c) for c in FEATURES], middle)
    ).select(cluster, f"{cluster}_label")


def attach_segment_labels(rfm: DataFrame, cluster: str = "behavior_cluster") -> DataFrame:
    return rfm.join(label_segments(rfm, cluster), cluster, "left")


def vectors(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42, n_init: int = 10,
           max_iter: int = 300, cluster: str = "cluster") -> tuple[KMeansModel, float]:
    """Best of ``n_init`` seeded fits by training cost, the first of equals.

    A fit is many short jobs, so all fits run side by side. A table of more than ``FIT_ROWS`` rows gets partitions of about so many;
    a smaller one keeps its own, on which the start centres depend.
    """
    rows, n = df.select(features), df.count()
    held = (rows.coalesce(math.ceil(n / FIT_ROWS)) if n > FIT_ROWS else rows).persist()

    def fit(run: int) -> tuple[float, int, KMeansModel]:
        model = KMeans(
            k=k, seed=seed + run, maxIter=max_iter, featuresCol=features, predictionCol=cluster
        ).fit(held)
        return model.summary.trainingCost, run, model

    try:
        with ThreadPoolExecutor(max_workers=n_init) as pool:
            best_cost, _run, best = min(pool.map(fit, range(n_init)), key=lambda f: f[:2])
    finally:
        held.unpersist()
    return best, best_cost


def candidate_ks(n_rows: int, k_range: tuple[int, int] = (5, 7)) -> list[int]:
    """Cluster counts to try; a table smaller than the range falls back to 2..4."""
    if n_rows < 2:
        return [1]
    ks = [k for k in range(k_range[0], k_range[1] + 1) if k <= n_rows]
    return ks or list(range(2, min(4, n_rows) + 1))


def choose_k(ks: Sequence[int], inertias: Sequence[float]) -> int:
    """Elbow: the k in the middle of the largest absolute second difference."""
    if len(ks) < 3:
        return ks[-1]
    bends = [
        abs(inertias[i - 1] - 2 * inertias[i] + inertias[i + 1]) for i in range(1, len(ks) - 1)
    ]
    return ks[1 + bends.index(max(bends))]


def behavior_clusters(rfm: DataFrame, seed: int = 42, n_init: int = 10,
                      k_range: tuple[int, int] = (5, 7)) -> tuple[DataFrame, DataFrame]:
    """Users with ``behavior_cluster``, and the (k, inertia, chosen) table behind the choice."""
    held = vectors(minmax_scale(rfm, FEATURES), [f"{c}_scaled" for c in FEATURES]).persist()
    try:
        n_users = held.count()
        ks = candidate_ks(n_users, k_range)
        scaled = held
        with ThreadPoolExecutor(max_workers=len(ks)) as pool:
            runs = {k: pool.submit(kmeans, scaled, k, "features", seed, n_init, 300, "behavior_cluster") for k in ks if k > 1}
            fits = {k: run.result() for k, run in runs.items()}
        inertias = [fits[k][1] if k in fits else 0.0 for k in ks]
        chosen = choose_k(ks, inertias)
    finally:
        held.unpersist()
    curve = rfm.sparkSession.createDataFrame(
        [(k, float(v), k == chosen) for k, v in zip(ks, inertias)], "k int, inertia double, chosen boolean"
    )
    if chosen not in fits:
        return rfm.withColumn("behavior_cluster", F.lit(0)), curve
    labelled = fits[chosen][0].transform(scaled).select(*rfm.columns, "behavior_cluster")
    return labelled, curve
