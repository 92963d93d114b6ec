"""Customer profiles and product profiles from clean tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.functions.rules import age_group, preferred_size
from profilerec.functions.text import combined_text
from profilerec.operators import cluster, history, ordering, persona, rfm, textmine, vectors
from profilerec.session import cut_lineage
from profilerec.sources.enrichment import EnrichmentStore
from profilerec.sources.tables import PRODUCT_TEXTS


def customer_profiles(
    customers: DataFrame, interactions: DataFrame, products: DataFrame, n_init: int = 10,
    store: EnrichmentStore | None = None, model: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Customer rows with segment, history and persona columns, and the RFM table behind them.

    Of several rows of one customer one counts. With ``store``, personas come from the stored answers,
    then from ``model``, then from the template, and new answers are stored.
    """
    customers = ordering.one_per_key(customers, "user_id")
    users, _curve = rfm.behavior_clusters(cut_lineage(rfm.assemble_rfm(interactions, customers)), n_init=n_init)
    scored = cut_lineage(rfm.attach_segment_labels(cut_lineage(users)))
    taste = history.taste_profiles(history.first_distinct_items(interactions, products))
    size = F.col("size") if "size" in customers.columns else F.lit(None)
    age = F.col("age") if "age" in customers.columns else F.lit(None).cast("double")
    joined = (
        customers.withColumns({"age_group": age_group(age), "preferred_size": preferred_size(size)})
        .join(scored, "user_id", "left").join(taste, "user_id", "left")
        .fillna({"behavior_cluster_label": "Unclassified", "major_purchase_categories": "", "purchase_history_preview": ""})
    )
    if store is None and model is None:
        return persona.persona_text(joined).drop("items"), scored
    known = customers.sparkSession.createDataFrame([], persona.CACHE_SCHEMA) if store is None else store
    if "gender" not in joined.columns:
        joined = joined.withColumn("gender", F.lit(None).cast("string"))
    people, _fresh = persona.personas_with_cache(cut_lineage(joined), known, model)
    return people.drop("items", "cache_key"), scored


def product_profiles(products: DataFrame, method: str = "density", vectors_of=None, **options) -> DataFrame:
    """Products with text, major and sub cluster, cluster keywords, tags and summary.

    ``vectors_of`` maps (product_id, combined_text) to (product_id, embedding); the default hashes
    the words of the text.
    """
    texts = [F.col(c) if c in products.columns else F.lit("") for c in PRODUCT_TEXTS]
    one = ordering.first_per_key(products, ["product_id"], ["name", "category"]).withColumn("combined_text", combined_text(texts))
    one = cut_lineage(one)
    embedded = vectors_of(one) if vectors_of else textmine.embed_text(one, "product_id", "combined_text")
    points = cut_lineage(vectors.reduce_dims(embedded).select("product_id", "reduced"))
    if method == "density":
        major = cluster.density_cluster(points, **options)
    else:
        major = cluster.kmeans_clusters(points, **options)
    labelled = cluster.subcluster(cut_lineage(major)).select("product_id", "major_cluster", "sub_cluster")
    rows = cut_lineage(one.join(labelled, "product_id"))
    return rows.join(cluster_texts(rows), "major_cluster", "left").fillna(
        "", ["tfidf_keywords", "attribute_tags", "cluster_summary"])


def cluster_texts(rows: DataFrame, sample: int = 8) -> DataFrame:
    """(major_cluster, tfidf_keywords, attribute_tags, cluster_summary) of the clusters without noise."""
    keywords = textmine.ctfidf_keywords(rows, "major_cluster", "combined_text").groupBy("major_cluster").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    names = ordering.head_per_group(rows.where("major_cluster >= 0"), ["major_cluster"], ["product_id"], sample).groupBy(
        "major_cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("s"))
    table = names.join(keywords, "major_cluster", "left").select(
        "major_cluster",
        F.transform("s", lambda x: x["name"]).alias("sample_names"),
        F.coalesce(F.transform("k", lambda x: x["term"]), F.array().cast("array<string>")).alias("keywords"),
    )
    return persona.cluster_tags(table).select(
        "major_cluster", F.array_join("keywords", ", ").alias("tfidf_keywords"), "attribute_tags", "cluster_summary")
