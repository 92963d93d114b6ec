"""Score mixing, candidate pools and the feature table of the re-ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.functions.rules import cf_weight, llm_weight
from profilerec.functions.text import keyword_overlap
from profilerec.operators.blocks import top_scores
from profilerec.operators.cf import exclude_seen, topk_per_user
from profilerec.operators.clean import factorize_all, tercile_bucket
from profilerec.operators.stats import medians
from profilerec.session import cut_lineage

# Names of the candidate features and of their codes, and the weights of the simple mix.
FEATURE_COLUMNS = (
    "cf_score", "llm_score", "hybrid_score", "cf_weight", "llm_weight", "behavior_cluster",
    "involvement_diversity", "journey_encoded", "cluster_label_encoded", "age_group_encoded",
    "gender_encoded", "product_price", "product_popularity", "major_cluster", "sub_cluster",
    "preferred_cluster_match", "price_sensitivity_match", "keyword_overlap",
)
ENCODED = {
    "journey_stage": "journey_encoded",
    "behavior_cluster_label": "cluster_label_encoded",
    "age_group": "age_group_encoded",
    "gender": "gender_encoded",
}
MIX = {"cf_score": 0.5, "llm_score": 0.5}


def joined_vectors(cf: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """One row per id with both vector views; an absent view scores 0."""
    return cf.select(key, F.col("vec").alias("cf_score")).join(
        semantic.select(key, F.col("vec").alias("llm_score")), key, "full_outer"
    )


def hybrid_candidates(
    users: DataFrame, items: DataFrame, cf_dims: int, text_dims: int, topk: int = 120, seen: DataFrame | None = None
) -> DataFrame:
    """(user_id, product_id, cf_score, llm_score): union of the best by each score, seen pairs removed."""
    views = {"cf_score": cf_dims, "llm_score": text_dims}
    rankings = [{"cf_score": 1.0}, {"llm_score": 1.0}]
    return top_scores(users, items, views, rankings, topk, seen=seen).drop("best_rank")


def recommend_simple_hybrid(
    users: DataFrame, items: DataFrame, cf_dims: int, text_dims: int, k: int, seen: DataFrame | None = None
) -> DataFrame:
    """Best by the even mix of both scores, ranked exactly over all pairs."""
    found = top_scores(users, items, {"cf_score": cf_dims, "llm_score": text_dims}, [MIX], k, seen=seen)
    mixed = sum(F.col(c) * w for c, w in MIX.items())
    return found.select("user_id", "product_id", mixed.alias("score"), F.col("best_rank").alias("rank"))


def mix_scores(cf: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both long score tables side by side; a pair absent from one scores 0 there."""
    return cf.select("user_id", "product_id", F.col("score").alias("cf_score")).join(
        semantic.select("user_id", "product_id", F.col("score").alias("llm_score")),
        ["user_id", "product_id"], "full_outer",
    ).fillna(0.0, ["cf_score", "llm_score"])


def simple_hybrid_from_scores(cf: DataFrame, semantic: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    mixed = mix_scores(cf, semantic).withColumn("score", sum(F.col(c) * w for c, w in MIX.items()))
    return topk_per_user(exclude_seen(mixed, seen), k)


def candidates_from_scores(cf: DataFrame, semantic: DataFrame, topk: int = 120, seen: DataFrame | None = None) -> DataFrame:
    """Candidate pool from two long score tables."""
    best = [
        topk_per_user(exclude_seen(s, seen), topk).select("user_id", "product_id") for s in (cf, semantic)
    ]
    pool = best[0].unionByName(best[1]).distinct()
    return pool.join(mix_scores(cf, semantic), ["user_id", "product_id"])


def candidate_features(
    candidates: DataFrame, profiles: DataFrame, products: DataFrame, stages: DataFrame,
    popularity: DataFrame, preferred: DataFrame,
) -> DataFrame:
    """Candidates with weights, user, journey and product attributes, cross features and codes.

    profiles: one row per user; products: the candidate catalog; stages: user_id and
    current_journey_stage; preferred: user_id and preferred_cluster.
    """
    # Small tables that several statistics read: written once.
    stages = cut_lineage(stages.select("user_id", "current_journey_stage"))
    products = cut_lineage(products)
    users = cut_lineage(profiles.select(
        "user_id",
        F.coalesce("involvement_diversity", F.lit(0)).cast("double").alias("involvement_diversity"),
        F.coalesce("behavior_cluster_label", F.lit("Unclassified")).alias("behavior_cluster_label"),
        F.coalesce("behavior_cluster", F.lit(-1)).cast("int").alias("behavior_cluster"),
        F.coalesce("age_group", F.lit("unknown")).alias("age_group"),
        F.coalesce("gender", F.lit("Unknown")).alias("gender"),
        F.coalesce("interest_keywords", F.lit("")).alias("interest_keywords"),
        F.coalesce("spend", F.lit(0.0)).alias("spend"),
    ))
    middle = medians(users, ["involvement_diversity"])["involvement_diversity"] or 0.0
    price = medians(products, ["price"])["price"] or 0.0
    user_side = tercile_bucket(users, "spend", "spend_bucket").join(
        stages.select("user_id", F.col("current_journey_stage").alias("journey_stage")), "user_id", "left"
    ).join(preferred, "user_id", "left")
    item_side = tercile_bucket(products, "price", "price_bucket").join(popularity, "product_id", "left").select(
        "product_id",
        F.col("name").alias("product_name"),
        F.coalesce("price", F.lit(price)).alias("product_price"),
        "price_bucket",
        F.coalesce("popularity", F.lit(0.0)).alias("product_popularity"),
        F.coalesce("major_cluster", F.lit(-1)).cast("int").alias("major_cluster"),
        F.coalesce("sub_cluster", F.lit(-1)).cast("int").alias("sub_cluster"),
        F.coalesce("attribute_tags", F.lit("")).alias("attribute_tags"),
        F.coalesce("tfidf_keywords", F.lit("")).alias("tfidf_keywords"),
        F.coalesce("cluster_summary", F.lit("")).alias("cluster_summary"),
    )
    rows = candidates.join(user_side, "user_id", "left").join(item_side, "product_id").fillna(
        {
            "involvement_diversity": 0.0, "behavior_cluster_label": "Unclassified", "behavior_cluster": -1,
            "age_group": "unknown", "gender": "Unknown", "interest_keywords": "", "spend_bucket": "mid",
            "journey_stage": "Unknown", "preferred_cluster": -1,
        }
    )
    weights = [F.col("involvement_diversity"), F.lit(middle), F.col("behavior_cluster_label")]
    rows = rows.withColumns({"cf_weight": cf_weight(*weights), "llm_weight": llm_weight(*weights)}).withColumns(
        {
            "hybrid_score": F.col("cf_weight") * F.col("cf_score") + F.col("llm_weight") * F.col("llm_score"),
            "preferred_cluster_match": (
                (F.col("preferred_cluster") == F.col("major_cluster")) & (F.col("preferred_cluster") >= 0)
            ).cast("int"),
            "price_sensitivity_match": (F.col("spend_bucket") == F.col("price_bucket")).cast("int"),
            "keyword_overlap": keyword_overlap(
                F.col("interest_keywords"), F.col("attribute_tags"), F.col("tfidf_keywords")
            ),
        }
    )
    stage = stages.withColumnRenamed("current_journey_stage", "journey_stage")
    rows = factorize_all(rows, ENCODED, [(stage, ["journey_stage"]), (users, ["behavior_cluster_label", "age_group", "gender"])])
    return rows.drop("spend", "spend_bucket", "price_bucket", "preferred_cluster", "interest_keywords", "tfidf_keywords")


def final_top_n(ranked: DataFrame, n: int = 10, score: str = "reranked_score", digits: int = 9) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.round(score, digits).desc(), "product_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
