"""Purchase history, category tastes and item lists per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.operators.ordering import first_per_key, head_per_group, index_within

# Event types from the strongest signal to the weakest.
TIERS = ("purchase", "like", "view")


def first_distinct_items(interactions: DataFrame, products: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` distinct catalog items per user in time order, from the user's best event type.

    Likes count only for users without a purchase of a catalog item, views only for users with
    neither. Of several catalog rows of one product the first by name and category counts. Repeats collapse before the rows of a user meet, then every task keeps ``n`` per user.
    """
    tier = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("event_type") == name, F.lit(i)).otherwise(tier)
    items = (
        interactions.withColumn("tier", tier).where("tier IS NOT NULL AND product_id <> ''")
        .groupBy("user_id", "product_id", "tier").agg(F.min("ts").alias("first_ts"))
        .join(first_per_key(products.select("product_id", "name", "category"), ["product_id"], ["name", "category"]), "product_id")
    )
    top = head_per_group(items, ["user_id"], ["tier", "first_ts", "product_id"], n)
    best = F.min("tier").over(W.partitionBy("user_id"))
    return top.withColumn("best", best).where("tier = best").select(
        "user_id", "rank", "product_id", "name", "category"
    )


def taste_profiles(items: DataFrame, categories: int = 3, preview: int = 5) -> DataFrame:
    """Item list, most common categories (ties by first seen) and name preview per user."""
    lists = items.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "category"))).alias("items")
    )
    cats = F.filter(F.transform("items", lambda s: s["category"]), lambda c: c != "")
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(cats),
            lambda c: F.struct(
                (-F.size(F.filter(cats, lambda x: x == c))).alias("neg_count"),
                F.array_position(cats, c).alias("first_at"),
                c.alias("category"),
            ),
        )
    )
    return lists.select(
        "user_id",
        "items",
        F.array_join(F.transform(F.slice(ranked, 1, categories), lambda s: s["category"]), ", ")
        .alias("major_purchase_categories"),
        F.array_join(F.transform(F.slice("items", 1, preview), lambda s: s["name"]), " | ")
        .alias("purchase_history_preview"),
    )


def history_lists(interactions: DataFrame, tie: Sequence[str], chunk: int = 1000) -> DataFrame:
    """Product lists per user in time order, cut into chunks so that no list is unbounded."""
    indexed = index_within(interactions, "user_id", "ts", tie)
    position = F.col("_idx") - 1
    return (
        indexed.withColumn("chunk_no", F.floor(position / chunk))
        .groupBy("user_id", "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_idx"), F.col("product_id")))).alias("s"))
        .select("user_id", "chunk_no", F.transform("s", lambda x: x["product_id"]).alias("products"))
    )


def ground_truth(test: DataFrame) -> DataFrame:
    """Distinct (user, product) pairs of the test rows; one row per relevant item."""
    return test.select("user_id", "product_id").distinct()


def preferred_cluster(purchases: DataFrame, products: DataFrame, cluster: str = "major_cluster") -> DataFrame:
    """Most frequent purchased cluster per user, ties by first purchase, then by id."""
    counts = (
        purchases.join(products.select("product_id", cluster).where(F.col(cluster).isNotNull()), "product_id")
        .groupBy("user_id", cluster).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    )
    best = head_per_group(counts, ["user_id"], [F.desc("n"), "first_ts", cluster], 1)
    return best.select("user_id", F.col(cluster).cast("int").alias("preferred_cluster"))
