"""Term weights, cluster keywords, token counts and text vectors."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from profilerec.functions.text import ENGLISH_STOPWORDS, SEPARATOR, words
from profilerec.operators.blocks import sparse, top_scores
from profilerec.operators.ordering import global_row_index, head_per_group
from profilerec.operators.skew import HOT_SHARE, join_hot
from profilerec.session import cut_lineage

#: Open vocabularies of at most so many terms travel with tasks.
BROADCAST_TERMS = 1 << 20


def term_counts(docs: DataFrame, key: str, text: str, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> DataFrame:
    """(key, term, tf); counts combine inside each task, so a long key is never gathered."""
    terms = docs.select(key, F.explode(words(F.col(text))).alias("term"))
    if stopwords:
        terms = terms.where(~F.col("term").isin(*stopwords))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _texts_by_key(docs: DataFrame, key: str) -> list[DataFrame]:
    """Disjoint parts of ``docs``: rows gathered by key, and those of keys above ``HOT_SHARE`` of all rows as they lie.

    A text moves as one row, its terms as many; but the texts of a hot key would meet in one task.
    """
    rows = cut_lineage(docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1"))
    hot = rows.where(F.col("_rows") > docs.agg(F.count("*")).scalar() * F.lit(HOT_SHARE)).select("_key")
    if hot.isEmpty():
        return [docs.repartition(F.col(key))]
    same = F.col(key).eqNullSafe(F.col("_key"))
    return [docs.join(F.broadcast(hot), same, "left_anti").repartition(F.col(key)), docs.join(F.broadcast(hot), same, "left_semi")]


def vocabulary(
    counts: DataFrame, n_docs, max_features: int | None = None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """(term, df, idf) within the document-frequency bounds; the most counted terms when capped."""
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(float(max_df))))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return kept.select("term", "df", (F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weighted_terms(counts: DataFrame, vocab: DataFrame, key: str, capped: bool = False) -> DataFrame:
    """(key, term, ..., weight): tf * idf with unit length per key.

    A vocabulary ``capped`` to a number of terms is broadcast. A larger one is joined with the terms
    that occur in a large share of the rows salted; ``df`` tells which those are.
    """
    if capped:
        joined = counts.join(F.broadcast(vocab), "term")
    else:
        joined = join_hot(counts, vocab, "term", vocab.select("term", F.col("df").alias("_rows")), "_rows", [key])
    raw = joined.withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / length).drop("raw")


def tfidf(
    docs: DataFrame, key: str, text: str, max_features: int | None = None, min_df: int = 1,
    max_df: float = 1.0, stopwords: Sequence[str] = ENGLISH_STOPWORDS,
) -> DataFrame:
    """(key, term, tf, weight) with smoothed idf and unit length per document."""
    counts = [term_counts(part, key, text, stopwords) for part in _texts_by_key(docs.select(key, text), key)]
    every = functools.reduce(DataFrame.unionByName, counts)
    vocab = cut_lineage(vocabulary(every, docs.agg(F.count("*")).scalar(), max_features, min_df, max_df))
    small = max_features is not None or vocab.count() <= BROADCAST_TERMS
    weights = [weighted_terms(part, vocab, key, small).select(key, "term", "tf", "weight") for part in counts]
    return functools.reduce(DataFrame.unionByName, weights)


def ctfidf_keywords(
    docs: DataFrame, cluster: str, text: str, limit: int = 7, stopwords: Sequence[str] = ENGLISH_STOPWORDS
) -> DataFrame:
    """(cluster, rank, term, score): best terms of each cluster taken as one document.

    The cluster text is never built; tokens are counted by cluster. Unit-length TF-IDF rows are
    scaled to sum 1 and weighted by ln((average row sum + 1) / (clusters with the term + 1)) + 1.
    """
    if cluster == "major_cluster":
        docs = docs.where(F.col(cluster) >= 0)
    # One row per cluster and term, read several times below, while the texts are read once.
    counts = cut_lineage(term_counts(docs, cluster, text, stopwords))
    n_clusters = counts.agg(F.countDistinct(cluster)).scalar()
    raw = counts.join(vocabulary(counts, n_clusters), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    sums = raw.groupBy(cluster).agg(
        F.sum("raw").alias("row_sum"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("row_length")
    )
    average = sums.agg(F.avg(F.col("row_sum") / F.col("row_length"))).scalar()
    score = F.col("raw") / F.col("row_sum") * (F.log((average + 1.0) / (F.col("df") + 1.0)) + 1.0)
    scored = raw.join(sums, cluster).select(cluster, "term", F.round(score, 9).alias("score")).where("score > 0")
    return head_per_group(scored, [cluster], [F.desc("score"), "term"], limit)


def frequent_tokens(docs: DataFrame, cluster: str, text: str, limit: int = 7, min_length: int = 4) -> DataFrame:
    """(cluster, rank, token, n): most counted blank-separated tokens."""
    tokens = docs.select(cluster, F.explode(F.split(F.lower(text), r"\s+")).alias("token"))
    counts = tokens.where(F.length("token") >= min_length).groupBy(cluster, "token").agg(F.count("*").alias("n"))
    return head_per_group(counts, [cluster], [F.desc("n"), "token"], limit)


def embed_text(
    docs: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] | None = None,
    dims: int = 256, batch_size: int = 96, stopwords: Sequence[str] = ENGLISH_STOPWORDS,
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """(key, embedding array<float>); a null text counts as empty.

    ``load`` makes a model, a function from a list of texts to a matrix; each Python worker calls it
    once and keeps the model for all its batches of ``batch_size`` texts. A light function that needs
    no loading may be given as ``encode``. Without both, words are hashed to ``dims`` columns and
    scaled to unit length.
    """
    if load is not None or encode is not None:
        def make():
            model = load() if load is not None else encode
            return lambda texts: np.asarray(model([str(t) for t in texts]), dtype=np.float32)

        vector = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
        return docs.select(F.col(key).cast("string").alias(key), vector(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))
    tokens = F.filter(words(F.col(text)), lambda t: ~F.array_contains(F.array(*[F.lit(s) for s in stopwords]), t))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims).transform(
        docs.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
    )
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.select(key, vector_to_array("_unit", "float32").alias("embedding"))


def product_text(products: DataFrame) -> DataFrame:
    """(product_id, product_text): combined text, tags and cluster summary as one text."""
    parts = [F.coalesce(c, F.lit("")) for c in ("combined_text", "attribute_tags", "cluster_summary")]
    return products.select("product_id", F.concat_ws(SEPARATOR, *parts).alias("product_text"))


def text_vectors(
    users: DataFrame, items: DataFrame, max_features: int = 2048, min_df: int = 1, max_df: float = 0.95,
    stopwords: Sequence[str] = ENGLISH_STOPWORDS,
) -> tuple[DataFrame, DataFrame]:
    """(user_id, vec) and (product_id, vec) in the vocabulary learned from the items.

    ``users`` has user_id and user_text, ``items`` product_id and product_text. The vocabulary has
    at most ``max_features`` terms.
    """
    item_counts = cut_lineage(term_counts(items, "product_id", "product_text", stopwords))
    vocab = vocabulary(item_counts, items.agg(F.count("*")).scalar(), max_features, min_df, max_df)
    vocab = global_row_index(cut_lineage(vocab), ["term"], "term_no")
    user_counts = term_counts(users, "user_id", "user_text", stopwords)
    return (
        sparse(weighted_terms(user_counts, vocab, "user_id", True), "user_id"),
        sparse(weighted_terms(item_counts, vocab, "product_id", True), "product_id"),
    )


def cosine_topk(
    users: DataFrame, items: DataFrame, k: int, max_features: int = 2048, seen: DataFrame | None = None,
    min_df: int = 1, max_df: float = 0.95, stopwords: Sequence[str] = ENGLISH_STOPWORDS,
) -> DataFrame:
    """(user_id, product_id, score, rank): the ``k`` most similar items per user, above zero."""
    user_vec, item_vec = text_vectors(users, items, max_features, min_df, max_df, stopwords)
    return top_scores(
        user_vec.withColumnRenamed("vec", "score"), item_vec.withColumnRenamed("vec", "score"),
        {"score": max_features}, [{"score": 1.0}], k, seen=seen, min_score=0.0,
    ).withColumnRenamed("best_rank", "rank")
