"""Splits, list metrics and model comparison over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.recommending import IBCF_PADDED, POP, RT, SEEN, ev_profiles, ev_stages
from profilerec.catalog.registry import EV, PROD, register
from profilerec.catalog.textual import tagged_products
from profilerec.operators import cf, evaluate, history, ordering
from profilerec.plans import evaluation as plan
from profilerec.session import cut_lineage
from profilerec.sources import adapters as A

SPLIT = f"""{EV}, sp AS (SELECT *, CASE WHEN total < 2 OR rn <= least(greatest(1, floor(total * 0.8)), total - 1)
  THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS total FROM ev)), train AS (SELECT * FROM sp WHERE split = 'train'),
truth AS (SELECT DISTINCT user_id, product_id FROM sp WHERE split = 'test')"""
LISTS = f"""{SPLIT}, {RT.format(log='train')}, {SEEN.format(log='train')}, {POP.format(log='train')}, {IBCF_PADDED},
us AS (SELECT DISTINCT user_id FROM train),
recs AS (SELECT 'Most Popular' AS model, user_id, product_id, rank FROM (SELECT us.user_id, pop.product_id, row_number() OVER
  (PARTITION BY us.user_id ORDER BY pop_rank) AS rank FROM us, pop ANTI JOIN seen
  ON seen.user_id = us.user_id AND seen.product_id = pop.product_id) WHERE rank <= 10
UNION ALL SELECT 'IBCF', user_id, product_id, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM ibp) WHERE rank <= 10)"""
METRICS = f"""{LISTS}, nrel AS (SELECT user_id, count(*) AS n_rel FROM truth GROUP BY 1),
ppop AS (SELECT product_id, n / sum(n) OVER () AS popularity FROM pop),
um AS (SELECT model, user_id, count(t.product_id) / 10.0::DOUBLE AS precision,
  count(t.product_id) / any_value(n_rel) AS recall,
  sum(CASE WHEN t.product_id IS NULL THEN 0.0::DOUBLE ELSE 1 / log2(rank + 1) END) / any_value(list_sum(list_transform(
    range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg,
  avg(-log2(coalesce(popularity, 1e-10::DOUBLE))) AS novelty
  FROM recs r JOIN nrel USING (user_id) LEFT JOIN truth t ON r.user_id = t.user_id AND r.product_id = t.product_id
  LEFT JOIN ppop ON ppop.product_id = r.product_id GROUP BY 1, 2),
uv AS (SELECT model, user_id, rank, embedding::DOUBLE[] AS e FROM recs JOIN embeddings ON product_id = CAST(vec_id AS VARCHAR)),
ils AS (SELECT a.model, a.user_id, avg(list_cosine_similarity(a.e, b.e)) AS ils FROM uv a JOIN uv b
  ON a.model = b.model AND a.user_id = b.user_id AND a.rank < b.rank GROUP BY 1, 2)"""


def split_events(spark, sf):
    return ordering.per_user_split(A.interactions_ev(spark, sf), "ts", A.EVENT_ORDER)


def lists_and_truth(spark, sf):
    """Popular and neighbourhood lists, the train rows and the truth of the per-user split."""
    split = cut_lineage(split_events(spark, sf))
    train = split.where("split = 'train'").drop("split")
    users = train.select("user_id").distinct()
    popular = cf.recommend_popular(users, cf.popular_rank(train), 10, cf.seen_pairs(train, "purchase"))
    near = cf.recommend_ibcf(users, cf.ratings(train), 10)
    recs = popular.select(F.lit("Most Popular").alias("model"), "user_id", "product_id", "rank").unionByName(
        near.select(F.lit("IBCF").alias("model"), "user_id", "product_id", "rank"))
    return recs, train, history.ground_truth(split.where("split = 'test'"))


def measured(spark, sf, *cols):
    recs, train, truth = lists_and_truth(spark, sf)
    table = evaluate.user_metrics(recs, truth, 10, cf.popularity(train, False))
    return table.select("model", "user_id", *[F.round(c, 6).alias(c) for c in cols])


@register("precision_at_k", f"WITH {METRICS} SELECT model, user_id, round(precision, 6) AS precision FROM um")
def _(spark, sf):
    return measured(spark, sf, "precision")


@register("recall_at_k", f"WITH {METRICS} SELECT model, user_id, round(recall, 6) AS recall FROM um")
def _(spark, sf):
    return measured(spark, sf, "recall")


@register("ndcg_at_k", f"WITH {METRICS} SELECT model, user_id, round(ndcg, 6) AS ndcg FROM um")
def _(spark, sf):
    return measured(spark, sf, "ndcg")


@register("novelty", f"WITH {METRICS} SELECT model, user_id, round(novelty, 6) AS novelty FROM um")
def _(spark, sf):
    return measured(spark, sf, "novelty")


@register("coverage", f"""
WITH {LISTS}, {PROD} SELECT model, round(count(DISTINCT product_id) / (SELECT count(*) FROM prod) * 100.0::DOUBLE, 6) AS coverage
FROM recs GROUP BY 1""")
def _(spark, sf):
    recs, _train, _truth = lists_and_truth(spark, sf)
    n_items = A.products(spark, sf).agg(F.count("*")).scalar()
    return evaluate.coverage(recs, n_items).withColumn("coverage", F.round("coverage", 6))


@register("intra_list_similarity", f"WITH {METRICS} SELECT model, user_id, round(ils, 5) AS ils FROM ils")
def _(spark, sf):
    recs, _train, _truth = lists_and_truth(spark, sf)
    found = evaluate.list_similarity(recs, A.product_vectors(spark, sf), ("model", "user_id"))
    return found.withColumn("ils", F.round("ils", 5))


@register("eval_cohort", f"""
WITH {SPLIT} SELECT user_id FROM (SELECT DISTINCT user_id FROM train) SEMI JOIN truth USING (user_id)""")
def _(spark, sf):
    return evaluate.eval_cohort(split_events(spark, sf))


@register("choose_split", f"""
WITH {EV}, g AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS gr, count(*) OVER () AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ur, count(*) OVER (PARTITION BY user_id) AS un FROM ev),
s AS (SELECT *, CASE WHEN gr <= greatest(1, least(n - 1, floor(n * 0.8))) THEN 'train' ELSE 'test' END AS gs,
  CASE WHEN un < 2 OR ur <= least(greatest(1, floor(un * 0.8)), un - 1) THEN 'train' ELSE 'test' END AS us FROM g),
c AS (SELECT count(*) AS both_sides FROM (SELECT user_id FROM s GROUP BY 1 HAVING count(DISTINCT gs) = 2))
SELECT event_id, CASE WHEN both_sides >= greatest(100, floor((SELECT count(DISTINCT user_id) FROM ev) * 0.1)) THEN gs ELSE us END
  AS split FROM s, c""")
def _(spark, sf):
    split, _method = evaluate.choose_split(A.interactions_ev(spark, sf), "ts", A.EVENT_ORDER)
    return split.select("event_id", "split")


RESULTS = f"""{METRICS}, {PROD}, res AS (SELECT model, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall,
  round(avg(ndcg), 3) AS ndcg, any_value(cov) AS coverage, round(avg(coalesce(ils, 0)), 3) AS ils, round(avg(novelty), 2) AS novelty
  FROM um LEFT JOIN ils USING (model, user_id) JOIN (SELECT model, round(count(DISTINCT product_id) /
  (SELECT count(*) FROM prod WHERE product_id IN (SELECT product_id FROM train)) * 100.0::DOUBLE, 1) AS cov FROM recs
  WHERE user_id IN (SELECT user_id FROM truth) GROUP BY 1) USING (model) GROUP BY 1)"""


def results(spark, sf):
    recs, train, truth = lists_and_truth(spark, sf)
    catalog = A.products(spark, sf).join(train.select("product_id"), "product_id", "left_semi")
    return evaluate.evaluate_models(
        recs, truth, catalog, 10, cf.popularity(train, False), A.product_vectors(spark, sf))


@register("evaluate_models", f"WITH {RESULTS} SELECT * FROM res")
def _(spark, sf):
    return results(spark, sf)


@register("best_model", f"""
WITH {RESULTS}, long AS (SELECT model, unnest(['precision', 'recall', 'ndcg', 'coverage', 'ils', 'novelty']) AS metric,
  unnest([precision, recall, ndcg, coverage, -ils, novelty]) AS v FROM res)
SELECT metric, model FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, model) AS rn FROM long) WHERE rn = 1""")
def _(spark, sf):
    return evaluate.best_models(results(spark, sf))


@register("evaluate_recommenders")
def _(spark, sf):
    return plan.evaluate_recommenders(
        A.interactions_ev(spark, sf), ev_profiles(spark, sf), tagged_products(spark, sf), ev_stages(spark, sf),
        A.EVENT_ORDER, A.product_vectors(spark, sf))
