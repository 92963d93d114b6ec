"""Imputation, fills, encoding, scaling, augmentation, order and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.registry import CUST, EV, ORD, PROD, register
from profilerec.operators import augment, clean, ordering, stats
from profilerec.sources import adapters as A

DIRTY_CUST = f"""{CUST}, dirty AS (SELECT user_id, CASE WHEN CAST(user_id AS BIGINT) % 13 <> 0 THEN spend END AS spend,
  CASE WHEN CAST(user_id AS BIGINT) % 9 <> 0 THEN age END AS age,
  CASE WHEN CAST(user_id AS BIGINT) % 7 <> 0 THEN category END AS category,
  CASE WHEN CAST(user_id AS BIGINT) % 5 <> 0 THEN gender ELSE '' END AS gender FROM cust)"""


def dirty_customers(spark, sf):
    key = F.col("user_id").cast("bigint")
    return A.customers(spark, sf).select(
        "user_id",
        F.when(key % 13 != 0, F.col("spend")).alias("spend"),
        F.when(key % 9 != 0, F.col("age")).alias("age"),
        F.when(key % 7 != 0, F.col("category")).alias("category"),
        F.when(key % 5 != 0, F.col("gender")).otherwise("").alias("gender"))


@register("impute_median", f"""
WITH {DIRTY_CUST} SELECT user_id, round(coalesce(spend, (SELECT median(spend) FROM dirty)), 4) AS spend,
  coalesce(age, (SELECT median(age) FROM dirty)) AS age FROM dirty""")
def _(spark, sf):
    filled = clean.impute_median(dirty_customers(spark, sf), ["spend", "age"])
    return filled.select("user_id", F.round("spend", 4).alias("spend"), "age")


@register("impute_mode", f"""
WITH {DIRTY_CUST} SELECT user_id, coalesce(category, (SELECT category FROM dirty WHERE category IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1)) AS category FROM dirty""")
def _(spark, sf):
    return clean.impute_mode(dirty_customers(spark, sf).select("user_id", "category"), ["category"])


@register("impute_constant", f"""
WITH {DIRTY_CUST} SELECT user_id, coalesce(category, 'unknown_product') AS category,
  coalesce(nullif(gender, ''), 'Unknown') AS gender FROM dirty""")
def _(spark, sf):
    return clean.impute_constant(
        dirty_customers(spark, sf).select("user_id", "category", "gender"),
        {"category": "unknown_product", "gender": "Unknown"})


@register("impute_event_type", f"""
WITH {EV}, d AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM ev)
SELECT event_id, coalesce(event_type, (SELECT event_type FROM d WHERE event_type IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM d""")
def _(spark, sf):
    dirty = A.interactions_ev(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    return clean.impute_event_type(dirty)


@register("fill_ordered", f"""
WITH {EV}, d AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 11 > 2 THEN ts END AS ts FROM ev)
SELECT event_id,
  coalesce(last_value(user_id IGNORE NULLS) OVER w, first_value(user_id IGNORE NULLS) OVER b) AS user_id,
  coalesce(last_value(ts IGNORE NULLS) OVER w, first_value(ts IGNORE NULLS) OVER b) AS ts
FROM d WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    key = F.col("event_id")
    dirty = A.interactions_ev(spark, sf).select(
        "event_id", F.when(key % 7 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 11 > 2, F.col("ts")).alias("ts"))
    return ordering.fill_ordered(dirty, ["user_id", "ts"], "event_id")


@register("drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def _(spark, sf):
    return clean.drop_duplicates(A.documents(spark, sf).select("text", "lang"))


@register("clip_quantiles", f"""
WITH {CUST} SELECT user_id,
  round(least(greatest(spend, quantile_cont(spend, 0.01) OVER ()), quantile_cont(spend, 0.99) OVER ()), 4) AS spend,
  round(least(greatest(age, quantile_cont(age, 0.01) OVER ()), quantile_cont(age, 0.99) OVER ()), 4) AS age FROM cust""")
def _(spark, sf):
    clipped = clean.clip_quantiles(A.customers(spark, sf), ["spend", "age"])
    return clipped.select("user_id", F.round("spend", 4).alias("spend"), F.round("age", 4).alias("age"))


@register("label_encode", f"""
WITH {CUST} SELECT user_id, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS category_encoded,
  gender, CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender_encoded FROM cust""")
def _(spark, sf):
    return clean.label_encode(A.customers(spark, sf).select("user_id", "category", "gender"), ["category", "gender"])


@register("factorize", f"""
WITH {DIRTY_CUST}, codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT coalesce(category, 'unknown') AS v FROM dirty WHERE spend > 0))
SELECT user_id, CAST(coalesce(code, 0) AS INTEGER) AS category_encoded
FROM dirty LEFT JOIN codes ON coalesce(category, 'unknown') = v""")
def _(spark, sf):
    dirty = dirty_customers(spark, sf)
    return clean.factorize(dirty, "category", dirty.where("spend > 0")).select("user_id", "category_encoded")


@register("standard_scale", f"""
WITH {CUST} SELECT user_id, round((spend - avg(spend) OVER ()) / stddev_pop(spend) OVER (), 6) AS spend_scaled,
  round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 6) AS age_scaled FROM cust""")
def _(spark, sf):
    scaled = clean.standard_scale(A.customers(spark, sf), ["spend", "age"])
    return scaled.select("user_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in ("spend", "age")])


@register("minmax_scale", f"""
WITH {CUST} SELECT user_id, round((spend - min(spend) OVER ()) / (max(spend) OVER () - min(spend) OVER ()), 6)
  AS spend_scaled, round((age - min(age) OVER ()) / (max(age) OVER () - min(age) OVER ()), 6) AS age_scaled FROM cust""")
def _(spark, sf):
    scaled = clean.minmax_scale(A.customers(spark, sf), ["spend", "age"])
    return scaled.select("user_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in ("spend", "age")])


@register("tercile_bucket", f"""
WITH {DIRTY_CUST}, f AS (SELECT user_id, coalesce(spend, (SELECT median(spend) FROM dirty)) AS v FROM dirty),
q AS (SELECT quantile_cont(v, 1.0/3) AS a, quantile_cont(v, 2.0/3) AS b FROM f)
SELECT user_id, CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'mid' ELSE 'high' END AS spend_bucket FROM f, q""")
def _(spark, sf):
    return clean.tercile_bucket(dirty_customers(spark, sf), "spend", "spend_bucket").select("user_id", "spend_bucket")


@register("augment_gaussian", f"""
WITH {CUST}, k AS (SELECT unnest([0, 1, 2]) AS copy_id)
SELECT CAST(copy_id AS INTEGER) AS copy_id, count(*) AS n, count(DISTINCT user_id) AS n_users,
  round(CASE WHEN copy_id = 0 THEN sum(spend) END, 2) AS spend_if_original, true AS mean_near, true AS spread_near
FROM cust, k GROUP BY copy_id""")
def _(spark, sf):
    customers = A.customers(spark, sf)
    base = customers.agg(F.struct(F.avg("spend").alias("m"), F.stddev_samp("spend").alias("s"))).scalar()
    copies = augment.augment_gaussian(customers.withColumn("original", F.col("spend")), ["spend", "age"], ["user_id"])
    noise = F.stddev_samp(F.col("spend") - F.col("original"))
    return copies.groupBy("copy_id").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"),
        F.round(F.sum(F.when(F.col("copy_id") == 0, F.col("spend"))), 2).alias("spend_if_original"),
        (F.abs(F.avg("spend") - base["m"]) < base["s"] * 0.01).alias("mean_near"),
        F.when(F.col("copy_id") == 0, F.lit(True)).otherwise(
            noise.between(base["s"] * 0.045, base["s"] * 0.055)).alias("spread_near"))


@register("augment_interactions", f"""
WITH {EV}, k AS (SELECT unnest([0, 1, 2]) AS copy_id)
SELECT CAST(copy_id AS INTEGER) AS copy_id, event_id, user_id, product_id,
  ts + to_minutes(copy_id) AS ts, true AS near FROM ev, k""")
def _(spark, sf):
    labels = ["error", "like", "purchase", "signup", "view"]
    encoded = clean.label_encode(A.interactions_ev(spark, sf), ["event_type"]).withColumn(
        "original", F.col("event_type_encoded"))
    copies = augment.augment_interactions(encoded, labels, ["event_id"])
    return copies.select("copy_id", "event_id", "user_id", "product_id", "ts",
                         (F.abs(F.col("event_type_encoded") - F.col("original")) <= 1).alias("near"))


@register("union_copies", f"""
WITH {PROD} SELECT product_id, category, count(*) AS n FROM (SELECT * FROM prod UNION ALL SELECT * FROM prod
  UNION ALL SELECT * FROM prod) GROUP BY 1, 2""")
def _(spark, sf):
    return augment.with_copies(A.products(spark, sf), 2).groupBy("product_id", "category").agg(F.count("*").alias("n"))


@register("describe", """
SELECT 'l_quantity' AS column_name, count(l_quantity) AS n, round(avg(l_quantity), 3) AS mean,
  round(stddev_samp(l_quantity), 3) AS std, round(min(l_quantity), 3) AS min,
  round(quantile_cont(l_quantity, 0.25), 3) AS q25, round(quantile_cont(l_quantity, 0.5), 3) AS q50,
  round(quantile_cont(l_quantity, 0.75), 3) AS q75, round(max(l_quantity), 3) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), round(avg(l_extendedprice), 3),
  round(stddev_samp(l_extendedprice), 3), round(min(l_extendedprice), 3), round(quantile_cont(l_extendedprice, 0.25), 3),
  round(quantile_cont(l_extendedprice, 0.5), 3), round(quantile_cont(l_extendedprice, 0.75), 3),
  round(max(l_extendedprice), 3) FROM lineitem""")
def _(spark, sf):
    return stats.describe(A.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@register("order_statistics", """
SELECT 0.01::DOUBLE AS p, round(quantile_cont(l_extendedprice, 0.01), 4) AS value FROM lineitem
UNION ALL SELECT 0.5::DOUBLE, round(quantile_cont(l_extendedprice, 0.5), 4) FROM lineitem
UNION ALL SELECT 0.99::DOUBLE, round(quantile_cont(l_extendedprice, 0.99), 4) FROM lineitem""")
def _(spark, sf):
    probs = [0.01, 0.5, 0.99]
    values = stats.exact_quantiles(
        A.table(spark, sf, "lineitem"), ["l_extendedprice"], probs)["l_extendedprice"]
    return spark.createDataFrame([(p, round(v, 4)) for p, v in zip(probs, values)], "p double, value double")


@register("run_counters", f"""
WITH {ORD} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts
FROM od""")
def _(spark, sf):
    return stats.run_counters(A.interactions_ord(spark, sf))


@register("global_row_index", f"""
WITH {ORD} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM od""")
def _(spark, sf):
    log = A.interactions_ord(spark, sf).select("ts", *A.ORDER_ORDER)
    return ordering.global_row_index(log, ["ts", *A.ORDER_ORDER]).select(*A.ORDER_ORDER, "row_index")


@register("global_temporal_split", f"""
WITH {ORD}, n AS (SELECT *, row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
  count(*) OVER () AS total FROM od)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN rn <= greatest(1, least(total - 1, floor(total * 0.8))) THEN 'train' ELSE 'test' END AS split FROM n""")
def _(spark, sf):
    return ordering.global_split(A.interactions_ord(spark, sf), "ts", A.ORDER_ORDER).select(*A.ORDER_ORDER, "split")


@register("per_user_temporal_split", f"""
WITH {ORD}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey,
  l_suppkey) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM od)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, user_id,
  CASE WHEN total < 2 OR rn <= least(greatest(1, floor(total * 0.8)), total - 1) THEN 'train' ELSE 'test' END AS split
FROM n""")
def _(spark, sf):
    split = ordering.per_user_split(A.interactions_ord(spark, sf), "ts", A.ORDER_ORDER)
    return split.select(*A.ORDER_ORDER, "user_id", "split")


@register("distinct_on", """
SELECT user_id, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf):
    events = A.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"), "event_id", "event_type", "ts")
    return ordering.first_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@register("head_n_per_group", f"""
WITH {PROD} SELECT major_cluster, product_id, name, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY major_cluster ORDER BY CAST(product_id AS BIGINT)) AS rn FROM prod WHERE major_cluster >= 0) WHERE rn <= 8""")
def _(spark, sf):
    clustered = A.products(spark, sf).where("major_cluster >= 0").select("major_cluster", "product_id", "name")
    return ordering.head_per_group(clustered, ["major_cluster"], [F.col("product_id").cast("bigint")], 8)


@register("limit_users", f"WITH {ORD} SELECT DISTINCT user_id FROM od ORDER BY user_id LIMIT 20")
def _(spark, sf):
    return ordering.limit_users(A.interactions_ord(spark, sf), 20)


@register("sort_user_time", f"""
WITH {EV} SELECT event_id, user_id, ts, event_type FROM ev ORDER BY user_id, ts, event_id""")
def _(spark, sf):
    return A.interactions_ev(spark, sf).select("event_id", "user_id", "ts", "event_type").orderBy(
        "user_id", "ts", "event_id")
