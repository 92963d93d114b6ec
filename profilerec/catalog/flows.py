"""Whole steps: cleaning, customer profiles and product profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.registry import register
from profilerec.operators import clean
from profilerec.plans import preprocess, profiles
from profilerec.sources import adapters as A


@register("clean_interactions", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS u,
  CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS t, json_extract_string(props, '$.k') AS product_id, event_type
  FROM events), f AS (SELECT event_id, product_id, event_type,
  coalesce(last_value(u IGNORE NULLS) OVER w, first_value(u IGNORE NULLS) OVER b) AS user_id,
  coalesce(last_value(t IGNORE NULLS) OVER w, first_value(t IGNORE NULLS) OVER b) AS ts FROM d
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT min(event_id) AS row_no, user_id, product_id, event_type, ts,
  CAST(any_value(code) AS INTEGER) AS event_type_encoded, CAST(any_value(hour(ts)) AS INTEGER) AS hour FROM f
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events))
  USING (event_type) GROUP BY user_id, product_id, event_type, ts""")
def _(spark, sf):
    key = F.col("event_id")
    raw = A.table(spark, sf, "events").select(
        key.alias("row_no"),
        F.when(key % 7 != 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias(" user id"),
        F.get_json_object("props", "$.k").alias("product id "),
        F.initcap("event_type").alias("Interaction type"),
        F.when(key % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Time stamp"),
        F.lit(0).alias("Unnamed: 4"))
    return preprocess.clean_interactions(raw, "row_no").select(
        "row_no", "user_id", "product_id", "event_type", "ts", "event_type_encoded", "hour")


def raw_products(spark, sf):
    """The product file's layout: suffixed ids, money text, gaps, an index column and repeated rows."""
    key = F.col("p_partkey")
    rows = A.table(spark, sf, "part").select(
        F.concat(key.cast("string"), F.lit("_7")).alias("Uniqe Id "), F.when(key % 9 != 0, F.col("p_name")).alias("Product Name"),
        F.col("p_type").alias(" Category"), F.concat(F.lit("$ "), F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("Selling Price"),
        F.when(key % 5 != 0, F.col("p_size").cast("string")).alias("Quantity"), F.lit(1).alias("Unnamed: 0"))
    return rows.unionByName(rows.where(F.col("Quantity") == "1"))


RAW_PRODUCTS = """rp AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 9 <> 0 THEN p_name ELSE '' END AS name, p_type AS category,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS q FROM part),
rq AS (SELECT median(q) AS m FROM (SELECT q FROM rp UNION ALL SELECT q FROM rp WHERE q = 1)),
cp AS (SELECT DISTINCT product_id, name, category, price, coalesce(q, m) AS quantity FROM rp, rq)"""


@register("clean_products", f"WITH {RAW_PRODUCTS} SELECT * FROM cp")
def _(spark, sf):
    return preprocess.clean_products(raw_products(spark, sf)).select("product_id", "name", "category", "price", "quantity")


def raw_customers(spark, sf):
    key = F.col("c_custkey")
    rows = A.table(spark, sf, "customer").select(
        F.concat(key.cast("string"), F.lit(".0")).alias(" Customer ID"), F.when(key % 7 != 0, (key % 60 + 15).cast("string")).alias("Age"),
        F.when(key % 6 != 0, F.when(key % 3 == 0, "M").otherwise("F")).alias("Gender"), F.col("c_mktsegment").alias("Category"),
        F.round("c_acctbal", 2).alias("Purchase Amount (USD)"), F.lit(0).alias("Unnamed: 0"))
    return rows.unionByName(rows.where(F.col("Category") == "BUILDING"))


RAW_CUSTOMERS = """rc0 AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 60 + 15 AS DOUBLE) END AS age,
  CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END END AS gender, c_mktsegment AS category,
  CAST(round(c_acctbal, 2) AS DOUBLE) AS spend FROM customer),
rc1 AS (SELECT * FROM rc0 UNION ALL SELECT * FROM rc0 WHERE category = 'BUILDING'),
am AS (SELECT median(age) AS m FROM rc1), gm AS (SELECT gender AS g FROM rc1 WHERE gender IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
rc2 AS (SELECT DISTINCT user_id, coalesce(age, m) AS age, coalesce(gender, g) AS gender, category, spend FROM rc1, am, gm),
qs AS (SELECT quantile_cont(age, [0.01, 0.99]) AS a, quantile_cont(spend, [0.01, 0.99]) AS s FROM rc2),
rc3 AS (SELECT user_id, least(greatest(age, a[1]), a[2]) AS age, gender, category, least(greatest(spend, s[1]), s[2]) AS spend FROM rc2, qs),
zs AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(spend) AS ms, stddev_pop(spend) AS ss FROM rc3)"""


@register("clean_customers", f"""
WITH {RAW_CUSTOMERS} SELECT user_id, round(age, 6) AS age, gender, category, round(spend, 6) AS spend,
  CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender_encoded, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS category_encoded,
  round((age - ma) / sa, 6) AS age_scaled, round((spend - ms) / ss, 6) AS spend_scaled FROM rc3, zs""")
def _(spark, sf):
    numbers = ("age", "spend", "age_scaled", "spend_scaled")
    done = preprocess.clean_customers(raw_customers(spark, sf))
    return done.select("user_id", "gender", "category", "gender_encoded", "category_encoded", *[F.round(c, 6).alias(c) for c in numbers])


@register("augment_all", f"""
WITH {RAW_PRODUCTS}, c AS (SELECT unnest(range(3)) AS copy_id)
SELECT 'customers' AS name, CAST(copy_id AS INTEGER) AS copy_id, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer) AS n_keys FROM c
UNION ALL SELECT 'products', CAST(copy_id AS INTEGER), (SELECT count(*) FROM cp), (SELECT count(DISTINCT product_id) FROM cp) FROM c
UNION ALL SELECT 'interactions', CAST(copy_id AS INTEGER), (SELECT count(*) FROM events), (SELECT count(DISTINCT event_id) FROM events) FROM c""")
def _(spark, sf):
    """Rows and keys of every copy of the three cleaned tables."""
    tables = preprocess.augment_all(
        preprocess.clean_customers(raw_customers(spark, sf)), preprocess.clean_products(raw_products(spark, sf)),
        clean.label_encode(A.interactions_ev(spark, sf), ["event_type"]), "event_id")
    counts = [
        t.groupBy(F.col("copy_id").cast("int").alias("copy_id")).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys")).select(
            F.lit(name).alias("name"), "copy_id", "n", "n_keys")
        for t, name, key in zip(tables, ("customers", "products", "interactions"), ("user_id", "product_id", "event_id"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("customer_profiles")
def _(spark, sf):
    people, _rfm = profiles.customer_profiles(
        A.customers(spark, sf), A.interactions_ord(spark, sf), A.products(spark, sf))
    return people


@register("product_profiles")
def _(spark, sf):
    return profiles.product_profiles(A.products(spark, sf).drop("major_cluster", "sub_cluster"))
