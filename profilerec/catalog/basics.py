"""Sources, sinks, projections, filters and id rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.registry import CUST, EV, ORD, PROD, register
from profilerec.functions import ids, rules, text
from profilerec.operators import clean, ordering, persona
from profilerec.session import scratch_path
from profilerec.sources import adapters as A
from profilerec.sources import tables


@register("read_table", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return tables.read_table(spark, f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@register("write_table", f"WITH {PROD} SELECT product_id, name, category, price FROM prod")
def _(spark, sf):
    path = scratch_path(spark, "products")
    tables.write_table(A.products(spark, sf).select("product_id", "name", "category", "price"), path)
    return tables.read_table(spark, path)


@register("embeddings_roundtrip", """
SELECT CAST(vec_id AS VARCHAR) AS product_id, len(embedding) AS n_dims,
  round(list_sum(embedding::DOUBLE[]), 4) AS total, label FROM embeddings""")
def _(spark, sf):
    vectors = A.product_vectors(spark, sf)
    path = scratch_path(spark, "vectors")
    tables.write_embeddings(vectors, path)
    back = tables.read_embeddings(spark, path, vectors.select("product_id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.join(vectors.select("product_id", "label"), "product_id").select(
        "product_id", F.size("embedding").cast("bigint").alias("n_dims"), F.round(total, 4).alias("total"), "label")


@register("json_map", f"""
WITH {PROD} SELECT CAST(major_cluster AS VARCHAR) AS major_cluster,
  to_json({{'categories': list_sort(list(DISTINCT category)), 'n': count(*)}})::VARCHAR AS json
FROM prod GROUP BY 1""")
def _(spark, sf):
    per_cluster = A.products(spark, sf).groupBy("major_cluster").agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("n"))
    return tables.json_map(per_cluster, "major_cluster", ["categories", "n"])


@register("csv_roundtrip", f"""
WITH {PROD} SELECT product_id, name || chr(10) || '"' || category || '", x' AS name, price FROM prod""")
def _(spark, sf):
    """Quotes, commas and line breaks survive a CSV file."""
    text = F.concat("name", F.lit('\n"'), "category", F.lit('", x')).alias("name")
    path = scratch_path(spark, "products-csv")
    tables.write_table(A.products(spark, sf).select("product_id", text, "price"), path, "csv")
    return tables.read_table(spark, path, "csv", "product_id string, name string, price double")


@register("json_sink", f"""
WITH {PROD} SELECT major_cluster, list_aggregate(list_sort(list(DISTINCT category)), 'string_agg', ',') AS categories, count(*) AS n
FROM prod GROUP BY 1""")
def _(spark, sf):
    per_cluster = A.products(spark, sf).groupBy("major_cluster").agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("n"))
    path = scratch_path(spark, "clusters-json")
    tables.write_json_map(per_cluster, path, "major_cluster", ["categories", "n"])
    back = tables.read_table(spark, path, "json", per_cluster.schema)
    return back.withColumn("categories", F.array_join("categories", ","))


@register("enrichment_cache", f"""
WITH {EV}, {CUST}, keyed AS (SELECT user_id, sha256(to_json({{'kind': 'customer_persona',
  'payload': {{'category': category, 'gender': gender, 'size': size}}}})::VARCHAR) AS cache_key FROM cust),
known AS (SELECT DISTINCT cache_key FROM keyed
  WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase'))
SELECT cache_key IN (SELECT cache_key FROM known) AS is_hit, cache_key, count(*) AS n FROM keyed GROUP BY 1, 2""")
def _(spark, sf):
    records = A.customers(spark, sf).select("user_id", "category", "gender", "size")
    payload = ["category", "gender", "size"]
    buyers = A.interactions_ev(spark, sf).where("event_type = 'purchase'").select("user_id")
    cache = records.join(buyers, "user_id", "left_semi").select(
        persona.cache_key("customer_persona", payload).alias("cache_key"))
    return persona.split_cached(records, cache, "customer_persona", payload).groupBy("is_hit", "cache_key").agg(
        F.count("*").alias("n"))


@register("clean_headers", "SELECT c_custkey AS cust_key, c_acctbal AS balance FROM customer")
def _(spark, sf):
    raw = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" cust_key "), F.col("c_acctbal").alias("balance "),
        F.col("c_nationkey").alias("Unnamed: 0"))
    return clean.clean_headers(raw)


@register("rename_columns", """
SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS product_id,
  event_type, ts FROM events""")
def _(spark, sf):
    raw = A.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user id"), F.get_json_object("props", "$.k").alias("product id"),
        F.col("event_type").alias("Interaction type"), F.col("ts").alias("Time stamp"))
    return clean.rename_columns(raw, tables.INTERACTION_COLUMNS)


_RAW_ID = """CASE o_orderkey % 5 WHEN 0 THEN ' ' || o_custkey || '.0 ' WHEN 1 THEN o_custkey || '.50'
  WHEN 2 THEN 'A' || o_custkey WHEN 3 THEN o_custkey || 'e1' ELSE CASE WHEN o_custkey % 2 = 0 THEN '  ' END END"""


@register("normalize_user_id", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || '.5'
  WHEN 2 THEN 'A' || o_custkey WHEN 3 THEN CAST(o_custkey * 10 AS VARCHAR) ELSE '' END AS user_id FROM orders""")
def _(spark, sf):
    raw = A.table(spark, sf, "orders").select("o_orderkey", F.expr(_RAW_ID).alias("raw"))
    return raw.select("o_orderkey", ids.normalize_user_id(F.col("raw")).alias("user_id"))


@register("normalize_product_id", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_suppkey % 2 = 0 THEN 'P' || l_partkey ELSE 'P' || l_partkey || '_' || l_suppkey END AS product_id
FROM lineitem""")
def _(spark, sf):
    raw = F.expr("CASE WHEN l_suppkey % 2 = 0 THEN ' P' || l_partkey || '_' || l_suppkey "
                 "ELSE 'P' || l_partkey || '_' || l_suppkey || '_' || l_linenumber END")
    return A.table(spark, sf, "lineitem").select(
        *A.ORDER_ORDER, ids.normalize_product_id(raw).alias("product_id"))


@register("normalize_interaction_ids", f"WITH {EV} SELECT event_id, user_id, product_id FROM ev")
def _(spark, sf):
    ev = A.interactions_ev(spark, sf).select(
        "event_id", F.concat("user_id", F.lit(".0")).alias("user_id"),
        F.concat(F.lit(" "), "product_id", F.lit("_"), F.col("event_id").cast("string")).alias("product_id"))
    return clean.normalize_interaction_ids(ev)


@register("parse_money", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def _(spark, sf):
    shown = F.concat(F.lit("$ "), F.format_number(F.col("o_totalprice"), 2))
    return A.table(spark, sf, "orders").select("o_orderkey", ids.parse_money(shown).alias("price"))


@register("parse_timestamp", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 3 THEN NULL
  ELSE date_trunc('minute', ts) END AS ts FROM events""")
def _(spark, sf):
    shown = F.expr("""CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
      WHEN 1 THEN date_format(ts, 'MM/dd/yyyy HH:mm') WHEN 2 THEN
      CASE WHEN day(ts) > 12 THEN date_format(ts, 'dd/MM/yyyy HH:mm') ELSE date_format(ts, 'MM/dd/yyyy HH:mm') END
      ELSE 'bad' END""")
    return A.table(spark, sf, "events").select("event_id", ids.parse_timestamp(shown).alias("ts"))


@register("canonical_event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    noisy = F.concat(F.lit("  "), F.initcap("event_type"), F.lit(" "))
    return A.table(spark, sf, "events").groupBy(ids.canonical_event_type(noisy).alias("event_type")).agg(
        F.count("*").alias("n"))


@register("valid_interactions", f"""
WITH {EV} SELECT event_id, user_id, product_id FROM ev
WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0""")
def _(spark, sf):
    key = F.col("event_id")
    dirty = A.interactions_ev(spark, sf).withColumns({
        "ts": F.when(key % 11 != 0, F.col("ts")),
        "user_id": F.when(key % 7 == 0, "").otherwise(F.col("user_id")),
        "product_id": F.when(key % 13 == 0, "").when(key % 17 == 0, ids.UNKNOWN_PRODUCT).otherwise(F.col("product_id"))})
    return clean.valid_interactions(dirty).select("event_id", "user_id", "product_id")


@register("filter_event_types", f"""
WITH {ORD} SELECT event_type, count(*) AS n FROM od WHERE event_type IN ('view', 'like') GROUP BY 1""")
def _(spark, sf):
    return clean.filter_event_types(A.interactions_ord(spark, sf), ["view", "like"]).groupBy("event_type").agg(
        F.count("*").alias("n"))


@register("sample_n", f"""
WITH {PROD} SELECT product_id, name FROM prod ORDER BY md5('42:' || product_id), product_id LIMIT 500""")
def _(spark, sf):
    return ordering.sample_n(A.products(spark, sf).select("product_id", "name"), "product_id", 500)


@register("time_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(hour(ts) AS INTEGER) AS hour FROM events""")
def _(spark, sf):
    return A.table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in ids.time_parts(F.col("ts")).items()])


@register("format_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def _(spark, sf):
    return A.table(spark, sf, "events").select("event_id", ids.format_ts(F.col("ts")).alias("shown"))


_COMBINED = """trim(regexp_replace(concat_ws(' [SEP] ', name, category, brand, '', '  x   y ', ''), '\\s+', ' ', 'g'))"""


@register("combined_text", f"""
WITH {PROD} SELECT product_id, {_COMBINED} AS combined_text,
  CAST(length({_COMBINED}) AS INTEGER) AS text_length FROM prod""")
def _(spark, sf):
    fields = [F.col("name"), F.col("category"), F.col("brand"), F.lit(None), F.lit("  x   y "), F.lit("")]
    out = A.products(spark, sf).select("product_id", text.combined_text(fields).alias("combined_text"))
    return out.withColumn("text_length", F.length("combined_text"))


@register("implicit_rating", f"""
WITH {EV} SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 5 WHEN 'like' THEN 3 ELSE 1 END AS DOUBLE)
  AS rating FROM ev""")
def _(spark, sf):
    return A.interactions_ev(spark, sf).select("event_id", rules.implicit_rating(F.col("event_type")).alias("rating"))


@register("age_group", f"""
WITH {CUST} SELECT user_id, CASE WHEN age < 0 OR age > 200 THEN 'unknown' WHEN age <= 19 THEN '10s'
  WHEN age <= 29 THEN '20s' WHEN age <= 39 THEN '30s' WHEN age <= 49 THEN '40s' WHEN age <= 59 THEN '50s'
  ELSE '60+' END AS age_group, coalesce(size, 'unknown') AS preferred_size FROM cust""")
def _(spark, sf):
    return A.customers(spark, sf).select(
        "user_id", rules.age_group(F.col("age")).alias("age_group"),
        rules.preferred_size(F.col("size")).alias("preferred_size"))


@register("json_block", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN props END AS block,
  CASE WHEN event_id % 3 <> 1 THEN '[' || props || ']' END AS list_block FROM events""")
def _(spark, sf):
    noisy = F.expr("CASE WHEN event_id % 3 = 0 THEN 'answer: {' || props ELSE 'answer: ' || props || ' done' END")
    listed = F.expr("CASE WHEN event_id % 3 = 1 THEN 'none' ELSE 'list [' || props || '] end' END")
    return A.table(spark, sf, "events").select(
        "event_id", text.json_block(noisy).alias("block"), text.json_block(listed, "[").alias("list_block"))
