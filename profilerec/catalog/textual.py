"""Term weights, keywords, token counts and text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.profiles import PERSONA, event_rfm_profiles, journey_sql
from profilerec.catalog.registry import EV, PROD, register
from profilerec.functions import text
from profilerec.operators import cf, history, journey, persona, textmine
from profilerec.sources import adapters as A

STOP = "[" + ", ".join(f"'{w}'" for w in text.ENGLISH_STOPWORDS) + "]"


def counts_sql(source, key, column, out):
    """(key, term, tf) of a relation."""
    return f"""{out} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key},
  unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source})
  WHERE NOT list_contains({STOP}, term) GROUP BY 1, 2)"""


def weights_sql(counts, vocab, key, out):
    return f"""{out} AS (SELECT {key}, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, term, tf, tf * idf AS raw FROM {counts} JOIN {vocab} USING (term)))"""


def vocab_sql(counts, n_docs, out, min_df=1, max_df=1.0, max_features=None):
    cap = f"ORDER BY sum(tf) DESC, term LIMIT {max_features}" if max_features else ""
    return f"""{out} AS (SELECT term, ln((1.0::DOUBLE + {n_docs}) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf,
  count(*) AS df FROM {counts} GROUP BY term
  HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * {n_docs} {cap})"""


N_DOCS = "(SELECT count(*) FROM documents)"

# Product texts with given tags, for exact checks.
PRODX = f"""{PROD}, prodx AS (SELECT *, lower(category) || ', ' || name AS attribute_tags,
  lower(replace(brand, '#', ' ')) AS tfidf_keywords, 'Cluster ' || major_cluster AS cluster_summary,
  name || ' [SEP] ' || category || ' [SEP] ' || brand AS combined_text FROM prod)"""


def tagged_products(spark, sf):
    return A.products(spark, sf).select(
        "*",
        F.concat(F.lower("category"), F.lit(", "), "name").alias("attribute_tags"),
        F.lower(F.replace("brand", F.lit("#"), F.lit(" "))).alias("tfidf_keywords"),
        F.concat(F.lit("Cluster "), F.col("major_cluster").cast("string")).alias("cluster_summary"),
        text.combined_text([F.col("name"), F.col("category"), F.col("brand")]).alias("combined_text"))


def active_products(spark, sf):
    """Catalog products that occur in the event log."""
    return tagged_products(spark, sf).join(
        A.interactions_ev(spark, sf).select("product_id"), "product_id", "left_semi")


def user_texts(spark, sf):
    """Profile texts of the users of the event log."""
    log = A.interactions_ev(spark, sf)
    stages = journey.journey_profiles(log, A.EVENT_ORDER)
    profiles = persona.persona_text(event_rfm_profiles(spark, sf)).join(log.select("user_id"), "user_id", "left_semi")
    return persona.user_profile_text(profiles, stages)


# Cosine of user texts and product texts over the event log: sem(user_id, product_id, score).
SEMANTIC = f"""{PERSONA}, {PRODX.replace(PROD + ', ', '')}, {journey_sql('ev', ['event_id'])},
cat AS (SELECT * FROM prodx WHERE product_id IN (SELECT product_id FROM ev)),
utext AS (SELECT user_id, persona || ' [SEP] ' || interest_keywords || ' [SEP] ' || purchase_motive || ' [SEP] ' || cats ||
  ' [SEP] ' || current_journey_stage AS user_text FROM pers JOIN js USING (user_id)),
ptext AS (SELECT product_id, combined_text || ' [SEP] ' || attribute_tags || ' [SEP] ' || cluster_summary AS product_text FROM cat),
{counts_sql('ptext', 'product_id', 'product_text', 'pc')}, {counts_sql('utext', 'user_id', 'user_text', 'uc')},
{vocab_sql('pc', '(SELECT count(*) FROM ptext)', 'vo', 1, 0.95, 2048)},
{weights_sql('pc', 'vo', 'product_id', 'pw')}, {weights_sql('uc', 'vo', 'user_id', 'uw')},
sem AS (SELECT user_id, product_id, round(sum(uw.weight * pw.weight), 9) AS score FROM uw JOIN pw USING (term) GROUP BY 1, 2)"""


@register("tfidf", f"""
WITH {counts_sql('documents', 'doc_id', 'text', 'c')}, {vocab_sql('c', N_DOCS, 'v', 2, 0.95)},
{weights_sql('c', 'v', 'doc_id', 'w')} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w""")
def _(spark, sf):
    weights = textmine.tfidf(A.documents(spark, sf), "doc_id", "text", min_df=2, max_df=0.95)
    return weights.withColumn("weight", F.round("weight", 6))


@register("tfidf_max_features", f"""
WITH {counts_sql('documents', 'doc_id', 'text', 'c')}, {vocab_sql('c', N_DOCS, 'v', 2, 0.95, 768)},
{weights_sql('c', 'v', 'doc_id', 'w')} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w""")
def _(spark, sf):
    weights = textmine.tfidf(A.documents(spark, sf), "doc_id", "text", max_features=768, min_df=2, max_df=0.95)
    return weights.withColumn("weight", F.round("weight", 6))


@register("ctfidf_keywords", f"""
WITH {counts_sql('documents', 'source', 'text', 'c')}, {vocab_sql('c', '(SELECT count(DISTINCT source) FROM c)', 'v')},
r AS (SELECT source, term, df, tf * idf AS raw FROM c JOIN v USING (term)),
s AS (SELECT source, sum(raw) AS row_sum, sqrt(sum(raw * raw)) AS row_length FROM r GROUP BY 1),
k AS (SELECT source, term, round(raw / row_sum * (ln(((SELECT avg(row_sum / row_length) FROM s) + 1) / (df + 1)) + 1), 9)
  AS score FROM r JOIN s USING (source))
SELECT source, term, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY source ORDER BY score DESC, term) AS rn FROM k WHERE score > 0) WHERE rn <= 7""")
def _(spark, sf):
    return textmine.ctfidf_keywords(A.documents(spark, sf), "source", "text").withColumn("score", F.round("score", 6))


@register("frequent_tokens", """
WITH c AS (SELECT source, token, count(*) AS n FROM (SELECT source,
  unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents) WHERE length(token) >= 4 GROUP BY 1, 2)
SELECT source, token, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY source ORDER BY n DESC, token) AS rn FROM c) WHERE rn <= 7""")
def _(spark, sf):
    return textmine.frequent_tokens(A.documents(spark, sf), "source", "text")


@register("cluster_documents", f"""
WITH {counts_sql('documents', 'source', 'text', 'c')}
SELECT source, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words FROM c GROUP BY 1""")
def _(spark, sf):
    counts = textmine.term_counts(A.documents(spark, sf), "source", "text")
    return counts.groupBy("source").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_words"))


@register("embed_text")
def _(spark, sf):
    vectors = textmine.embed_text(A.documents(spark, sf), "doc_id", "text", dims=128)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("doc_id", F.size("embedding").alias("n_dims"), F.round(length, 4).alias("length"))


@register("keyword_overlap", f"""
WITH {PERSONA}, {PRODX.replace(PROD + ', ', '')}, last AS (SELECT user_id, arg_max(product_id, (ts, event_id))
  AS product_id FROM ev GROUP BY 1),
ut AS (SELECT DISTINCT user_id, unnest(regexp_split_to_array(replace(replace(interest_keywords, '#', ' '), ',', ' '), '\\s+'))
  AS t FROM pers), pt AS (SELECT DISTINCT product_id, unnest(regexp_split_to_array(replace(attribute_tags || ' ' ||
  tfidf_keywords, ',', ' '), '\\s+')) AS t FROM prodx)
SELECT l.user_id, l.product_id, CAST(count(pt.t) AS INTEGER) AS keyword_overlap FROM last l
LEFT JOIN ut ON l.user_id = ut.user_id AND ut.t <> '' LEFT JOIN pt ON l.product_id = pt.product_id AND ut.t = pt.t
GROUP BY 1, 2""")
def _(spark, sf):
    last = journey.last_event_per_user(A.interactions_ev(spark, sf), A.EVENT_ORDER).select(
        "user_id", F.col("last_product_id").alias("product_id"))
    people = persona.persona_text(event_rfm_profiles(spark, sf)).select("user_id", "interest_keywords")
    overlap = text.keyword_overlap(F.col("interest_keywords"), F.col("attribute_tags"), F.col("tfidf_keywords"))
    return last.join(people, "user_id").join(tagged_products(spark, sf), "product_id").select(
        "user_id", "product_id", overlap.alias("keyword_overlap"))


@register("merge_dedupe_ordered", f"""
WITH {EV}, l AS (SELECT user_id, list(product_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase') AS a,
  list(product_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'like') AS b FROM ev GROUP BY 1),
u AS (SELECT user_id, unnest(list_concat(coalesce(a, []), coalesce(b, []))) AS p,
  generate_subscripts(list_concat(coalesce(a, []), coalesce(b, [])), 1) AS i FROM l)
SELECT user_id, string_agg(p, ',' ORDER BY f) AS merged FROM (SELECT user_id, p, min(i) AS f FROM u GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    def lists(kind):
        chunks = history.history_lists(
            A.interactions_ev(spark, sf).where(F.col("event_type") == kind), A.EVENT_ORDER)
        whole = chunks.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "products"))).alias("s"))
        return whole.select("user_id", F.flatten(F.transform("s", lambda x: x["products"])).alias(kind))

    none = F.array().cast("array<string>")
    both = lists("purchase").join(lists("like"), "user_id", "full_outer")
    merged = text.merge_dedupe_ordered(F.coalesce("purchase", none), F.coalesce("like", none))
    return both.select("user_id", F.array_join(merged, ",").alias("merged"))


@register("cosine_topk", f"""
WITH {SEMANTIC} SELECT user_id, product_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rn FROM sem WHERE score > 0) WHERE rn <= 20""")
def _(spark, sf):
    items = textmine.product_text(active_products(spark, sf))
    return textmine.cosine_topk(user_texts(spark, sf), items, 20).withColumn("score", F.round("score", 6))


@register("recommend_content", f"""
WITH {SEMANTIC} SELECT user_id, product_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rn FROM sem WHERE score > 0 AND
  (user_id, product_id) NOT IN (SELECT (user_id, product_id) FROM ev WHERE event_type = 'purchase')) WHERE rn <= 10""")
def _(spark, sf):
    items = textmine.product_text(active_products(spark, sf))
    seen = cf.seen_pairs(A.interactions_ev(spark, sf), "purchase")
    return textmine.cosine_topk(user_texts(spark, sf), items, 10, seen=seen).withColumn("score", F.round("score", 6))
