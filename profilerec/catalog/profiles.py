"""Lookups, aggregates, history, segments, personas and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilerec.catalog.registry import CUST, EV, ORD, PROD, register
from profilerec.functions import rules, text
from profilerec.operators import cf, clean, history, journey, ordering, persona, rfm, stats
from profilerec.sources import adapters as A



def rfm_sql(log):
    """RFM per user of a log CTE; expects ``cust``."""
    return f"""rfm AS (SELECT user_id, datesub('day', max(ts), (SELECT max(ts) FROM {log})) AS recency,
  count(*) FILTER (WHERE event_type = 'purchase') AS frequency,
  coalesce(any_value(spend), 0.0::DOUBLE) AS monetary,
  count(DISTINCT CASE WHEN event_type IN ('view', 'like') THEN product_id END) AS involvement_diversity
  FROM {log} LEFT JOIN cust USING (user_id) GROUP BY user_id)"""


# Segments of ``rfm`` with a given cluster id.
SEGMENTS = """rc AS (SELECT *, CAST(CAST(user_id AS BIGINT) % 6 AS INTEGER) AS behavior_cluster FROM rfm),
med AS (SELECT median(recency) AS mr, median(frequency) AS mf, median(monetary) AS mm,
  median(involvement_diversity) AS mi FROM rc),
cm AS (SELECT behavior_cluster, round(avg(recency), 3) AS recency, round(avg(frequency), 3) AS frequency,
  round(avg(monetary), 3) AS monetary, round(avg(involvement_diversity), 3) AS involvement_diversity FROM rc GROUP BY 1),
seg AS (SELECT behavior_cluster, CASE
  WHEN recency <= mr AND frequency >= mf AND monetary >= mm AND involvement_diversity >= mi THEN 'VIP Explorer'
  WHEN recency <= mr AND frequency >= mf AND involvement_diversity < mi THEN 'Low-Value Loyal'
  WHEN recency > mr AND monetary >= mm AND frequency >= mf THEN 'At-Risk High-Value'
  WHEN recency <= mr AND frequency < mf AND involvement_diversity >= mi THEN 'New Explorer'
  WHEN recency > mr AND frequency < mf THEN 'Dormant' ELSE 'Regular' END AS behavior_cluster_label FROM cm, med)"""
RFM = f"{ORD}, {CUST}, {rfm_sql('od')}"
SEG = f"{RFM}, {SEGMENTS}"


def order_rfm(spark, sf):
    return rfm.assemble_rfm(A.interactions_ord(spark, sf), A.customers(spark, sf))


def clustered_rfm(spark, sf):
    given = F.pmod(F.col("user_id").cast("bigint"), F.lit(6)).cast("int")
    return order_rfm(spark, sf).withColumn("behavior_cluster", given)


def event_rfm_profiles(spark, sf):
    """Customer profiles over the event log with a given cluster id and the item lists."""
    log = A.interactions_ev(spark, sf)
    given = F.pmod(F.col("user_id").cast("bigint"), F.lit(6)).cast("int")
    users = rfm.assemble_rfm(log, A.customers(spark, sf)).withColumn("behavior_cluster", given)
    labelled = rfm.attach_segment_labels(users)
    taste = history.taste_profiles(history.first_distinct_items(log, A.products(spark, sf)))
    return (
        A.customers(spark, sf)
        .select("user_id", "gender", "spend", rules.age_group(F.col("age")).alias("age_group"))
        .join(labelled, "user_id", "left").join(taste, "user_id", "left")
        .withColumn("behavior_cluster_label", F.coalesce("behavior_cluster_label", F.lit("Unclassified")))
    )


@register("recency", f"""
WITH {EV} SELECT user_id, datesub('day', max(ts), (SELECT max(ts) FROM ev)) AS recency FROM ev GROUP BY 1""")
def _(spark, sf):
    return rfm.recency(A.interactions_ev(spark, sf))


@register("frequency", f"""
WITH {ORD} SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS frequency FROM od GROUP BY 1""")
def _(spark, sf):
    return rfm.activity(A.interactions_ord(spark, sf)).select("user_id", "frequency")


@register("involvement_diversity", f"""
WITH {EV} SELECT user_id, count(DISTINCT product_id) FILTER (WHERE event_type IN ('view', 'like'))
  AS involvement_diversity FROM ev GROUP BY 1""")
def _(spark, sf):
    return rfm.activity(A.interactions_ev(spark, sf)).select("user_id", "involvement_diversity")


@register("monetary", """
SELECT CAST(o_custkey AS VARCHAR) AS user_id, round(avg(o_totalprice), 4) AS monetary FROM orders GROUP BY 1""")
def _(spark, sf):
    spend = A.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").alias("spend"))
    return rfm.monetary(spend).select("user_id", F.round("monetary", 4).alias("monetary"))


@register("assemble_rfm", f"""
WITH {RFM} SELECT user_id, recency, frequency, round(monetary, 4) AS monetary, involvement_diversity FROM rfm""")
def _(spark, sf):
    return order_rfm(spark, sf).withColumn("monetary", F.round("monetary", 4))


@register("attach_rfm", f"""
WITH {RFM} SELECT cust.user_id, category, recency, frequency, involvement_diversity
FROM cust LEFT JOIN rfm ON cust.user_id = rfm.user_id""")
def _(spark, sf):
    return A.customers(spark, sf).select("user_id", "category").join(
        order_rfm(spark, sf).select("user_id", "recency", "frequency", "involvement_diversity"), "user_id", "left")


@register("lookup_default", f"""
WITH {EV}, {CUST}, last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM ev GROUP BY 1)
SELECT user_id, coalesce(kind, 'none') AS last_kind FROM cust LEFT JOIN last USING (user_id)""")
def _(spark, sf):
    last = journey.last_event_per_user(A.interactions_ev(spark, sf), A.EVENT_ORDER)
    return A.customers(spark, sf).select("user_id").join(last, "user_id", "left").select(
        "user_id", F.coalesce("last_event_type", F.lit("none")).alias("last_kind"))


@register("feature_medians", f"""
WITH {RFM} SELECT median(recency) AS recency, median(frequency) AS frequency, round(median(monetary), 4) AS monetary,
  median(involvement_diversity) AS involvement_diversity FROM rfm""")
def _(spark, sf):
    middle = stats.medians(order_rfm(spark, sf), rfm.FEATURES)
    middle["monetary"] = round(middle["monetary"], 4)
    return spark.createDataFrame([tuple(middle.values())], ", ".join(f"{c} double" for c in middle))


@register("cluster_means", f"""
WITH {SEG} SELECT behavior_cluster, recency, frequency, monetary, involvement_diversity FROM cm""")
def _(spark, sf):
    return rfm.cluster_means(clustered_rfm(spark, sf))


@register("label_segment", f"""
WITH {SEG} SELECT user_id, behavior_cluster, behavior_cluster_label FROM rc JOIN seg USING (behavior_cluster)""")
def _(spark, sf):
    return rfm.attach_segment_labels(clustered_rfm(spark, sf)).select(
        "user_id", "behavior_cluster", "behavior_cluster_label")


@register("behavior_clusters")
def _(spark, sf):
    users, _curve = rfm.behavior_clusters(order_rfm(spark, sf))
    return users


@register("choose_k")
def _(spark, sf):
    _users, curve = rfm.behavior_clusters(order_rfm(spark, sf))
    return curve


@register("last_event_per_user", f"""
WITH {ORD} SELECT user_id, ts AS last_ts, product_id AS last_product_id, event_type AS last_event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC,
  l_partkey DESC, l_suppkey DESC) AS rn FROM od) WHERE rn = 1""")
def _(spark, sf):
    return journey.last_event_per_user(A.interactions_ord(spark, sf), A.ORDER_ORDER)


_SESSION = """tail AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM {log})
  WHERE ts >= last_ts - INTERVAL 30 MINUTE), cnt AS (SELECT user_id,
  count(*) FILTER (WHERE event_type = 'view') AS session_view_count,
  count(*) FILTER (WHERE event_type = 'like') AS session_like_count,
  count(*) FILTER (WHERE event_type = 'purchase') AS session_purchase_count,
  count(*) AS session_total_count FROM tail GROUP BY 1)"""


@register("trailing_session_counts", f"WITH {EV}, {_SESSION.format(log='ev')} SELECT * FROM cnt")
def _(spark, sf):
    return journey.trailing_session_counts(A.interactions_ev(spark, sf), A.EVENT_ORDER)


def journey_sql(log, order):
    """Journey profiles of a log CTE, without their duplicate stage column."""
    desc = ", ".join(f"{c} DESC" for c in order)
    return f"""{_SESSION.format(log=log)}, lst AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, {desc}) AS rn FROM {log}) WHERE rn = 1),
j AS (SELECT user_id, product_id AS last_interacted_product_id, event_type AS last_interaction_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_interaction_timestamp, session_view_count, session_like_count,
  session_purchase_count, session_total_count, datesub('day', ts, (SELECT max(ts) FROM {log})) AS days_since_last
  FROM lst JOIN cnt USING (user_id)),
js AS (SELECT *, CASE WHEN days_since_last >= 60 THEN 'Dormant' WHEN last_interaction_type = 'purchase' THEN 'Post-Purchase'
  WHEN session_purchase_count > 0 THEN 'Action' WHEN last_interaction_type = 'like' AND session_view_count >= 3 THEN 'Desire'
  WHEN last_interaction_type = 'like' THEN 'Interest'
  WHEN last_interaction_type = 'view' AND session_like_count = 0 THEN 'Awareness' ELSE 'Unknown' END
  AS current_journey_stage FROM j)"""


JOURNEY_EV = f"{EV}, {journey_sql('ev', ['event_id'])}"
JOURNEY_ORD = f"{ORD}, {journey_sql('od', A.ORDER_ORDER)}"


@register("journey_profiles", f"WITH {JOURNEY_ORD} SELECT *, current_journey_stage AS journey_stage FROM js")
def _(spark, sf):
    return journey.journey_profiles(A.interactions_ord(spark, sf), A.ORDER_ORDER)


@register("journey_profiles_events", f"WITH {JOURNEY_EV} SELECT *, current_journey_stage AS journey_stage FROM js")
def _(spark, sf):
    return journey.journey_profiles(A.interactions_ev(spark, sf), A.EVENT_ORDER)


@register("classify_journey_stage", f"""
WITH {JOURNEY_ORD} SELECT current_journey_stage, last_interaction_type, count(*) AS n FROM js GROUP BY 1, 2""")
def _(spark, sf):
    profiles = journey.journey_profiles(A.interactions_ord(spark, sf), A.ORDER_ORDER)
    return profiles.groupBy("current_journey_stage", "last_interaction_type").agg(F.count("*").alias("n"))


@register("stage_distribution", f"""
WITH {JOURNEY_ORD}, st AS (SELECT unnest(range(7)) AS stage_order, unnest(['Dormant', 'Awareness', 'Interest', 'Desire',
  'Action', 'Post-Purchase', 'Unknown']) AS stage)
SELECT CAST(stage_order AS INTEGER) AS stage_order, stage, count(user_id) AS n_users,
  round(count(user_id) * 100.0::DOUBLE / (SELECT count(*) FROM js), 1) AS pct
FROM st LEFT JOIN js ON stage = current_journey_stage GROUP BY 1, 2""")
def _(spark, sf):
    return journey.stage_distribution(journey.journey_profiles(A.interactions_ord(spark, sf), A.ORDER_ORDER))


def _items_sql(log_cte, log):
    return f"""{log_cte}, {PROD}, it AS (SELECT user_id, product_id, CASE event_type WHEN 'purchase' THEN 0
  WHEN 'like' THEN 1 ELSE 2 END AS tier, min(ts) AS first_ts FROM {log} JOIN prod USING (product_id)
  WHERE event_type IN ('purchase', 'like', 'view') GROUP BY 1, 2, 3),
best AS (SELECT * FROM it WHERE (user_id, tier) IN (SELECT (user_id, min(tier)) FROM it GROUP BY user_id)),
items AS (SELECT user_id, CAST(rn AS INTEGER) AS rank, product_id, name, category FROM (SELECT best.*, name, category,
  row_number() OVER (PARTITION BY user_id ORDER BY first_ts, product_id) AS rn FROM best JOIN prod USING (product_id))
  WHERE rn <= 8)"""


ITEMS_ORD = _items_sql(ORD, "od")
TASTE = """cats AS (SELECT user_id, string_agg(category, ', ' ORDER BY n DESC, f) AS major_purchase_categories FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM (
    SELECT user_id, category, count(*) AS n, min(rank) AS f FROM items GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1),
prev AS (SELECT user_id, string_agg(name, ' | ' ORDER BY rank) AS purchase_history_preview FROM items
  WHERE rank <= 5 GROUP BY 1)"""


@register("first_n_distinct_items", f"WITH {ITEMS_ORD} SELECT * FROM items")
def _(spark, sf):
    return history.first_distinct_items(A.interactions_ord(spark, sf), A.products(spark, sf))


@register("top_categories", f"WITH {ITEMS_ORD}, {TASTE} SELECT * FROM cats")
def _(spark, sf):
    items = history.first_distinct_items(A.interactions_ord(spark, sf), A.products(spark, sf))
    return history.taste_profiles(items).select("user_id", "major_purchase_categories")


@register("history_preview", f"WITH {ITEMS_ORD}, {TASTE} SELECT * FROM prev")
def _(spark, sf):
    items = history.first_distinct_items(A.interactions_ord(spark, sf), A.products(spark, sf))
    return history.taste_profiles(items).select("user_id", "purchase_history_preview")


@register("history_lists", f"""
WITH {ORD} SELECT user_id, (rn - 1) // 20 AS chunk_no, string_agg(product_id, ',' ORDER BY rn) AS products FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM od) GROUP BY 1, 2""")
def _(spark, sf):
    lists = history.history_lists(A.interactions_ord(spark, sf), A.ORDER_ORDER, chunk=20)
    return lists.select("user_id", "chunk_no", F.array_join("products", ",").alias("products"))


@register("max_rating", f"""
WITH {ORD} SELECT user_id, product_id, CAST(max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'like' THEN 3 ELSE 1 END)
  AS DOUBLE) AS rating FROM od GROUP BY 1, 2""")
def _(spark, sf):
    return A.interactions_ord(spark, sf).groupBy("user_id", "product_id").agg(
        F.max(rules.implicit_rating(F.col("event_type"))).alias("rating"))


@register("preferred_cluster", f"""
WITH {ORD}, {PROD} SELECT user_id, CAST(major_cluster AS INTEGER) AS preferred_cluster FROM (SELECT *, row_number()
  OVER (PARTITION BY user_id ORDER BY n DESC, f, major_cluster) AS rn FROM (SELECT user_id, major_cluster, count(*) AS n,
  min(ts) AS f FROM od JOIN prod USING (product_id) WHERE event_type = 'purchase' GROUP BY 1, 2)) WHERE rn = 1""")
def _(spark, sf):
    bought = A.interactions_ord(spark, sf).where("event_type = 'purchase'")
    return history.preferred_cluster(bought, A.products(spark, sf))


@register("preferred_cluster_join", f"""
WITH {ORD}, {PROD} SELECT major_cluster, count(*) AS n FROM od LEFT JOIN prod USING (product_id)
WHERE event_type = 'purchase' GROUP BY 1""")
def _(spark, sf):
    bought = clean.filter_event_types(A.interactions_ord(spark, sf), ["purchase"])
    return bought.join(A.products(spark, sf), "product_id", "left").groupBy("major_cluster").agg(
        F.count("*").alias("n"))


@register("cluster_counts", f"""
WITH {PROD} SELECT count(DISTINCT major_cluster) FILTER (WHERE major_cluster >= 0) AS n_clusters,
  count(*) FILTER (WHERE major_cluster = -1) AS n_noise, count(DISTINCT sub_cluster) AS n_sub FROM prod""")
def _(spark, sf):
    major = F.col("major_cluster")
    return A.products(spark, sf).agg(
        F.countDistinct(F.when(major >= 0, major)).alias("n_clusters"),
        F.count_if(major == -1).alias("n_noise"), F.countDistinct("sub_cluster").alias("n_sub"))


@register("catalog_intersection", f"""
WITH {EV}, {PROD} SELECT product_id FROM prod WHERE product_id IN (SELECT product_id FROM ev)""")
def _(spark, sf):
    seen = A.interactions_ev(spark, sf).select("product_id")
    return A.products(spark, sf).select("product_id").join(seen, "product_id", "left_semi")


@register("dynamic_weights", f"""
WITH {SEG} SELECT user_id, CASE WHEN involvement_diversity >= mi OR behavior_cluster_label IN
  ('VIP Explorer', 'New Explorer') THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS cf_weight,
  CASE WHEN involvement_diversity >= mi OR behavior_cluster_label IN ('VIP Explorer', 'New Explorer')
  THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS llm_weight FROM rc JOIN seg USING (behavior_cluster), med""")
def _(spark, sf):
    users = clustered_rfm(spark, sf)
    middle = F.lit(stats.medians(users, ["involvement_diversity"])["involvement_diversity"])
    args = [F.col("involvement_diversity"), middle, F.col("behavior_cluster_label")]
    return rfm.attach_segment_labels(users).select(
        "user_id", rules.cf_weight(*args).alias("cf_weight"), rules.llm_weight(*args).alias("llm_weight"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.KEYWORD_STOPWORDS) + "]"


def norm_sql(values, limit):
    """Keyword normalisation of a SQL list expression."""
    clean_expr = ("trim(regexp_replace(regexp_replace(replace(lower({v}), '#', ''), '[^a-z0-9+\\- ]', ' ', 'g'), "
                  "'\\s+', ' ', 'g'))")
    cleaned = f"list_transform({values}, lambda v: {clean_expr.format(v='v')})"
    kept = f"list_filter({cleaned}, lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))"
    numbered = f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"
    return f"({numbered})[1:{limit}]"


@register("normalize_keywords", f"""
WITH {PROD} SELECT product_id, array_to_string({norm_sql("[name, brand, '#' || category, name, 'Item', 'x1']", 4)}, ',')
  AS keywords FROM prod""")
def _(spark, sf):
    values = F.array("name", "brand", F.concat(F.lit("#"), "category"), "name", F.lit("Item"), F.lit("x1"))
    return A.products(spark, sf).select(
        "product_id", F.array_join(text.normalize_keywords(values, 4), ",").alias("keywords"))


def top_terms_sql(source, key, value, limit, out):
    """Top terms per key of a relation with (key, pos, value)."""
    return f"""{out}_t AS (SELECT {key}, pos, unnest(regexp_extract_all(lower({value}), '[a-zA-Z][a-zA-Z0-9+\\-]{{2,}}'))
  AS term, generate_subscripts(regexp_extract_all(lower({value}), '[a-zA-Z][a-zA-Z0-9+\\-]{{2,}}'), 1) AS tpos
  FROM {source}), {out}_c AS (SELECT {key}, term, count(*) AS n, min(pos * 1000 + tpos) AS f FROM {out}_t
  WHERE NOT list_contains({_STOP}, term) GROUP BY 1, 2),
{out} AS (SELECT {key}, list(term ORDER BY n DESC, f) AS terms FROM (SELECT *, row_number() OVER
  (PARTITION BY {key} ORDER BY n DESC, f) AS rn FROM {out}_c) WHERE rn <= {limit} GROUP BY 1)"""


@register("top_terms", f"""
WITH {ITEMS_ORD}, nm AS (SELECT user_id, rank AS pos, name || ' ' || category AS v FROM items),
{top_terms_sql('nm', 'user_id', 'v', 3, 'tt')} SELECT user_id, array_to_string(terms, ',') AS terms FROM tt""")
def _(spark, sf):
    items = history.first_distinct_items(A.interactions_ord(spark, sf), A.products(spark, sf))
    lists = history.taste_profiles(items)
    words = F.transform("items", lambda s: F.concat(s["name"], F.lit(" "), s["category"]))
    return lists.select("user_id", F.array_join(text.top_terms(words, 3), ",").alias("terms"))


# Personas of all customers over the event log as SQL.
ITEMS_EV = _items_sql(EV, "ev")
PERSONA = f"""{ITEMS_EV}, {CUST}, {rfm_sql('ev')}, {SEGMENTS},
{TASTE}, cin AS (SELECT user_id, rank AS pos, category AS v FROM items), nin AS (SELECT user_id, rank AS pos, name AS v FROM items),
{top_terms_sql('cin', 'user_id', 'v', 3, 'ct')}, {top_terms_sql('nin', 'user_id', 'v', 3, 'nt')},
kw AS (SELECT user_id, {norm_sql("list_concat(ct.terms, nt.terms)", 4)} AS terms FROM ct JOIN nt USING (user_id)),
base AS (SELECT cust.user_id, gender, spend, CASE WHEN age <= 19 THEN '10s' WHEN age <= 29 THEN '20s' WHEN age <= 39 THEN '30s'
  WHEN age <= 49 THEN '40s' WHEN age <= 59 THEN '50s' ELSE '60+' END AS age_group,
  coalesce(behavior_cluster_label, 'Unclassified') AS behavior_cluster_label, rc.behavior_cluster,
  coalesce(involvement_diversity, 0) AS involvement_diversity, coalesce(major_purchase_categories, '') AS cats,
  coalesce(terms, []) AS terms FROM cust LEFT JOIN rc USING (user_id) LEFT JOIN seg USING (behavior_cluster)
  LEFT JOIN cats ON cust.user_id = cats.user_id LEFT JOIN kw ON cust.user_id = kw.user_id),
pers AS (SELECT *, age_group || ' ' || lower(gender) || ' customer in the ' || lower(behavior_cluster_label) ||
  ' segment who gravitates toward ' || CASE WHEN len(terms) > 0 THEN array_to_string(terms[1:2], ', ')
  ELSE 'broad catalog exploration' END || ' and is currently in unknown stage.' AS persona,
  CASE WHEN len(terms) > 0 THEN array_to_string(list_transform(terms, lambda t: '#' || replace(t, ' ', '')), ', ')
  ELSE '#general' END AS interest_keywords,
  CASE behavior_cluster_label WHEN 'VIP Explorer' THEN 'novelty, quality, and breadth of choice'
  WHEN 'Low-Value Loyal' THEN 'repeat convenience and dependable value'
  WHEN 'At-Risk High-Value' THEN 'premium preference with declining recent engagement'
  WHEN 'New Explorer' THEN 'discovery and onboarding curiosity'
  WHEN 'Dormant' THEN 'reactivation triggers and event-driven demand'
  WHEN 'Regular' THEN 'stable, routine everyday needs'
  WHEN 'Unclassified' THEN 'limited observed behavior' ELSE 'balanced everyday demand' END AS purchase_motive FROM base)"""


@register("persona_text", f"""
WITH {PERSONA} SELECT user_id, persona, interest_keywords, purchase_motive FROM pers""")
def _(spark, sf):
    return persona.persona_text(event_rfm_profiles(spark, sf)).select("user_id", *persona.PERSONA_COLUMNS)


@register("batched_enrichment", f"""
WITH {PERSONA} SELECT user_id, CASE WHEN gender = 'F' THEN upper(age_group) ELSE persona END AS persona,
  interest_keywords, purchase_motive FROM pers""")
def _(spark, sf):
    """Half of the requests are cached, the model answers one field for some, the template does the rest."""
    records = event_rfm_profiles(spark, sf).select(
        "user_id", "age_group", "gender", "behavior_cluster_label", "items")
    payload = ["age_group", "gender", "behavior_cluster_label", "items"]

    def answer(rows):
        return {r["cache_key"]: {"persona": r["age_group"].upper()} for r in rows if r["gender"] == "F"}

    active = records.where("items IS NOT NULL AND gender = 'M'").withColumn(
        "cache_key", persona.cache_key("customer_persona", payload))
    cache = persona.persona_text(active.dropDuplicates(["cache_key"])).select("cache_key", *persona.PERSONA_COLUMNS)
    done, _fresh = persona.personas_with_cache(records, cache, answer)
    return done.select("user_id", *persona.PERSONA_COLUMNS)


@register("user_profile_text", f"""
WITH {PERSONA}, {journey_sql('ev', ['event_id'])} SELECT user_id, persona || ' [SEP] ' || interest_keywords || ' [SEP] ' || purchase_motive || ' [SEP] ' || cats ||
  ' [SEP] ' || coalesce(current_journey_stage, 'Unknown') AS user_text FROM pers LEFT JOIN js USING (user_id)""")
def _(spark, sf):
    stages = journey.journey_profiles(A.interactions_ev(spark, sf), A.EVENT_ORDER)
    return persona.user_profile_text(persona.persona_text(event_rfm_profiles(spark, sf)), stages)


@register("cluster_tags", f"""
WITH {PROD}, h AS (SELECT major_cluster, row_number() OVER (PARTITION BY major_cluster ORDER BY CAST(product_id AS BIGINT))
  AS pos, name AS v FROM prod WHERE major_cluster >= 0), s AS (SELECT * FROM h WHERE pos <= 8),
{top_terms_sql('s', 'major_cluster', 'v', 4, 'tt')}
SELECT major_cluster, array_to_string(terms, ', ') AS attribute_tags, 'Cluster ' || major_cluster ||
  ' groups products centered on ' || array_to_string(terms[1:3], ', ') || '.' AS cluster_summary FROM tt""")
def _(spark, sf):
    clustered = A.products(spark, sf).where("major_cluster >= 0")
    head = ordering.head_per_group(clustered, ["major_cluster"], [F.col("product_id").cast("bigint")], 8)
    names = head.groupBy("major_cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("s"))
    clusters = names.select("major_cluster", F.transform("s", lambda x: x["name"]).alias("sample_names"),
                            F.lit(None).cast("array<string>").alias("keywords"))
    return persona.cluster_tags(clusters).select("major_cluster", "attribute_tags", "cluster_summary")


@register("popularity", f"""
WITH {ORD}, b AS (SELECT product_id, count(*) AS n FROM od WHERE event_type = 'purchase' GROUP BY 1)
SELECT product_id, round(n / (SELECT sum(n) FROM b), 8) AS popularity FROM b""")
def _(spark, sf):
    return cf.popularity(A.interactions_ord(spark, sf)).select("product_id", F.round("popularity", 8).alias("popularity"))


@register("ground_truth_sets", f"""
WITH {ORD}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey,
  l_suppkey) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM od)
SELECT DISTINCT user_id, product_id FROM n WHERE total >= 2 AND rn > least(greatest(1, floor(total * 0.8)), total - 1)""")
def _(spark, sf):
    split = ordering.per_user_split(A.interactions_ord(spark, sf), "ts", A.ORDER_ORDER)
    return history.ground_truth(split.where("split = 'test'"))
