"""Named queries of the corpus operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from profilerec.llm import chat, decontaminate, jaccard, lm, merkle, packing, pii, quality, repeats, resample, search, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\5c'), '<', '\3c'), '[', '\5b')) AS body,
    length(replace(replace(replace(replace(role, '\', '\5c'), '<', '\3c'), '[', '\5b'), '|', '\7c')) AS head
  FROM r
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + body + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    records = chat.records_of_rows(rows, "conv_id", "turn", "role", "text")
    done = chat.format_turns(chat.canonical_turns(records, ["messages"])).select("conv_id", "formatted", "loss_spans")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    turns = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), digest(F.array_join(turns, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_lm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.interpolation_scores(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), c AS (
  SELECT list_sort(s) AS s, min(doc_id) AS first, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL
), e AS (
  SELECT first, n, unnest(s) AS g FROM c
), rare AS (
  SELECT g, count(*) AS f FROM e GROUP BY g
), p AS (
  SELECT first, n, g FROM (
    SELECT e.*, row_number() OVER (PARTITION BY first ORDER BY f, g) AS k FROM e JOIN rare USING (g)
  ) WHERE k <= n - ceil(85 * n / 100) + 1
), cand AS (
  SELECT DISTINCT a.first AS a, b.first AS b FROM p a JOIN p b USING (g) WHERE a.first < b.first AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM cand JOIN c x ON x.first = a JOIN c y ON y.first = b
  WHERE 185 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE least(c.first, coalesce(least.m, c.first)) END AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN least ON c.first = least.a
"""


@query("op5_ngram_jaccard", JACCARD_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path(), with_ids=False)


@query("op7_bm25_topk")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_documents(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return quality.score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


URL_RULES = (
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
)

URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS u, html, split_part(url, '#', 1) AS node FROM pages
), r(rule, host, path, action) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), t AS (
  SELECT node, split_part(u, '://', 1) AS scheme, regexp_extract(u, '^.*?(://[^/?#]*)', 1) AS site,
    unnest([
      regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
      regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1)
    ]) AS target
  FROM p
), e AS (
  SELECT DISTINCT node AS a, split_part(CASE WHEN instr(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target
    WHEN starts_with(target, '/') THEN scheme || site || target END, '#', 1) AS b FROM t WHERE target <> ''
), both_ways AS (
  SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), urls AS (
  SELECT DISTINCT u FROM p UNION SELECT DISTINCT a FROM both_ways
), split AS (
  SELECT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM urls
), hosts AS (
  SELECT u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), ruled AS (
  SELECT h.u, h.host, h.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM hosts h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL
), tainted AS (
  SELECT DISTINCT reach.a FROM reach JOIN ruled ON reach.b = ruled.u WHERE ruled.action = 'block'
)
SELECT p.page_id, ruled.host, ruled.path, ruled.rule,
  coalesce(ruled.action, CASE WHEN tainted.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p JOIN ruled ON p.u = ruled.u LEFT JOIN tainted ON p.node = tainted.a
"""


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


RESAMPLE_SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), n AS (
  SELECT side, row_number() OVER () AS r, doc_id, w FROM w
), f AS (
  SELECT side, r, unnest(w) AS g FROM n
), h AS (
  SELECT g, hex(encode(g)) AS b FROM (SELECT DISTINCT g FROM f)
), c AS (
  SELECT g, xor(4294967295, list_reduce([CAST(('0x' || substr(b, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(0, length(b) // 2)],
    lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda q, z: xor(q >> 1, (q & 1) * 3988292384), xor(a, x)), 4294967295)) % 10000 AS bucket FROM h
), k AS (
  SELECT bucket, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t FROM f JOIN c USING (g) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM k
), d AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), e AS (
  SELECT n.doc_id, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(n.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM n LEFT JOIN d USING (r) WHERE side = 0
), s AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS pos,
    floor(count(*) OVER (PARTITION BY n_features >= 20) * 10 / 100) AS draw FROM s
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_features >= 20 AND pos <= draw THEN CAST(pos AS BIGINT) END AS rank
FROM o
"""


@query("op11_importance_resampling", RESAMPLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    drawn = resample.resample(docs, target, resample.ResampleOptions(grams=1), with_text=False)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS b FROM documents
), c AS (
  SELECT *, xor(4294967295, list_reduce([CAST(('0x' || substr(b, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(0, length(b) // 2)],
    lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384), xor(a, x)), 4294967295)) AS crc FROM d
), v AS (
  SELECT doc_id, source, leaf, coalesce(changed, leaf) AS now FROM (
    SELECT doc_id, source, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN crc % 5 = 0 THEN sha256(h || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
    FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS h FROM c)
  )
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM v
), t(source, level, pos, size, digest) AS (
  SELECT source, 0, pos, size, leaf FROM l
  UNION ALL
  SELECT source, level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE size > 1 GROUP BY source, level, pos // 16, size
), top AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1
), u(level, pos, size, digest) AS (
  SELECT 0, pos, size, subroot FROM top
  UNION ALL
  SELECT level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE size > 1 GROUP BY level, pos // 16, size
), ts AS (
  SELECT source, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM t WHERE size > 1 WINDOW w AS (PARTITION BY source, level, pos // 16 ORDER BY pos)
), us AS (
  SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM u WHERE size > 1 WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)
), f(doc_id, source, leaf, level, pos, size, digest, proof) AS (
  SELECT doc_id, source, leaf, 0, pos, size, now, '' FROM l
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, f.level + 1, f.pos // 16, (f.size + 15) // 16, sha256(lft || f.digest || rgt), proof || lft || rgt
  FROM f JOIN ts ON f.source IS NOT DISTINCT FROM ts.source AND f.level = ts.level AND f.pos = ts.pos WHERE f.size > 1
), g(doc_id, leaf, subroot, level, pos, size, digest, proof) AS (
  SELECT f.doc_id, f.leaf, top.subroot, 0, top.pos, top.size, f.digest, f.proof FROM f JOIN top ON f.source IS NOT DISTINCT FROM top.source WHERE f.size = 1
  UNION ALL
  SELECT g.doc_id, g.leaf, g.subroot, g.level + 1, g.pos // 16, (g.size + 15) // 16, sha256(lft || g.digest || rgt), proof || lft || rgt
  FROM g JOIN us ON g.level = us.level AND g.pos = us.pos WHERE g.size > 1
)
SELECT g.doc_id, g.leaf, g.subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.digest AS folded_root, g.digest = r.digest AS verified
FROM g, (SELECT digest FROM u WHERE size = 1) r WHERE g.size = 1
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = [lowered if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS]
    tampered = F.when(remainder(5) == 0, merkle.leaf_digest(*columns))
    found = merkle.Manifest(table(spark, sf_dir, "documents"), changed=tampered).verify()
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.written(F.col("spans")).alias("spans"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
