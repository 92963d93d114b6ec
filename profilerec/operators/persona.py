"""Persona sentences, cluster tags and the enrichment cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilerec.functions.rules import purchase_motive
from profilerec.functions.text import SEPARATOR, normalize_keywords, top_terms
from profilerec.session import cut_lineage
from profilerec.sources.enrichment import EnrichmentStore

# Sentence formats and the texts used when nothing is known.
PERSONA_FORMAT = (
    "%s %s customer in the %s segment who gravitates toward %s and is currently in %s stage."
)
DEFAULT_FOCUS = "broad catalog exploration"
DEFAULT_KEYWORDS = "#general"
DEFAULT_PERSONA = "Insufficient interaction data."
DEFAULT_TAGS = "misc"

PERSONA_COLUMNS = ("persona", "interest_keywords", "purchase_motive")
CACHE_SCHEMA = "cache_key string, persona string, interest_keywords string, purchase_motive string"
_ITEMS = "array<struct<rank:int,name:string,category:string>>"


def _text_or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def persona_text(df: DataFrame, journey: str | None = None) -> DataFrame:
    """Adds persona, interest_keywords and purchase_motive.

    Needs age_group, gender, behavior_cluster_label and ``items``, the short item list of a user.
    """
    age = _text_or(F.col("age_group"), "unknown")
    gender = _text_or(F.col("gender"), "Unknown")
    segment = _text_or(F.col("behavior_cluster_label"), "Regular")
    stage = _text_or(F.col(journey), "Unknown") if journey else F.lit("Unknown")
    items = F.coalesce(F.col("items"), F.array().cast(_ITEMS))

    def texts(field: str) -> Column:
        return F.filter(F.transform(items, lambda s: s[field]), lambda t: t != "")

    df = df.withColumn(
        "_terms",
        normalize_keywords(F.concat(top_terms(texts("category"), 3), top_terms(texts("name"), 3)), 4),
    )
    terms = F.col("_terms")
    focus = F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 2), ", ")).otherwise(DEFAULT_FOCUS)
    tags = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("")))), ", ")
    return df.withColumns(
        {
            "persona": F.format_string(
                PERSONA_FORMAT, age, F.lower(gender), F.lower(segment), focus, F.lower(stage)
            ),
            "interest_keywords": F.when(F.size(terms) > 0, tags).otherwise(DEFAULT_KEYWORDS),
            "purchase_motive": purchase_motive(segment),
        }
    ).drop("_terms")


def cluster_tags(clusters: DataFrame) -> DataFrame:
    """Adds attribute_tags and cluster_summary from ``keywords`` or else ``sample_names``."""
    keywords = normalize_keywords(F.coalesce("keywords", F.array().cast("array<string>")), 7)
    names = F.filter(F.transform("sample_names", lambda n: F.trim(n)), lambda n: n != "")
    names = F.coalesce(names, F.array().cast("array<string>"))
    tags = F.when(F.size(keywords) > 0, F.slice(keywords, 1, 5)).otherwise(top_terms(F.slice(names, 1, 8), 4))
    df = clusters.withColumn("_tags", tags)
    some = F.size("_tags") > 0
    cluster = F.col("major_cluster").cast("string")
    return df.withColumns(
        {
            "attribute_tags": F.when(some, F.array_join("_tags", ", ")).otherwise(DEFAULT_TAGS),
            "cluster_summary": F.when(
                some,
                F.format_string(
                    "Cluster %s groups products centered on %s.", cluster,
                    F.array_join(F.slice("_tags", 1, 3), ", "),
                ),
            ).otherwise(F.format_string("Cluster %s groups mixed long-tail catalog items.", cluster)),
        }
    ).drop("_tags")


def cache_key(kind: str, payload: Sequence[str]) -> Column:
    """sha256 of the canonical JSON of a request; payload columns in name order."""
    body = F.struct(*[F.col(c) for c in sorted(payload)])
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), body.alias("payload"))), 256)


def split_cached(records: DataFrame, cache: DataFrame, kind: str, payload: Sequence[str]) -> DataFrame:
    """Adds ``cache_key`` and ``is_hit``."""
    keyed = records.withColumn("cache_key", cache_key(kind, payload))
    known = cache.select("cache_key", F.lit(True).alias("_known")).distinct()
    return keyed.join(known, "cache_key", "left").withColumn("is_hit", F.coalesce("_known", F.lit(False))).drop("_known")


def enrich_batched(
    records: DataFrame, key: str, fields: Sequence[str], values: Sequence[str],
    fn: Callable[[list[dict]], dict[str, dict]], batch_size: int = 20,
) -> DataFrame:
    """Calls ``fn`` on lists of up to ``batch_size`` records and returns (key, *values, error).

    ``fn`` maps a list of records to {key: {value column: text}}. Where it fails on a list or leaves
    records out, these are asked again one by one. A record that fails then has null values and the
    reason in ``error``; the caller's template applies.
    """
    out_fields = ", ".join([f"{key} string", *[f"{v} string" for v in values], "error string"])

    def ask(rows: list[dict]) -> tuple[dict, str | None]:
        try:
            return fn(rows) or {}, None
        except Exception as reason:  # a caller's model may raise anything; the reason is reported per record
            return {}, f"{type(reason).__name__}: {reason}"

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                rows = pdf.iloc[start:start + batch_size].to_dict("records")
                answers, reason = ask(rows)
                errors = {}
                for r in rows:
                    if r[key] not in answers and len(rows) > 1:
                        alone, reason = ask([r])
                        answers.update({k: v for k, v in alone.items() if k == r[key]})
                    if r[key] not in answers:
                        errors[r[key]] = reason or "no answer"
                yield pd.DataFrame(
                    [{key: r[key], **{v: (answers.get(r[key]) or {}).get(v) for v in values}, "error": errors.get(r[key])} for r in rows],
                    columns=[key, *values, "error"],
                )

    return records.select(key, *fields).mapInPandas(run, out_fields)


def personas_with_cache(
    records: DataFrame, cache: DataFrame | EnrichmentStore, fn: Callable | None = None, batch_size: int = 20,
    kind: str = "customer_persona",
) -> tuple[DataFrame, DataFrame]:
    """Personas for all records, and (cache_key, values, error) of those that were not in the cache.

    A request is answered by the cache, else by ``fn``, else by the template. Equal requests are
    computed once, and the answers of ``fn`` are written before anything reads them, so it runs once
    per request. A :class:`EnrichmentStore` gets them as a batch; failed requests are not stored and
    will be asked again.
    """
    payload = ["age_group", "gender", "behavior_cluster_label", "items"]
    store = cache if isinstance(cache, EnrichmentStore) else None
    known = store.rows() if store else cache
    keyed = records.withColumn("cache_key", cache_key(kind, payload))
    misses = keyed.select("cache_key", *payload).join(
        known.select("cache_key"), "cache_key", "left_anti"
    ).dropDuplicates(["cache_key"])
    fresh = persona_text(misses).select("cache_key", *PERSONA_COLUMNS).withColumn("error", F.lit(None).cast("string"))
    if fn is not None:
        answers = cut_lineage(enrich_batched(misses, "cache_key", payload, PERSONA_COLUMNS, fn, batch_size))
        fresh = fresh.drop("error").join(answers.withColumnsRenamed({c: f"_{c}" for c in PERSONA_COLUMNS}), "cache_key").select(
            "cache_key", *[F.coalesce(f"_{c}", c).alias(c) for c in PERSONA_COLUMNS], "error")
    fresh = cut_lineage(fresh)
    if store:
        store.append(fresh.where("error is null"))
    answered = known.select("cache_key", *PERSONA_COLUMNS).unionByName(fresh.drop("error"))
    return keyed.join(answered, "cache_key", "left"), fresh


def failure_count(fresh: DataFrame) -> DataFrame:
    """One row: requests that were not in the cache, and how many of them failed."""
    return fresh.agg(F.count("*").alias("n_requests"), F.count("error").alias("n_failed"))


def user_profile_text(profiles: DataFrame, stages: DataFrame) -> DataFrame:
    """(user_id, user_text): persona, keywords, motive, categories and stage as one text."""
    parts = [F.coalesce(c, F.lit("")) for c in (*PERSONA_COLUMNS, "major_purchase_categories")]
    stage = F.coalesce("current_journey_stage", F.lit("Unknown"))
    return profiles.join(stages.select("user_id", "current_journey_stage"), "user_id", "left").select(
        "user_id", F.concat_ws(SEPARATOR, *parts, stage).alias("user_text")
    )
