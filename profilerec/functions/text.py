"""Tokens, keyword lists and templates as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " [SEP] "
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
TERM_PATTERN = r"[a-zA-Z][a-zA-Z0-9+\-]{2,}"

# Words never used as a keyword.
KEYWORD_STOPWORDS = (
    "and", "for", "with", "from", "this", "that", "into", "your", "their", "have", "been", "more", "less", "very", "also", "about",
    "product", "products", "category", "categories", "item", "items", "shopper", "customer", "users", "user",
)

# Common English words left out of term weights unless the caller passes another list.
ENGLISH_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def words(c: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def _literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def combined_text(columns: Sequence[Column]) -> Column:
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def normalize_keywords(values: Column, limit: int = 5) -> Column:
    """Cleaned, de-duplicated keywords in first-seen order."""
    def clean(value: Column) -> Column:
        token = F.regexp_replace(F.lower(value), "#", "")
        token = F.regexp_replace(token, r"[^a-z0-9+\- ]", " ")
        return F.trim(F.regexp_replace(token, r"\s+", " "))

    stop = _literal_array(KEYWORD_STOPWORDS)
    kept = F.filter(
        F.transform(values, clean),
        lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def top_terms(texts: Column, limit: int = 5) -> Column:
    """Most frequent terms of a short list of texts, ties by first position."""
    stop = _literal_array(KEYWORD_STOPWORDS)
    terms = F.flatten(
        F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit(TERM_PATTERN), F.lit(0)))
    )
    terms = F.filter(terms, lambda t: ~F.array_contains(stop, t))
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(terms),
            lambda t: F.struct(
                (-F.size(F.filter(terms, lambda x: x == t))).alias("neg_count"),
                F.array_position(terms, t).alias("first_at"),
                t.alias("term"),
            ),
        )
    )
    most_common = F.slice(F.transform(ranked, lambda s: s["term"]), 1, limit * 3)
    return normalize_keywords(most_common, limit)


def split_tokens(c: Column, drop_hash: bool = False) -> Column:
    """Set of blank-separated tokens; commas (and hashes) act as blanks."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[,#]" if drop_hash else ",", " ")
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def keyword_overlap(interest: Column, tags: Column, keywords: Column) -> Column:
    product_text = F.concat(F.coalesce(tags, F.lit("")), F.lit(" "), F.coalesce(keywords, F.lit("")))
    return F.size(F.array_intersect(split_tokens(interest, drop_hash=True), split_tokens(product_text)))


def merge_dedupe_ordered(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def json_block(text: Column, opening: str = "{") -> Column:
    """Widest ``{..}`` or ``[..]`` block of noisy text, null when it is not valid JSON."""
    pattern = r"(?s)(\{.*\})" if opening == "{" else r"(?s)(\[.*\])"
    block = F.regexp_extract(text, pattern, 1)
    return F.when((block != "") & F.try_parse_json(block).isNotNull(), block)
