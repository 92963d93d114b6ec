"""From the three source tables to clean and augmented ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.functions.ids import (
    UNKNOWN_PRODUCT, format_ts, normalize_product_id, normalize_user_id, parse_money, parse_timestamp, time_parts,
)
from profilerec.operators import augment, clean, ordering
from profilerec.sources.tables import (
    CUSTOMER_COLUMNS, CUSTOMER_LABELS, CUSTOMER_NUMBERS, INTERACTION_COLUMNS, PRODUCT_COLUMNS, PRODUCT_TEXTS,
)

DEFAULT_TS = "2024-01-01 00:00:00"


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def clean_customers(raw: DataFrame) -> DataFrame:
    """Renamed, imputed, distinct, clipped, encoded and scaled customers."""
    df = clean.rename_columns(clean.clean_headers(raw), CUSTOMER_COLUMNS)
    df = df.withColumn("user_id", normalize_user_id(F.col("user_id")))
    numbers, labels = _present(df, CUSTOMER_NUMBERS), _present(df, CUSTOMER_LABELS)
    df = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    df = clean.drop_duplicates(clean.impute_mode(clean.impute_median(df, numbers), labels))
    return clean.standard_scale(clean.label_encode(clean.clip_quantiles(df, numbers), labels), numbers)


def clean_products(raw: DataFrame) -> DataFrame:
    """Renamed, typed, filled and distinct products: missing quantities take the median, missing texts are empty.

    The price is money text in the source, so a missing one stays missing.
    """
    df = clean.rename_columns(clean.clean_headers(raw), PRODUCT_COLUMNS)
    df = df.withColumn("product_id", normalize_product_id(F.col("product_id")))
    money = _present(df, ("price", "quantity"))
    df = df.withColumns({c: parse_money(F.col(c)) for c in money})
    df = clean.impute_median(df, _present(df, ("quantity",)))
    return clean.drop_duplicates(df.fillna("", _present(df, PRODUCT_TEXTS)))


def clean_interactions(raw: DataFrame, order: str) -> DataFrame:
    """Filled, typed and distinct interactions; ``order`` is the unique numeric source row number."""
    df = clean.rename_columns(clean.clean_headers(raw), INTERACTION_COLUMNS)
    df = clean.normalize_interaction_ids(df).withColumns(
        {"user_id": F.nullif("user_id", F.lit("")), "ts": parse_timestamp(F.col("ts"))}
    )
    df = ordering.fill_ordered(df, ["user_id", "ts"], order)
    df = clean.impute_event_type(clean.impute_constant(df, {"product_id": UNKNOWN_PRODUCT}))
    df = df.withColumn("ts", F.coalesce("ts", F.lit(DEFAULT_TS).cast("timestamp_ntz")))
    same = [c for c in df.columns if c != order]
    df = df.groupBy(*same).agg(F.min(order).alias(order))
    df = clean.label_encode(df, ["event_type"])
    return df.withColumns({**time_parts(F.col("ts")), "timestamp": format_ts(F.col("ts"))})


def augment_all(
    customers: DataFrame, products: DataFrame, interactions: DataFrame, order: str, n_copies: int = 2, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with ``n_copies`` noisy copies of every row, numbered by copy_id."""
    labels = [r["value"] for r in clean.dictionary(interactions, {"event_type": F.col("event_type")}).orderBy("value").collect()]
    return (
        augment.augment_gaussian(customers, _present(customers, CUSTOMER_NUMBERS), ["user_id"], n_copies=n_copies, seed=seed),
        augment.augment_gaussian(products, _present(products, ("price", "quantity")), ["product_id"], n_copies=n_copies, seed=seed),
        augment.augment_interactions(interactions, labels, [order], n_copies, seed=seed),
    )
