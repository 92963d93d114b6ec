"""Headers, imputation, clipping, encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilerec.functions.ids import UNKNOWN_PRODUCT, canonical_event_type, normalize_product_id, normalize_user_id
from profilerec.functions.rules import tercile
from profilerec.operators.ordering import free_names, global_row_index
from profilerec.operators.skew import join_hot
from profilerec.operators.stats import exact_quantiles, medians
from profilerec.session import cut_lineage


def clean_headers(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f"`{c}`").alias(c.strip()) for c in df.columns if "Unnamed" not in c]
    )


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def normalize_interaction_ids(df: DataFrame) -> DataFrame:
    rules = {"user_id": normalize_user_id, "product_id": normalize_product_id}
    return df.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns})


def valid_interactions(df: DataFrame) -> DataFrame:
    return df.where(
        F.col("ts").isNotNull()
        & (F.col("user_id") != "")
        & (F.col("product_id") != "")
        & (F.col("product_id") != UNKNOWN_PRODUCT)
    )


def filter_event_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    return df.where(F.col("event_type").isin(*types))


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    middle = medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c])) for c in cols})


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text per column, ties to the smallest, by one combined count."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]))
        .alias("p")
    ).select("p.name", "p.value")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("name", "value").count()
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))
    found = {r["name"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    found = modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c] or default)) for c in cols})


def impute_constant(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Null and empty text both become the constant."""
    return df.withColumns(
        {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in values.items()}
    )


def impute_event_type(df: DataFrame, col: str = "event_type") -> DataFrame:
    filled = impute_mode(df, [col], default="view")
    return filled.withColumn(col, canonical_event_type(F.col(col)))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def clip_quantiles(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Winsorises the numeric columns whose name does not contain ``id``."""
    chosen = [c for c in cols if "id" not in c.lower()]
    bounds = exact_quantiles(df, chosen, [low, high])
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi) in bounds.items()
        }
    )


#: A dictionary of at most so many values becomes an expression, and a larger one of at most so many a broadcast table.
MAP_VALUES = 256
BROADCAST_VALUES = 100_000


def dictionary(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, value): the distinct values of all ``columns`` from one pass, without nulls."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in columns.items()])
    return df.select(F.explode(entries).alias("e")).select("e.*").where("value IS NOT NULL").distinct()


def with_codes(df: DataFrame, values: DataFrame, columns: dict[str, tuple[Column, str]], default: int | None = None) -> DataFrame:
    """Adds alphabetical codes from 0: ``columns`` maps a name in ``values`` to (column of ``df``, name of the code).

    A value without a code gets ``default``. Small dictionaries are looked up in place; one that is
    too large to broadcast is joined with its frequent values salted.
    """
    values = cut_lineage(values)
    sizes = {r["name"]: r["count"] for r in values.groupBy("name").count().collect()}
    small = [n for n in columns if sizes.get(n, 0) <= MAP_VALUES]
    # At most MAP_VALUES rows a column.
    listed: dict[str, list[str]] = {n: [] for n in small}
    for r in values.where(F.col("name").isin(small)).orderBy("name", "value").collect():
        listed[r["name"]].append(r["value"])
    looked_up = {}
    for n in small:
        value, code = columns[n]
        pairs = [F.lit(x) for i, v in enumerate(listed[n]) for x in (v, i)]
        found = F.create_map(*pairs)[value.cast("string")] if pairs else F.lit(None)
        looked_up[code] = F.coalesce(found, F.lit(default)).cast("int")
    df = df.withColumns(looked_up) if looked_up else df
    for n, (value, code) in columns.items():
        if n in listed:
            continue
        key, number = free_names(df.columns, "value", "code")
        codes = global_row_index(values.where(F.col("name") == n).select(F.col("value").alias(key)), [key], number)
        rows = df.withColumn(key, value.cast("string"))
        if sizes[n] <= BROADCAST_VALUES:
            joined = rows.join(F.broadcast(codes), key, "left")
        else:
            weights = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
            unknown = weights.join(codes, key, "left_anti").select(key, F.lit(None).cast("bigint").alias(number))
            joined = join_hot(rows.where(F.col(key).isNotNull()), codes.unionByName(unknown), key, weights, "n", df.columns)
            joined = joined.unionByName(rows.where(F.col(key).isNull()).withColumn(number, F.lit(None).cast("bigint")))
        df = joined.withColumn(code, F.coalesce(number, F.lit(default)).cast("int")).drop(key, number)
    return df


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_encoded`` for every column: alphabetical codes from 0; null stays null."""
    return with_codes(df, dictionary(df, {c: F.col(c) for c in cols}), {c: (F.col(c), f"{c}_encoded") for c in cols})


def _or_unknown(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("unknown"))


def factorize(df: DataFrame, col: str, source: DataFrame | None = None) -> DataFrame:
    """Adds ``<col>_encoded``: codes learned from ``source``; null is ``unknown``, unseen is 0."""
    return factorize_all(df, {col: f"{col}_encoded"}, [(df if source is None else source, [col])])


def factorize_all(df: DataFrame, codes: dict[str, str], sources: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """:func:`factorize` of many columns (column: name of its code) with one pass over each source table."""
    values = None
    for source, cols in sources:
        found = dictionary(source, {c: _or_unknown(c) for c in cols})
        values = found if values is None else values.unionByName(found)
    return with_codes(df, values, {c: (_or_unknown(c), code) for c, code in codes.items()}, 0)


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_scaled``: z-score by the population deviation; constant columns give 0."""
    stats = df.agg(
        F.struct(*[s for c in cols for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    ).scalar()
    return df.withColumns(
        {
            f"{c}_scaled": (F.col(c) - stats[f"m_{c}"])
            / F.when(stats[f"s_{c}"] == 0, F.lit(1.0)).otherwise(stats[f"s_{c}"])
            for c in cols
        }
    )


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_scaled`` in [0, 1]; a zero range gives 0."""
    stats = df.agg(
        F.struct(*[s for c in cols for s in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    ).scalar()
    return df.withColumns(
        {
            f"{c}_scaled": F.when(stats[f"hi_{c}"] > stats[f"lo_{c}"],
                                  (F.col(c) - stats[f"lo_{c}"]) / (stats[f"hi_{c}"] - stats[f"lo_{c}"]))
            .otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))
            for c in cols
        }
    )


def tercile_bucket(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds ``out``: equal-frequency low / mid / high after filling nulls with the median."""
    middle = medians(df, [col])[col]
    filled = F.coalesce(F.col(col).cast("double"), F.lit(0.0 if middle is None else middle))
    edges = exact_quantiles(df.select(filled.alias("v")), ["v"], [0.0, 1 / 3, 2 / 3, 1.0])["v"]
    return df.withColumn(out, tercile(filled, [F.lit(e).cast("double") for e in edges]))
