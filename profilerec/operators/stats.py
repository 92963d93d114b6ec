"""Exact quantiles, order statistics and one-row statistics without collecting a column anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilerec.session import cut_lineage

BINS = 4096


def kth_values(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[int]]]) -> dict[tuple[str, int], tuple[float, int, int]]:
    """Values at 0-based ranks of the non-null values of several columns, with the counts below and equal to each.

    Counts per bin narrow the range of every rank until one value is left; all columns and ranks
    share a pass. A pass is a map-side combined count, and the driver sees at most ``BINS`` rows per
    rank, so a value shared by most rows is only a tall bin. NaN counts as missing, and infinities
    are the smallest and largest values. A rank beyond the values is an error.
    """
    flat = df.select(*[c.alias(f"v{i}") for i, (c, _) in enumerate(wanted.values())])
    kinds = dict(flat.dtypes)
    flat = cut_lineage(flat.select(*[F.nanvl(c, F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in flat.columns]))
    infinite = {i: kinds[f"v{i}"] in ("double", "float") for i in range(len(wanted))}

    def finite(i: int) -> Column:
        c = F.col(f"v{i}")
        return F.when(F.abs(c) < float("inf"), c) if infinite[i] else c

    counts = flat.agg(*[x for i in range(len(wanted)) for x in (
        F.min(finite(i)).alias(f"lo{i}"), F.max(finite(i)).alias(f"hi{i}"), F.count(finite(i)).alias(f"n{i}"), F.count(f"v{i}").alias(f"all{i}"),
        (F.count_if(F.col(f"v{i}") == float("-inf")) if infinite[i] else F.lit(0)).alias(f"under{i}"))]).first()
    found: dict[tuple[str, int], tuple[float, int, int]] = {}
    open_ranks: dict[tuple[str, int], list] = {}
    for i, (name, (_, ranks)) in enumerate(wanted.items()):
        under, n = counts[f"under{i}"], counts[f"n{i}"]
        for k in ranks:
            if not 0 <= k < counts[f"all{i}"]:
                raise ValueError(f"rank {k} of {name}: there are {counts[f'all{i}']} values")
            if k < under:
                found[name, k] = float("-inf"), 0, under
            elif k >= under + n:
                found[name, k] = float("inf"), under + n, counts[f"all{i}"] - under - n
            else:
                open_ranks[name, k] = [i, counts[f"lo{i}"], counts[f"hi{i}"], under, n]
    while open_ranks:
        for key, (_, low, high, below, n) in list(open_ranks.items()):
            if low == high:
                found[key] = low, below, n
                del open_ranks[key]
        ranges = list(dict.fromkeys((i, low, high) for i, low, high, _, _ in open_ranks.values()))
        if not ranges:
            break
        cells = []
        for number, (i, low, high) in enumerate(ranges):
            v = finite(i)
            width = high / BINS - low / BINS
            # Where a step is too small for a double, the two ends are told apart by themselves.
            step = F.least(F.floor((v / width) - F.lit(low / width)), F.lit(BINS - 1)) if infinite[i] and width > 0 else (
                F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.when(v == F.lit(low), 0).otherwise(1))
            cells.append(F.when((v >= F.lit(low)) & (v <= F.lit(high)), F.struct(
                F.lit(number).alias("range"), F.greatest(step.cast("bigint"), F.lit(0)).alias("bin"), v.cast("double" if infinite[i] else "bigint").cast("string").alias("v"))))
        kind = {number: float if infinite[i] else int for number, (i, _, _) in enumerate(ranges)}
        rows = flat.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        number_of = F.col("v").cast("double")
        bins = rows.groupBy("range", "bin").agg(F.count("*").alias("n"), F.min_by("v", number_of).alias("lo"), F.max_by("v", number_of).alias("hi")).collect()
        table: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r["range"], r["bin"])):
            table.setdefault(r["range"], []).append((r["n"], kind[r["range"]](r["lo"]), kind[r["range"]](r["hi"])))
        for (_, k), state in open_ranks.items():
            for n, lo, hi in table[ranges.index((state[0], state[1], state[2]))]:
                if state[3] + n > k:
                    state[1], state[2], state[4] = lo, hi, n
                    break
                state[3] += n
    return found


def kth_value(df: DataFrame, value: Column, k: int) -> tuple[float, int, int]:
    """One rank of one column: see :func:`kth_values`."""
    return kth_values(df, {"value": (value, [k])})["value", k]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, by :func:`kth_values` for tables of any size.

    Nulls and NaN are left out; a column without values gives nulls. Between an infinite and another
    value the infinite one is the result.
    """
    numeric = cut_lineage(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols]))
    counts = numeric.agg(*[F.count(c).alias(c) for c in cols]).first()
    places = {c: [(counts[c] - 1) * p for p in probs] for c in cols if counts[c]}
    wanted = {c: (F.col(c), sorted({f(x) for x in at for f in (math.floor, math.ceil)})) for c, at in places.items()}
    found = kth_values(numeric, wanted) if wanted else {}

    def between(c: str, position: float) -> float:
        lower, upper = found[c, math.floor(position)][0], found[c, math.ceil(position)][0]
        share = position - math.floor(position)
        if lower == upper or not share:
            return lower
        return lower + (upper - lower) * share if math.isfinite(lower) else (lower if math.isinf(lower) and math.isfinite(upper) else math.nan)

    return {c: [between(c, x) for x in places[c]] if c in places else [None] * len(probs) for c in cols}


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}


def describe(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("n"),
            F.round(F.avg(c), digits).alias("mean"),
            F.round(F.stddev_samp(c), digits).alias("std"),
            F.round(F.min(c).cast("double"), digits).alias("min"),
            *[
                F.round(F.lit(q).cast("double"), digits).alias(name)
                for name, q in zip(("q25", "q50", "q75"), quartiles[c])
            ],
            F.round(F.max(c).cast("double"), digits).alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def run_counters(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(user).alias("n_users"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
