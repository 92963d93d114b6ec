"""Scores of every left row against every right row, keeping only the best per left row.

Both sides are hashed into blocks of bounded size. Each pair of blocks is one task-local matrix
product, taken in chunks; only the best rows leave it, so neither the pairs nor a whole side meet in
one place. Every row is sent once per block of the other side, so blocks are as large as a task can
hold while there are enough pairs of them for all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.session import cut_lineage

#: Rows of a chunk, of which two meet in one matrix; chunks of a block, and bytes of its dense vectors.
BLOCK_ROWS, MOST_CHUNKS, BLOCK_BYTES = 2048, 32, 1 << 25
#: Pairs of blocks per shuffle partition.
PAIRS_PER_TASK = 2


def dense(vector: Column) -> Column:
    """Vector column of a dense array, as used by :func:`top_scores`."""
    return F.struct(F.lit(None).cast("array<int>").alias("idx"), vector.cast("array<double>").alias("val"))


def sparse(weights: DataFrame, key: str, index: str = "term_no", weight: str = "weight") -> DataFrame:
    """(key, vec): the non-zero entries of each row; bounded by the vocabulary."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(weight).alias("w"))))
    return weights.groupBy(key).agg(entries.alias("e")).select(
        key,
        F.struct(
            F.transform("e", lambda s: s["i"]).alias("idx"),
            F.transform("e", lambda s: s["w"]).cast("array<double>").alias("val"),
        ).alias("vec"),
    )


def to_matrix(idx: pd.Series, val: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(val), dims))
    for row, (i, v) in enumerate(zip(idx, val)):
        if v is None:
            continue
        if i is None:
            out[row, : len(v)] = v
        else:
            out[row, np.asarray(i, dtype=int)] = v
    return out


def block_count(df: DataFrame, block_rows: int) -> int:
    return max(1, math.ceil(df.count() / block_rows))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask of the k highest finite scores per row; equal scores go to the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.isfinite(scores)
    kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above = scores > kth
    tied = scores == kth
    room = k - above.sum(axis=1, keepdims=True)
    return (above | (tied & (np.cumsum(tied, axis=1) <= room))) & np.isfinite(scores)


def block_grid(n_left: int, n_right: int, block_rows: int, most_rows: int, pairs: int) -> tuple[int, int]:
    """Numbers of blocks of both sides: the fewest of at most ``most_rows`` rows that still give ``pairs`` pairs.

    The side whose cut repeats fewer rows of the other is cut first, and no block goes below ``block_rows`` rows.
    """
    left, right = (max(1, math.ceil(n / most_rows)) for n in (n_left, n_right))
    most_left, most_right = (max(1, math.ceil(n / block_rows)) for n in (n_left, n_right))
    while left * right < pairs and (left < most_left or right < most_right):
        if left < most_left and (right >= most_right or left * n_right <= right * n_left):
            left = min(2 * left, most_left)
        else:
            right = min(2 * right, most_right)
    return left, right


def stream_grid(n_left: int, n_right: int, most_left: int, most_right: int, block_rows: int, pairs: int, k: int) -> tuple[int, int]:
    """Numbers of blocks of both sides that send the fewest rows, where each block of the right gives ``k`` results per left row.

    Blocks have at most ``most_left`` and ``most_right`` rows, and there are ``pairs`` pairs unless blocks fall below ``block_rows`` rows.
    """
    least_left, least_right, top_left, top_right = (
        max(1, math.ceil(n / rows)) for n, rows in ((n_left, most_left), (n_right, most_right), (n_left, block_rows), (n_right, block_rows)))
    top_left, top_right = max(top_left, least_left), max(top_right, least_right)
    grids = {(min(top_left, max(least_left, math.ceil(pairs / right))), right) for right in range(least_right, max(least_right, min(top_right, pairs)) + 1)}
    enough = min(pairs, max(left * right for left, right in grids))
    # A result is about a fifth of a vector.
    return min((n_left * right * (1 + k / 5) + n_right * left, left, right) for left, right in grids if left * right >= enough)[1:]


def chunks(n: int, rows: int) -> list[tuple[int, int]]:
    """Bounds of equal chunks of about ``rows`` rows; hashing fills no block evenly, so up to half more are one chunk."""
    ends = np.linspace(0, n, max(1, round(n / rows)) + 1).astype(int).tolist()
    return list(zip(ends[:-1], ends[1:]))


def wanted_pairs(df: DataFrame) -> int:
    return PAIRS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, fn, schema: str,
                block_rows: int = BLOCK_ROWS, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Runs ``fn(left chunk, right chunk)`` once for every pair of chunks; every pair of rows meets in one of them.

    ``combine`` sums up the rows of a chunk of ``left`` against all chunks of a block of ``right`` before they leave the task.
    """
    n_left, n_right = block_grid(left.count(), right.count(), block_rows, block_rows * MOST_CHUNKS // 2, wanted_pairs(left))
    lb = F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int")
    rb = F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int")
    rows = left.withColumn("_lb", lb).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    columns = right.withColumn("_rb", rb).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return fn(a, b)
        out, there = [], chunks(len(b), block_rows)
        for low, high in chunks(len(a), block_rows):
            parts = [fn(a.iloc[low:high], b.iloc[start:end]) for start, end in there]
            part = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            out.append(part if combine is None or len(parts) == 1 else combine(part))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy("_lb", "_rb").cogroup(columns.groupBy("_lb", "_rb")).applyInPandas(run, schema)


def distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Euclidean distances of two series of equally long vectors."""
    return euclidean(np.vstack(a.to_numpy()).astype(float), np.vstack(b.to_numpy()).astype(float))


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of two matrices; for few columns by differences, which lose no digits."""
    if x.shape[1] <= 32:
        out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
        # A few rows at a time, whose differences stay in the cache.
        for low, high in chunks(len(x), 64):
            squared = out[low:high]
            gap = np.empty(squared.shape)
            for i in range(x.shape[1]):
                np.subtract(x[low:high, i, None], columns[i], out=gap)
                gap *= gap
                squared += gap
            np.sqrt(squared, out=squared)
        return out
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(squared, 0.0))


def merge_best(found: tuple, more: tuple, k: int, n: int) -> tuple[tuple, np.ndarray]:
    """(row, column, score, values) of the first ``k`` of every row by score, then column, and the k-th score, -inf where there is none."""
    row, column, score, values = (np.concatenate(x) for x in zip(found, more))
    order = np.lexsort((column, -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    order, row, place = order[place < k], row[place < k], place[place < k]
    kth = np.full(n, -np.inf)
    kth[row[place == k - 1]] = score[order][place == k - 1]
    return (row, column[order], score[order], values[order]), kth


def _best_cells(left: dict, right: dict, skip: tuple, rankings: Sequence[dict[str, float]], k: int,
                min_score: float | None, digits: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score per view) of the cells in the top ``k`` of any ranking, for one chunk of rows.

    Columns come in chunks. Once a row has ``k`` cells, only cells that may beat the k-th are rounded and merged.
    """
    names = list(left)
    n, n_columns = len(left[names[0]]), len(right[names[0]])
    nothing = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros((0, len(names))))
    best, kth = [nothing] * len(rankings), [np.full(n, -np.inf)] * len(rankings)
    for low, high in chunks(n_columns, chunk):
        parts = {v: left[v] @ right[v][low:high].T for v in names}
        here = (skip[1] >= low) & (skip[1] < high)
        blocked = skip[0][here], skip[1][here] - low
        for i, ranking in enumerate(rankings):
            def rounded(cells):
                return np.round(sum(w * np.round(parts[v][cells], digits) for v, w in ranking.items()), digits)

            if np.isfinite(kth[i]).all():
                ((view, w), *others) = ranking.items()
                total = parts[view] if w == 1.0 and not others else sum(w * parts[v] for v, w in ranking.items())
                slack = (1 + sum(abs(w) for w in ranking.values())) * 10.0**-digits + 1e-12 * np.abs(kth[i])
                beats = total > (kth[i] - slack)[:, None]
                beats[blocked] = False
                r, c = np.divmod(np.flatnonzero(beats), beats.shape[1])
                score = rounded((r, c))
                above = (score > kth[i][r]) & np.isfinite(score)
                r, c, score = r[above], c[above], score[above]
            else:
                total = rounded(...)
                total[blocked] = -np.inf
                if min_score is not None:
                    total[total <= min_score] = -np.inf
                total[total <= kth[i][:, None]] = -np.inf
                r, c = np.nonzero(_best(total, k))
                score = total[r, c]
            if len(r):
                values = np.round(np.column_stack([parts[v][r, c] for v in names]), digits)
                best[i], kth[i] = merge_best(best[i], (r, c + low, score, values), k, n)
    row, column, values = (np.concatenate([b[j] for b in best]) for j in (0, 1, 3))
    _, one = np.unique(row * n_columns + column, return_index=True)
    return row[one], column[one], values[one]


def top_scores(
    left: DataFrame,
    right: DataFrame,
    views: dict[str, int],
    rankings: Sequence[dict[str, float]],
    k: int,
    left_id: str = "user_id",
    right_id: str = "product_id",
    seen: DataFrame | None = None,
    min_score: float | None = None,
    block_rows: int = BLOCK_ROWS,
    digits: int = 9,
) -> DataFrame:
    """(left_id, right_id, one score per view, best_rank): rows in the top ``k`` of any ranking.

    ``left`` and ``right`` have an id and one vector struct per view (:func:`dense` or
    :func:`sparse`); ``views`` maps a view to its dimension. The score of a view is the dot
    product. A ranking is a weighted sum of views; ties go to the smaller right id. Pairs in
    ``seen`` are left out, and with ``min_score`` only scores above it count.
    """
    names = list(views)
    # Counted and then used twice, so the vectors are written once.
    left, right = cut_lineage(left.select(left_id, *names)), cut_lineage(right.select(right_id, *names))
    rows_of = lambda held: block_rows * max(1, held // (8 * sum(views.values())) // block_rows)
    most_left = min(rows_of(BLOCK_BYTES), block_rows * MOST_CHUNKS)
    # Blocks of the right are larger: each gives ``k`` rows per left row.
    most_right = min(rows_of(2 * BLOCK_BYTES), 4 * block_rows * MOST_CHUNKS)
    n_left, n_right = stream_grid(left.count(), right.count(), most_left, most_right, block_rows, wanted_pairs(left), k * len(rankings))
    left_block = F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int")
    right_block = F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int")
    flat = [c for v in names for c in (F.col(v)["idx"].alias(f"{v}_idx"), F.col(v)["val"].alias(f"{v}_val"))]
    rows = left.select(
        F.col(left_id).alias("lid"), F.lit(None).cast("string").alias("skip"), *flat, left_block.alias("lb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("rb"),
    )
    if seen is not None:
        empty = [
            c for v in names
            for c in (F.lit(None).cast("array<int>").alias(f"{v}_idx"), F.lit(None).cast("array<double>").alias(f"{v}_val"))
        ]
        known = seen.select(left_id, right_id).distinct()
        rows = rows.unionByName(known.select(
            F.col(left_id).alias("lid"), F.col(right_id).alias("skip"), *empty,
            left_block.alias("lb"), right_block.alias("rb"),
        ))
    columns = right.select(
        F.col(right_id).alias("rid"), *flat, right_block.alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("lb"),
    )
    out_cols = ["lid", "rid", *names]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        skips = a[a["skip"].notna()]
        a = a[a["skip"].isna()].reset_index(drop=True)
        b = b.sort_values("rid").reset_index(drop=True)
        if not len(a) or not len(b):
            return pd.DataFrame(columns=out_cols)
        r = pd.Index(a["lid"]).get_indexer(skips["lid"]) if len(skips) else np.zeros(0, int)
        c = pd.Index(b["rid"]).get_indexer(skips["skip"]) if len(skips) else np.zeros(0, int)
        r, c = r[(r >= 0) & (c >= 0)], c[(r >= 0) & (c >= 0)]
        lid, rid, out = a["lid"].to_numpy(), b["rid"].to_numpy(), []
        items = {v: to_matrix(b[f"{v}_idx"], b[f"{v}_val"], views[v]) for v in names}
        # A few rows at a time, so that the scores of a chunk stay near the processor.
        for low, high in chunks(len(a), max(1, block_rows // 16)):
            chunk = a.iloc[low:high]
            people = {v: to_matrix(chunk[f"{v}_idx"], chunk[f"{v}_val"], views[v]) for v in names}
            mine = (r >= low) & (r < high)
            row, column, values = _best_cells(
                people, items, (r[mine] - low, c[mine]), rankings, k, min_score, digits, block_rows)
            out.append(pd.DataFrame({
                "lid": lid[row + low], "rid": rid[column], **{v: values[:, j] for j, v in enumerate(names)}}))
        return pd.concat(out, ignore_index=True)

    schema = ", ".join(["lid string", "rid string", *[f"{v} double" for v in names]])
    found = rows.groupBy("lb", "rb").cogroup(columns.groupBy("lb", "rb")).applyInPandas(score, schema)
    ranks = []
    for i, ranking in enumerate(rankings):
        total = F.round(sum(F.col(v) * w for v, w in ranking.items()), digits)
        rank = F.row_number().over(W.partitionBy("lid").orderBy(total.desc(), "rid"))
        if min_score is not None:
            rank = F.when(total > min_score, rank)
        found = found.withColumn(f"_rank{i}", rank)
        ranks.append(F.col(f"_rank{i}"))
    best = ranks[0] if len(ranks) == 1 else F.least(*ranks)
    return found.withColumn("best_rank", best).where(F.col("best_rank") <= k).select(
        F.col("lid").alias(left_id), F.col("rid").alias(right_id), *names, "best_rank"
    )
