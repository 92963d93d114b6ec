"""Ratings, popularity, neighbourhood and factor models."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.functions.rules import implicit_rating
from profilerec.operators.blocks import block_count, dense, top_scores
from profilerec.operators.clean import valid_interactions
from profilerec.operators.ordering import global_row_index, head_per_group
from profilerec.operators.skew import join_hot
from profilerec.session import cut_lineage

CONSTANT_SCORE = 2.5
#: Ratings of one block of users, and similarities of one block of items.
RATED_ROWS, SIM_ROWS = 1 << 18, 1 << 19
#: Ratings of one tile of the matrix that is factored, and items of one block of its vectors.
TILE_ROWS, FACTOR_ROWS = 1 << 16, 1 << 12


def ratings(interactions: DataFrame) -> DataFrame:
    """(user_id, product_id, rating): strongest signal per pair."""
    return (
        valid_interactions(interactions)
        .groupBy("user_id", "product_id")
        .agg(F.max(implicit_rating(F.col("event_type"))).alias("rating"))
    )


def popularity(interactions: DataFrame, purchases_only: bool = True) -> DataFrame:
    """(product_id, popularity): share of the purchases, or of all events when there are none."""
    weight = F.count_if(F.col("event_type") == "purchase") if purchases_only else F.count("*")
    counts = interactions.groupBy("product_id").agg(weight.alias("bought"), F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("bought").alias("bought"), F.sum("n").alias("n"))).scalar()
    share = F.when(totals["bought"] > 0, F.col("bought") / totals["bought"]).otherwise(F.col("n") / totals["n"])
    return counts.select("product_id", share.alias("popularity")).where("popularity > 0")


def popular_rank(interactions: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(product_id, n, pop_rank): products by event count, ties by id; limited to the catalog if given."""
    counts = interactions.groupBy("product_id").agg(F.count("*").alias("n"))
    if catalog is not None:
        counts = counts.join(catalog.select("product_id"), "product_id", "left_semi")
    ranked = global_row_index(counts, [F.desc("n"), "product_id"], "pop_rank")
    return ranked.withColumn("pop_rank", F.col("pop_rank") + 1)


def seen_pairs(interactions: DataFrame, mode: str = "purchase") -> DataFrame | None:
    """Pairs to leave out: all seen items, purchased items only, or none."""
    if mode == "none":
        return None
    rows = interactions if mode == "all" else interactions.where(F.col("event_type") == mode)
    return rows.select("user_id", "product_id").distinct()


def exclude_seen(scored: DataFrame, seen: DataFrame | None) -> DataFrame:
    return scored if seen is None else scored.join(seen, ["user_id", "product_id"], "left_anti")


def label_pairs(pairs: DataFrame, interactions: DataFrame, label: str = "is_relevant") -> DataFrame:
    """Adds 1 where the pair occurs in the log, else 0."""
    known = interactions.select("user_id", "product_id").distinct().withColumn("_known", F.lit(1))
    return pairs.join(known, ["user_id", "product_id"], "left").withColumn(
        label, F.coalesce("_known", F.lit(0))
    ).drop("_known")


def topk_per_user(scored: DataFrame, k: int, score: str = "score", digits: int = 9) -> DataFrame:
    return head_per_group(scored, ["user_id"], [F.round(score, digits).desc(), "product_id"], k)


def recommend_popular(users: DataFrame, ranked: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(user_id, product_id, rank): the most popular items a user has not seen.

    A user who has seen j of the items at the top needs the first k + j of them, so each user is
    paired with that many ranks and no more: j counts the user's seen items that are in the list.
    """
    users = users.select("user_id").distinct()
    if seen is None:
        need = users.withColumn("need", F.lit(k))
    else:
        listed = seen.join(ranked.select("product_id"), "product_id", "left_semi")
        counts = listed.groupBy("user_id").agg(F.count("*").cast("int").alias("_n"))
        need = users.join(counts, "user_id", "left").select(
            "user_id", (F.coalesce("_n", F.lit(0)) + k).alias("need")
        )
    slots = need.select("user_id", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("pop_rank"))
    # Every user asks for the first ranks, so those are hot keys.
    asked = slots.groupBy("pop_rank").agg(F.count("*").alias("n"))
    listed_items = join_hot(slots, ranked.select("product_id", "pop_rank"), "pop_rank", asked, "n", ["user_id"])
    open_items = exclude_seen(listed_items, seen)
    return head_per_group(open_items, ["user_id"], ["pop_rank"], k).select("user_id", "product_id", "rank")


def item_similarity(pairs: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(product_a, product_b, sim): cosine of the item rating columns, both directions.

    The rating matrix is cut into blocks of users and items, whose products are summed: a very
    active user costs a share of a matrix, and no pair rows leave a task before they are summed.
    """
    lengths = pairs.groupBy("product_id").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("length"))
    dots = _block_dots(pairs, block_rows).groupBy("product_a", "product_b").agg(F.sum("dot").alias("dot"))
    both = dots.unionByName(dots.select(
        F.col("product_b").alias("product_a"), F.col("product_a").alias("product_b"), "dot"
    ))
    return (
        both.join(lengths.select(F.col("product_id").alias("product_a"), F.col("length").alias("_a")), "product_a")
        .join(lengths.select(F.col("product_id").alias("product_b"), F.col("length").alias("_b")), "product_b")
        .select("product_a", "product_b", (F.col("dot") / (F.col("_a") * F.col("_b"))).alias("sim"))
    )


def _slices(codes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the runs of 0, 1, ..., n - 1 in sorted ``codes``."""
    return np.searchsorted(codes, np.arange(n + 1))


def _block_dots(pairs: DataFrame, block_rows: int) -> DataFrame:
    """Item dot products summed over blocks of users; one task holds two item blocks of one user block.

    A user block has about ``RATED_ROWS`` ratings, so equal pairs of items seldom leave more than one task.
    """
    n_users = block_count(pairs, RATED_ROWS)
    n_items = block_count(pairs.select("product_id").distinct(), block_rows)
    item_block = F.pmod(F.xxhash64("product_id"), F.lit(n_items)).cast("int")
    others = F.sequence(F.lit(0), F.lit(n_items - 1))
    tiled = pairs.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(n_users)).cast("int")).withColumn(
        "mine", item_block
    ).withColumn("other", F.explode(others)).select(
        "user_id", "product_id", "rating", "ub", "mine",
        F.least("mine", "other").alias("ba"), F.greatest("mine", "other").alias("bb"),
    )

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _ub, ba, bb = key
        none = pd.DataFrame(columns=["product_a", "product_b", "dot"])
        u, users = pd.factorize(pdf["user_id"].to_numpy(object))
        order = np.argsort(u, kind="stable")
        u, rating, mine = u[order], pdf["rating"].to_numpy(float)[order], pdf["mine"].to_numpy()[order]
        product = pdf["product_id"].to_numpy(dtype=object)[order]
        code, names = np.zeros(len(u), np.int64), {}
        for block in {int(ba), int(bb)}:
            code[mine == block], names[block] = pd.factorize(product[mine == block], sort=True)
        if int(ba) not in names or int(bb) not in names or not len(names[ba]) or not len(names[bb]):
            return none
        dots = np.zeros((len(names[ba]), len(names[bb])))
        ends = _slices(u, len(users))
        for low, high in zip(ends[:-1], ends[1:]):
            c, r = code[low:high], rating[low:high]
            if ba != bb:
                left = mine[low:high] == ba
                dots[np.ix_(c[left], c[~left])] += np.outer(r[left], r[~left])
            else:
                dots[np.ix_(c, c)] += np.outer(r, r)
        a, b = np.nonzero(np.triu(dots, 1) if ba == bb else dots)
        return pd.DataFrame({"product_a": names[ba][a], "product_b": names[bb][b], "dot": dots[a, b]}) if len(a) else none

    return tiled.groupBy("ub", "ba", "bb").applyInPandas(
        multiply, "product_a string, product_b string, dot double"
    )


def ibcf_scores(
    pairs: DataFrame, item_limit: int | None = None, neighbours: int | None = None
) -> DataFrame:
    """(user_id, product_id, score): sum of similarity times rating over the user's rated items.

    ``item_limit`` keeps the first items in text order, as an option; ``neighbours`` keeps the most
    similar items of each item, as an option.
    """
    if item_limit is not None:
        first = pairs.select("product_id").distinct().orderBy("product_id").limit(item_limit)
        pairs = pairs.join(first, "product_id", "left_semi")
    # Each read several times below.
    pairs = cut_lineage(pairs.select("user_id", "product_id", "rating"))
    sims = item_similarity(pairs)
    if neighbours is not None:
        sims = head_per_group(sims, ["product_a"], [F.desc("sim"), "product_b"], neighbours).drop("rank")
    return _block_scores(pairs, cut_lineage(sims))


def _block_scores(pairs: DataFrame, sims: DataFrame) -> DataFrame:
    """Ratings times similarities for unrated items; one task holds all ratings of a block of users and a block of similarities.

    The terms of a score meet in one task and are summed there, so a score is one row, whatever its number of terms.
    """
    n_users, n_items = block_count(pairs, RATED_ROWS), block_count(sims, SIM_ROWS)
    rated = pairs.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(n_users)).cast("int")).withColumn(
        "ib", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    near = sims.withColumn("ib", F.pmod(F.xxhash64("product_b"), F.lit(n_items)).cast("int")).withColumn(
        "ub", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1))))
    kind = pairs.schema["user_id"].dataType.simpleString()

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["user_id", "product_id", "score"])
        if not len(a) or not len(b):
            return none
        u, users = pd.factorize(a["user_id"].to_numpy(object))
        order = np.argsort(u, kind="stable")
        u, rating = u[order], a["rating"].to_numpy(float)[order]
        items, names = pd.factorize(np.concatenate([a["product_id"].to_numpy(object), b["product_a"].to_numpy(object)]))
        item, of = items[: len(a)][order], items[len(a) :]
        to, targets = pd.factorize(b["product_b"].to_numpy(object))
        # Rows of the similarity matrix one after another, and the column of every item, -1 for none.
        by_item = np.argsort(of, kind="stable")
        to, sim, start = to[by_item], b["sim"].to_numpy()[by_item], _slices(of[by_item], len(names))
        column = pd.Index(targets).get_indexer(names)
        ends, out = _slices(u, len(users)), []
        for low, high in zip(ends[:-1], ends[1:]):
            mine = item[low:high]
            n = start[mine + 1] - start[mine]
            at = np.arange(n.sum()) + np.repeat(start[mine] - np.cumsum(n) + n, n)
            total = np.bincount(to[at], sim[at] * np.repeat(rating[low:high], n), len(targets))
            hit = np.zeros(len(targets), bool)
            hit[to[at]] = True
            own = column[mine]
            hit[own[own >= 0]] = False
            found = np.flatnonzero(hit)
            out.append((found, total[found]))
        if not any(len(found) for found, _ in out):
            return none
        return pd.DataFrame({
            "user_id": np.repeat(users, [len(f) for f, _ in out]), "product_id": targets[np.concatenate([f for f, _ in out])],
            "score": np.concatenate([s for _, s in out]),
        })

    return rated.groupBy("ub", "ib").cogroup(near.groupBy("ub", "ib")).applyInPandas(
        score, f"user_id {kind}, product_id string, score double"
    )


def recommend_ibcf(users: DataFrame, pairs: DataFrame, k: int, seen: DataFrame | None = None, **options) -> DataFrame:
    """(user_id, product_id, score, rank): the ``k`` best items a user has neither rated nor ``seen``.

    A user with ratings whose items have fewer neighbours gets the remaining places filled with
    items of score 0, in the order of their ids. Users without ratings have no list.
    """
    scored = ibcf_scores(pairs, **options).join(users.select("user_id"), "user_id", "left_semi")
    columns = ["user_id", "product_id", "score", "rank"]
    best = cut_lineage(topk_per_user(exclude_seen(scored, seen), k).select(*columns))
    raters = pairs.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_semi")
    have = best.groupBy("user_id").agg(F.count("*").cast("int").alias("have"))
    short = cut_lineage(raters.join(have, "user_id", "left").fillna(0, ["have"]).where(F.col("have") < k))
    known = [df.select("user_id", "product_id") for df in (pairs, best, *([] if seen is None else [seen]))]
    taken = known[0]
    for more in known[1:]:
        taken = taken.unionByName(more)
    taken = taken.join(short.select("user_id"), "user_id", "left_semi").distinct()
    by_id = global_row_index(pairs.select("product_id").distinct(), ["product_id"], "pop_rank")
    filler = recommend_popular(short, by_id.withColumn("pop_rank", F.col("pop_rank") + 1), k, taken)
    padded = filler.join(short, "user_id").select(
        "user_id", "product_id", F.lit(0.0).alias("score"), (F.col("rank") + F.col("have")).cast("int").alias("rank")
    ).where(F.col("rank") <= k)
    return best.unionByName(padded)


def bias_model(pairs: DataFrame, reg: float = 0.02) -> tuple[float, DataFrame, DataFrame]:
    """Mean rating, item biases and user biases; each bias is a mean residual shrunk by ``reg``."""
    mean = pairs.agg(F.avg("rating")).first()[0]
    items = pairs.groupBy("product_id").agg(
        (F.sum(F.col("rating") - mean) / (F.count("*") + reg)).alias("item_bias")
    )
    users = pairs.join(items, "product_id").groupBy("user_id").agg(
        (F.sum(F.col("rating") - mean - F.col("item_bias")) / (F.count("*") + reg)).alias("user_bias")
    )
    return mean, users, items


def bias_scores(wanted: DataFrame, pairs: DataFrame, reg: float = 0.02) -> DataFrame:
    """Predicted rating of wanted pairs from biases alone; unknown users or items drop their bias."""
    mean, users, items = bias_model(pairs, reg)
    return wanted.join(users, "user_id", "left").join(items, "product_id", "left").select(
        "user_id", "product_id",
        (F.lit(mean) + F.coalesce("user_bias", F.lit(0.0)) + F.coalesce("item_bias", F.lit(0.0))).alias("score"),
    )


def is_degenerate(pairs: DataFrame) -> bool:
    sizes = pairs.agg(F.countDistinct("user_id"), F.countDistinct("product_id")).first()
    return min(sizes) < 2


def constant_scores(wanted: DataFrame) -> DataFrame:
    return wanted.select("user_id", "product_id", F.lit(CONSTANT_SCORE).alias("score"))


def _pad(vector, dims: int):
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), dims))


def biased_mf(pairs: DataFrame, rank: int = 20, reg: float = 0.02, iterations: int = 10, seed: int = 42):
    """(user_id, vec), (product_id, vec), dims: the dot product is mean + biases + factors.

    ALS learns the residual of the bias model. Users or items without ratings are simply absent;
    :func:`with_cold` gives them a bias-only vector.
    """
    mean, user_bias, item_bias = bias_model(pairs, reg)
    user_no = global_row_index(user_bias, ["user_id"], "user_no").withColumn("user_no", F.col("user_no").cast("int"))
    item_no = global_row_index(item_bias, ["product_id"], "item_no").withColumn("item_no", F.col("item_no").cast("int"))
    residual = pairs.join(user_no, "user_id").join(item_no, "product_id").select(
        "user_no", "item_no", (F.col("rating") - mean - F.col("user_bias") - F.col("item_bias")).alias("residual")
    )
    model = ALS(
        rank=rank, regParam=reg, maxIter=iterations, seed=seed, userCol="user_no", itemCol="item_no",
        ratingCol="residual", checkpointInterval=1,  # ALS drops the shuffled factors of earlier rounds at a checkpoint.
    ).fit(residual)
    users = user_no.join(model.userFactors.withColumnRenamed("id", "user_no"), "user_no", "left").select(
        "user_id",
        dense(F.concat(_pad(F.col("features").cast("array<double>"), rank),
                       F.array(F.lit(mean) + F.col("user_bias"), F.lit(1.0)))).alias("vec"),
    )
    items = item_no.join(model.itemFactors.withColumnRenamed("id", "item_no"), "item_no", "left").select(
        "product_id",
        dense(F.concat(_pad(F.col("features").cast("array<double>"), rank),
                       F.array(F.lit(1.0), F.col("item_bias")))).alias("vec"),
    )
    return users, items, rank + 2, mean


def cold_vectors(ids: DataFrame, known: DataFrame, key: str, rank: int, tail: Sequence[float]) -> DataFrame:
    """Vectors for ids without ratings: zero factors and the given bias terms."""
    missing = ids.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    vector = F.concat(F.array_repeat(F.lit(0.0), rank), F.array(*[F.lit(float(t)) for t in tail]))
    return known.unionByName(missing.select(key, dense(vector).alias("vec")))


def with_cold(
    users: DataFrame, items: DataFrame, all_users: DataFrame | None, all_items: DataFrame | None, dims: int, mean: float
) -> tuple[DataFrame, DataFrame]:
    """Vectors of :func:`biased_mf` for all given ids: a cold user scores mean + item bias, a cold item mean + user bias."""
    if all_users is not None:
        users = cold_vectors(all_users, users, "user_id", dims - 2, (mean, 1.0))
    if all_items is not None:
        items = cold_vectors(all_items, items, "product_id", dims - 2, (1.0, 0.0))
    return users, items


def _factor_blocks(pairs: DataFrame, key: str, rows: int) -> DataFrame:
    """(b, keys): the ids of ``key`` in hashed blocks of about ``rows`` ids, in order."""
    ids = pairs.dropna(subset=["user_id", "product_id"]).select(key).distinct()
    block = F.pmod(F.xxhash64(key), F.lit(block_count(ids, rows))).cast("int")
    return cut_lineage(ids.groupBy(block.alias("b")).agg(F.array_sort(F.collect_list(key)).alias("keys")))


def _places(blocks: DataFrame, key: str, block: str, place: str) -> DataFrame:
    return blocks.select(F.col("b").alias(block), F.posexplode("keys").alias(place, key))


def nmf(pairs: DataFrame, rank: int = 20, iterations: int = 50, tol: float = 1e-4, seed: int = 42,
        check_every: int = 5) -> tuple[DataFrame, DataFrame, int, list[float]]:
    """Non-negative factors of the zero-filled rating matrix, and the loss after each check.

    Multiplicative updates only need the stored cells: the product with the data matrix is a
    weighted vector sum per row, and the zeros enter through the rank x rank Gram matrix. The cells lie in tiles of
    a block of users and a block of items, and a row of a factor table holds the vectors of a block, so a round moves few
    large rows. Each new factor table is written: it is small next to the data, and the plan does not grow from
    round to round. Stops when the loss falls by less than ``tol``.
    """
    # A user's ratings lie in one file.
    pairs = cut_lineage(pairs.select("user_id", "product_id", "rating").repartition("user_id"))
    n_rows, n_users, n_items, total, squares = pairs.agg(
        F.count("*"), F.countDistinct("user_id"), F.countDistinct("product_id"), F.sum("rating"), F.sum(F.col("rating") ** 2)
    ).first()
    rank = min(rank, max(2, min(n_users - 1, n_items - 1)))
    scale = math.sqrt(total / (n_users * n_items) / rank)
    steps = 2**20
    # Blocks of users have about ``TILE_ROWS`` ratings together.
    user_ids = _factor_blocks(pairs, "user_id", max(1, n_users * TILE_ROWS // n_rows))
    item_ids = _factor_blocks(pairs, "product_id", FACTOR_ROWS)
    placed = pairs.join(_places(item_ids, "product_id", "ib", "i"), "product_id").join(_places(user_ids, "user_id", "ub", "u"), "user_id")
    cells = placed.groupBy("ub", "ib").agg(F.array_sort(F.collect_list(F.struct("u", "i", "rating"))).alias("c"))
    tiles = cut_lineage(cells.select("ub", "ib", "c.u", "c.i", "c.rating"))

    def start(blocks: DataFrame) -> DataFrame:
        def draws(key):
            return F.array(*[
                (F.pmod(F.xxhash64(key, F.lit(j), F.lit(seed)), F.lit(steps)) / float(steps) + 0.1) * 2 * scale
                for j in range(rank)
            ])

        return cut_lineage(blocks.select("b", F.flatten(F.transform("keys", draws)).alias("m")))

    @F.pandas_udf("array<double>")
    def squared(blocks: pd.Series) -> pd.Series:
        return pd.Series([(m.reshape(-1, rank).T @ m.reshape(-1, rank)).ravel() for m in blocks])

    @F.pandas_udf("no array<int>, sums array<double>")
    def weighted(mine: pd.Series, theirs: pd.Series, rating: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        """Per tile, the rows of ``mine`` that have a rating and the other side's vectors summed by rating."""
        found, out = [], []
        for a, b, r, m in zip(mine, theirs, rating, vectors):
            rows, place = np.unique(a, return_inverse=True)
            terms = m.reshape(-1, rank)[b] * r[:, None]
            found.append(rows)
            out.append(np.column_stack([np.bincount(place, terms[:, j], len(rows)) for j in range(rank)]).ravel())
        return pd.DataFrame({"no": found, "sums": out})

    @F.pandas_udf("double")
    def crossed(u: pd.Series, i: pd.Series, rating: pd.Series, users: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([
            float(r @ (a.reshape(-1, rank)[x] * b.reshape(-1, rank)[y]).sum(axis=1))
            for x, y, r, a, b in zip(u, i, rating, users, items)])

    def gram(factors: DataFrame) -> np.ndarray:
        return factors.agg(Summarizer.sum(array_to_vector(squared("m")))).first()[0].toArray().reshape(rank, rank)

    def updated(factors: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        weights = gram(other)

        def step(block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            v = block["m"].iloc[0].reshape(-1, rank)
            target = np.zeros(v.shape)
            for _, no, sums in sorted(zip(parts["from_b"], parts["no"], parts["sums"]), key=lambda part: part[0]):
                target[no] += sums.reshape(-1, rank)
            moved = v * target / np.maximum(v @ weights, 1e-12)
            return pd.DataFrame({"b": block["b"].iloc[:1], "m": [moved.ravel()]})

        near = tiles.join(other.select(F.col("b").alias(f"{theirs}b"), "m"), f"{theirs}b")
        parts = near.select(F.col(f"{mine}b").alias("b"), F.col(f"{theirs}b").alias("from_b"), weighted(mine, theirs, "rating", "m").alias("p"))
        parts = parts.select("b", "from_b", "p.no", "p.sums")
        return cut_lineage(factors.groupBy("b").cogroup(parts.groupBy("b")).applyInPandas(step, "b int, m array<double>"))

    def loss(users: DataFrame, items: DataFrame) -> float:
        both = tiles.join(items.select(F.col("b").alias("ib"), F.col("m").alias("im")), "ib").join(
            users.select(F.col("b").alias("ub"), F.col("m").alias("um")), "ub")
        together = both.agg(F.sum(crossed("u", "i", "rating", "um", "im"))).first()[0]
        return float(squares - 2 * together + np.sum(gram(users) * gram(items)))

    def vectors(blocks: DataFrame, factors: DataFrame, key: str) -> DataFrame:
        flat = blocks.join(factors, "b").select("m", F.posexplode("keys").alias("no", key))
        return flat.select(key, dense(F.slice("m", F.col("no") * rank + 1, rank)).alias("vec"))

    users, items, losses = start(user_ids), start(item_ids), []
    for i in range(iterations):
        users = updated(users, items, "u", "i")
        items = updated(items, users, "i", "u")
        if (i + 1) % check_every == 0 or i + 1 == iterations:
            losses.append(loss(users, items))
            if len(losses) > 1 and losses[-2] - losses[-1] < tol * abs(losses[0]):
                break
    return vectors(user_ids, users, "user_id"), vectors(item_ids, items, "product_id"), rank, losses


def recommend_factors(users: DataFrame, items: DataFrame, dims: int, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(user_id, product_id, score, rank) from factor tables with a ``vec`` column."""
    return top_scores(
        users.withColumnRenamed("vec", "score"), items.withColumnRenamed("vec", "score"),
        {"score": dims}, [{"score": 1.0}], k, seen=seen,
    ).withColumnRenamed("best_rank", "rank")
