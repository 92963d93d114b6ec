"""Edge cases, brute-force comparisons and partitioning invariants of the operators."""

import itertools
import math
import os
import random
import re
import threading
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilerec.operators import augment, blocks, cf, clean, cluster, evaluate, history, journey, lambdamart, ordering, persona, rank, rfm, stats, textmine, vectors
from profilerec.operators.skew import join_per_key
from profilerec.plans import recommend as plan


def test_fill_ordered_matches_row_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, None, f"u{i}"])) for i in range(300)]
    rows[0] = (0, None)
    want, last = {}, None
    first = next(v for _, v in rows if v)
    for i, v in rows:
        last = v or last
        want[i] = last or first
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "ord bigint, v string").repartition(parts)
        got = {r["ord"]: r["v"] for r in ordering.fill_ordered(df, ["v"], "ord", buckets=9).collect()}
        assert got == want
    empty = spark.createDataFrame([(1, None), (2, None)], "ord bigint, v string")
    assert [r["v"] for r in ordering.fill_ordered(empty, ["v"], "ord").collect()] == [None, None]


def test_exact_quantiles_without_percentile(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(4000, 7.0), rng.lognormal(3, 2, 8000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = stats.exact_quantiles(df, ["x"], [0.01, 0.37, 0.5, 0.99])["x"]
    assert np.allclose(got, np.quantile(x, [0.01, 0.37, 0.5, 0.99]))


def test_kth_value_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 5, 5, 9]], "x double")
    assert stats.kth_value(df, F.col("x"), 2) == (5.0, 1, 3)


def test_quantile_clip_and_tercile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    got = sorted(r["x"] for r in clean.clip_quantiles(df, ["x"]).collect())
    assert np.allclose(got, [1.03, 2, 3, 9.79])

    def bucket(xs):
        return Counter(r["b"] for r in clean.tercile_bucket(spark.createDataFrame([(float(v),) for v in xs], "x double"), "x", "b").collect())

    assert bucket(range(1, 10)) == {"low": 3, "mid": 3, "high": 3}
    assert bucket([4, 4, 4]) == {"mid": 3}
    assert bucket([0] * 6 + [1, 2]) == {"mid": 8}


def test_modes(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", None), ("b", None), (None, None)], "x string, y string")
    rows = clean.impute_mode(df, ["x", "y"]).collect()
    assert Counter(r["x"] for r in rows) == {"a": 3, "b": 2}
    assert {r["y"] for r in rows} == {"Unknown"}


def test_splits(spark):
    rows = [(f"u{n}", i, f"2024-01-{i + 1:02d} 00:00:00") for n in (1, 2, 5, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, i int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = ordering.per_user_split(df, "ts", ["i"]).groupBy("user_id").agg(
        F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b")).collect()
    assert {r["user_id"]: (r["a"], r["b"]) for r in got} == {"u1": (1, 0), "u2": (1, 1), "u5": (4, 1), "u10": (8, 2)}
    split = ordering.global_split(df.withColumn("k", F.substring("user_id", 2, 3).cast("int")), "ts", ["k", "i"])
    order = sorted((r["ts"], r["k"], r["i"], r["split"]) for r in split.collect())
    assert [r[3] for r in order] == ["train"] * 14 + ["test"] * 4


def test_row_index_large_path(spark):
    rows = [(i * 7919 % 1009, i) for i in range(1009)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = {r["a"]: r["row_index"] for r in ordering.global_row_index(df, ["a"]).collect()}
    assert got == {a: a for a, _ in rows}


def test_hot_key_join(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"u{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = join_per_key(df, per, "k", "n", ["i"])
    assert got.count() == 3500 and got.where("k = 'hot' AND top <> 2999").count() == 0


def test_session_boundary_and_day_difference(spark):
    rows = [("a", "1", "view", "2024-01-01 00:00:00", 1), ("a", "2", "view", "2023-12-31 23:59:59", 2),
            ("a", "3", "like", "2024-01-01 00:30:00", 3), ("b", "4", "view", "2023-12-30 23:30:01", 4)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, event_type string, t string, event_id int").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    got = {r["user_id"]: r for r in journey.journey_profiles(df, ["event_id"]).collect()}
    assert (got["a"]["session_view_count"], got["a"]["session_total_count"]) == (1, 2)
    assert got["b"]["days_since_last"] == 1 and got["a"]["current_journey_stage"] == "Interest"


def test_tiered_history(spark):
    rows = [("a", "1", "view", 1), ("a", "2", "like", 2), ("a", "3", "purchase", 3), ("b", "9", "purchase", 1), ("b", "2", "like", 2)]
    df = spark.createDataFrame(rows, "user_id string, product_id string, event_type string, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    products = spark.createDataFrame([("1", "n1", "c"), ("2", "n2", "c"), ("3", "n3", "c")], "product_id string, name string, category string")
    got = {(r["user_id"], r["product_id"]) for r in history.first_distinct_items(df, products).collect()}
    assert got == {("a", "3"), ("b", "2")}


def test_augmentation_is_stable_and_bounded(spark):
    df = spark.createDataFrame([(str(i), float(i), 5.0) for i in range(400)], "k string, x double, c double")
    copies = [
        {(r["k"], r["copy_id"]): r["x"] for r in augment.augment_gaussian(df.repartition(p), ["x", "c"], ["k"]).collect()}
        for p in (1, 7)
    ]
    assert copies[0] == pytest.approx(copies[1])
    assert all(copies[0][(str(i), 0)] == i for i in range(400))
    noise = np.array([copies[0][(str(i), 1)] - i for i in range(400)])
    assert 0.03 < noise.std() / np.std(range(400)) < 0.07


def brute_top(u, v, k, seen=()):
    out = set()
    for a, x in u.items():
        scored = sorted((-round(float(np.dot(x, y)), 9), b) for b, y in v.items() if (a, b) not in seen)
        out |= {(a, b) for _, b in scored[:k]}
    return out


def test_top_scores_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    u = {f"u{i}": rng.integers(0, 3, 4).astype(float) for i in range(60)}
    v = {f"p{i}": rng.integers(0, 3, 4).astype(float) for i in range(45)}
    seen = {(f"u{i}", f"p{j}") for i in range(60) for j in range(45) if (i + j) % 4 == 0}

    def frame(m, key):
        return spark.createDataFrame([(k, x.tolist()) for k, x in m.items()], f"{key} string, x array<double>").select(
            key, blocks.dense(F.col("x")).alias("score"))

    got = blocks.top_scores(
        frame(u, "user_id"), frame(v, "product_id"), {"score": 4}, [{"score": 1.0}], 6,
        seen=spark.createDataFrame(list(seen), "user_id string, product_id string"), block_rows=13)
    assert {(r["user_id"], r["product_id"]) for r in got.collect()} == brute_top(u, v, 6, seen)


@pytest.mark.parametrize("pairs", [0, 4])
def test_top_scores_in_chunks_of_large_blocks(spark, monkeypatch, pairs):
    """A task takes its blocks in chunks: ties, seen pairs, two rankings and a least score come out as from one matrix."""
    monkeypatch.setattr(blocks, "PAIRS_PER_TASK", pairs)
    rng = np.random.default_rng(6)
    u = {f"u{i}": rng.integers(-1, 2, 3).astype(float) for i in range(40)}
    v = {f"p{i}": rng.integers(-1, 2, 3).astype(float) for i in range(70)}
    seen = {(f"u{i}", f"p{j}") for i in range(40) for j in range(70) if (i + j) % 5 == 0}
    rankings = [{"a": 1.0}, {"a": 0.5, "b": -0.25}]

    def frame(m, key):
        return spark.createDataFrame([(k, x.tolist()) for k, x in m.items()], f"{key} string, x array<double>").select(
            key, blocks.dense(F.col("x")).alias("a"), blocks.dense(F.transform("x", lambda y: y * y)).alias("b"))

    for least in (None, 0.0):
        want = set()
        for weights in rankings:
            for p, x in u.items():
                total = [(-round(weights["a"] * (x @ y) + weights.get("b", 0.0) * ((x * x) @ (y * y)), 9), q) for q, y in v.items() if (p, q) not in seen]
                want |= {(p, q) for t, q in sorted(total)[:5] if least is None or -t > least}
        got = blocks.top_scores(
            frame(u, "user_id"), frame(v, "product_id"), {"a": 3, "b": 3}, rankings, 5,
            seen=spark.createDataFrame(list(seen), "user_id string, product_id string"), min_score=least, block_rows=9).collect()
        assert {(r["user_id"], r["product_id"]) for r in got} == want and len(got) == len(want)
        assert all(r["a"] == u[r["user_id"]] @ v[r["product_id"]] for r in got)


def test_knn_copies_rows_a_slice_at_a_time(spark, monkeypatch):
    """With wide bounds every row reaches every cell; no frame of copies holds more than the pairs of one slice."""
    monkeypatch.setattr(cluster, "REACH_PAIRS", 40)
    rng = np.random.default_rng(8)
    rows = {str(i): rng.random(12) for i in range(120)}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in rows.items()], "key string, vec array<double>")
    sizes, own = [], type(df).mapInPandas

    def watched(self, fn, schema, *rest):
        if "tile" in str(schema):
            batches = [self.toPandas()]
            sizes.extend(len(part) for part in fn(iter(batches)))
        return own(self, fn, schema, *rest)

    monkeypatch.setattr(type(df), "mapInPandas", watched)
    got = {}
    for r in cluster.knn(df, 3, cell_rows=10).collect():
        got.setdefault(r["key"], set()).add(r["other"])
    for k, x in rows.items():
        assert got[k] == set(sorted((o for o in rows if o != k), key=lambda o: (round(float(np.linalg.norm(x - rows[o])), 9), o))[:3])
    assert len(sizes) > 1 and max(sizes) <= 40 < sum(sizes)


def test_knn_sends_a_row_once_per_block_of_cells(spark, monkeypatch):
    """With wide bounds every row reaches every cell, but cells lie in few blocks; large blocks come in parts."""
    rng = np.random.default_rng(9)
    rows = {str(i): rng.random(12) for i in range(150)}
    group = {k: "a" if int(k) % 3 else "b" for k in rows}
    df = spark.createDataFrame([(k, x.tolist(), group[k]) for k, x in rows.items()], "key string, vec array<double>, g string")
    sent, own = [], type(df).mapInPandas

    def watched(self, fn, schema, *rest):
        if "tile" in str(schema):
            sent.append(sum(len(part) for part in fn(iter([self.toPandas()]))))
        return own(self, fn, schema, *rest)

    monkeypatch.setattr(type(df), "mapInPandas", watched)

    def check(blocks: int, **options):
        got = {}
        for r in cluster.knn(df, 3, cell_rows=10, **options).collect():
            got.setdefault(r["key"], set()).add(r["other"])
        for k, x in rows.items():
            others = [o for o in rows if o != k and (not options or group[o] == group[k])]
            assert got[k] == set(sorted(others, key=lambda o: (round(float(np.linalg.norm(x - rows[o])), 9), o))[:3])
        assert sent.pop() <= blocks * len(rows)

    check(1)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cluster, "MOST_CHUNKS", 2)
    monkeypatch.setattr(cluster, "PART_ROWS", 4)
    # Ten blocks of fifteen rows, of which a group holds some.
    check(10)
    check(10, group="g")


def test_nmf_keeps_the_ratings_of_a_user_in_one_file(spark, monkeypatch):
    """So a round sends one vector per user, not one per rating."""
    written, write = [], cf.cut_lineage
    monkeypatch.setattr(cf, "cut_lineage", lambda df, *name: written.append(write(df, *name)) or written[-1])
    rng = random.Random(4)
    rows = [(f"u{i}", f"p{j}", float(rng.choice([1, 3, 5]))) for i in range(40) for j in range(30) if rng.random() < 0.5]
    pairs = spark.createDataFrame(rows, "user_id string, product_id string, rating double").repartition(4)
    _, _, _, losses = cf.nmf(pairs, rank=2, iterations=2, check_every=1)
    files = written[0].select("user_id", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len({r["user_id"] for r in files}) == 40 and losses[1] <= losses[0] and written[0].count() == len(rows)


def test_nmf_moves_blocks_and_equals_dense_updates(spark, monkeypatch):
    """A factor table has one row per block, whatever the number of blocks, and the rounds are those of the whole matrix."""
    rng = random.Random(9)
    rows = [(f"u{i}", f"p{j}", float(rng.choice([1, 3, 5]))) for i in range(40) for j in range(25) if rng.random() < 0.4]
    pairs = spark.createDataFrame([*rows, rows[0], (None, "p1", 5.0), ("u1", None, 1.0)], "user_id string, product_id string, rating double")
    write = cf.cut_lineage
    for tile, items_of in ((40, 4), (1 << 16, 1 << 12)):
        written = []
        monkeypatch.setattr(cf, "cut_lineage", lambda df, *name: written.append(write(df, *name)) or written[-1])
        monkeypatch.setattr(cf, "TILE_ROWS", tile)
        monkeypatch.setattr(cf, "FACTOR_ROWS", items_of)
        users, items, rank, losses = cf.nmf(pairs, rank=3, iterations=2, check_every=1, tol=-1.0)
        kept, user_ids, item_ids, _tiles, first_users, first_items, *rounds = written
        assert all(t.count() == (user_ids, item_ids)[i % 2].count() for i, t in enumerate(rounds)) and len(rounds) == 4
        assert (user_ids.count() == item_ids.count() == 1) == (tile > 40) and kept.count() == len(rows) + 3

        def dense(ids, factors):
            found = {}
            for r in ids.join(factors, "b").collect():
                found.update(zip(r["keys"], np.array(r["m"]).reshape(-1, rank)))
            return sorted(found), np.array([found[k] for k in sorted(found)])

        (names, u), (goods, v) = dense(user_ids, first_users), dense(item_ids, first_items)
        x = np.zeros((len(names), len(goods)))
        for user, item, r in [*rows, rows[0]]:
            x[names.index(user), goods.index(item)] += r
        for _ in range(2):
            u = u * (x @ v) / np.maximum(u @ (v.T @ v), 1e-12)
            v = v * (x.T @ u) / np.maximum(v @ (u.T @ u), 1e-12)
        for key, table, want, ids in (("user_id", users, u, names), ("product_id", items, v, goods)):
            got = {r[0]: r[1] for r in table.select(key, "vec.val").collect()}
            assert sorted(got) == ids and np.allclose([got[k] for k in ids], want, rtol=1e-9)
        assert losses[1] <= losses[0]


def test_histograms_hold_one_feature_at_a_time():
    """The split of a leaf makes no array of rows times features, and finds the best cut of the sums."""
    rng = np.random.default_rng(3)
    n, n_features = 20_000, 18
    x, grad, curve = rng.normal(size=(n, n_features)).round(1), rng.normal(size=n), rng.random(n) + 0.1
    grad += 0.2 * (x[:, 4] > 0.3)
    grower = lambdamart._Grower(x, lambdamart.LambdaOptions())
    tracemalloc.start()
    gain, feature, cell = grower._split(np.arange(n), grad, curve, np.arange(n_features))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n_features * 8 / 2
    assert feature == 4 and cell > 0
    left = x[:, feature] <= grower.edges[feature][cell - 1]
    parts = [grad[s].sum() ** 2 / curve[s].sum() for s in (left, ~left, left | ~left)]
    assert abs(gain - (parts[0] + parts[1] - parts[2])) < 1e-6 * gain


def test_top_scores_send_few_rows_and_results():
    """Rows sent and the ``k`` results per left row and block of the right: fewer than with equal bounds for both sides."""
    n, m, k = 900_000, 1_200_000, 10
    cost = lambda grid: n * grid[1] * (1 + k / 5) + m * grid[0]
    left, right = blocks.stream_grid(n, m, 65536, 262144, 2048, 96, k)
    assert -(-n // left) <= 65536 and -(-m // right) <= 262144 and left * right >= 96
    assert cost((left, right)) < 0.6 * cost(blocks.block_grid(n, m, 2048, 65536, 96))
    assert blocks.stream_grid(0, 0, 10, 10, 5, 4, 2) == (1, 1) and blocks.stream_grid(90_000, 100, 16384, 32768, 2048, 96, 30) == (44, 1)


def test_biased_mf_drops_the_factors_of_earlier_rounds(spark, monkeypatch):
    """Shuffled factors of all rounds together would fill the disk: a checkpoint per round lets Spark delete them."""
    given = []
    own = cf.ALS
    monkeypatch.setattr(cf, "ALS", lambda **options: given.append(options) or own(**options))
    pairs = spark.createDataFrame([(f"u{u}", f"p{(u * 3 + j) % 7}", float(1 + (u + j) % 5)) for u in range(9) for j in range(4)], "user_id string, product_id string, rating double")
    users, _, dims, _ = cf.biased_mf(pairs, rank=2, iterations=3)
    assert users.count() == 9 and dims == 4 and given[0]["checkpointInterval"] == 1


def test_blocks_repeat_few_rows():
    """Rows sent: every row of a side once per block of the other."""
    sent = lambda grid, n, m: n * grid[1] + m * grid[0]
    n, m = 900_000, 1_200_000
    assert sent(blocks.block_grid(n, m, 2048, 65536, 800), n, m) < 0.1 * sent((-(-n // 2048), -(-m // 2048)), n, m)
    left, right = blocks.block_grid(90_000, 100, 2048, 65536, 800)
    assert (left, right) == (44, 1) and blocks.block_grid(0, 5, 2048, 65536, 800) == (1, 1)
    left, right = blocks.block_grid(n, m, 2048, 65536, 800)
    assert left * right >= 252 and -(-n // left) <= 65536 and -(-m // right) <= 65536


def test_item_similarity_equals_cosines_for_any_block_size(spark):
    rng = random.Random(2)
    rows = list({(f"u{rng.randrange(30)}", f"p{rng.randrange(25)}"): float(rng.choice([1, 3, 5])) for _ in range(400)}.items())
    df = spark.createDataFrame([(a, b, r) for (a, b), r in rows], "user_id string, product_id string, rating double")
    columns = {}
    for (user, item), r in rows:
        columns.setdefault(item, {})[user] = r
    dot = lambda a, b: sum(x * columns[b].get(u, 0.0) for u, x in columns[a].items())
    want = {
        (a, b): round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 9) for a in columns for b in columns if a != b and dot(a, b) > 0
    }
    for size in (7, 1000):
        assert {(r["product_a"], r["product_b"]): round(r["sim"], 9) for r in cf.item_similarity(df, size).collect()} == want


def test_popular_skips_seen(spark):
    log = spark.createDataFrame(
        [("a", p) for p in "xxxyyz"] + [("b", "w")], "user_id string, product_id string")
    ranked = cf.popular_rank(log)
    seen = spark.createDataFrame([("a", "x"), ("a", "y")], "user_id string, product_id string")
    got = {(r["user_id"], r["product_id"]) for r in cf.recommend_popular(log, ranked, 2, seen).collect()}
    assert got == {("a", "w"), ("a", "z"), ("b", "x"), ("b", "y")}


def test_nmf_is_non_negative_and_improves(spark):
    rng = random.Random(4)
    rows = [(f"u{i}", f"p{j}", float(rng.choice([1, 3, 5]))) for i in range(20) for j in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "user_id string, product_id string, rating double")
    users, items, _dims, losses = cf.nmf(df, rank=3, iterations=4, check_every=1, tol=-1.0)
    assert all(b <= a * 1.000001 for a, b in itertools.pairwise(losses)) and len(losses) == 4
    for side in (users, items):
        assert side.where(F.exists("vec.val", lambda x: x < 0)).count() == 0


def test_biased_mf_scores_cold_users_and_items(spark):
    rng = random.Random(6)
    rows = [(f"u{i}", f"p{j}", float(rng.choice([1, 3, 5]))) for i in range(8) for j in range(6) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "user_id string, product_id string, rating double")
    people = spark.createDataFrame([("u0",), ("cold",), (None,)], "user_id string")
    goods = spark.createDataFrame([("p0",), ("new",), ("new",)], "product_id string")
    users, items, dims = plan.factor_vectors(df, "biased_mf", people, goods, rank=3, iterations=2)
    got = {(r["user_id"], r["product_id"]): r["score"] for r in cf.recommend_factors(users, items, dims, 100).collect()}
    mean, user_bias, item_bias = cf.bias_model(df)
    item_of = {r["product_id"]: r["item_bias"] for r in item_bias.collect()}
    user_of = {r["user_id"]: r["user_bias"] for r in user_bias.collect()}
    assert len(got) == (len(user_of) + 1) * (len(item_of) + 1)
    for p, b in item_of.items():
        assert got["cold", p] == pytest.approx(mean + b)
    for u, b in user_of.items():
        assert got[u, "new"] == pytest.approx(mean + b)
    assert got["cold", "new"] == pytest.approx(mean)


def test_metrics(spark):
    recs = spark.createDataFrame([("m", "u", p, i + 1) for i, p in enumerate("abc")], "model string, user_id string, product_id string, rank int")
    truth = spark.createDataFrame([("u", "b"), ("u", "z")], "user_id string, product_id string")
    pop = spark.createDataFrame([(p, 0.25) for p in "abc"], "product_id string, popularity double")
    got = evaluate.user_metrics(recs, truth, 10, pop).first()
    assert got["precision"] == pytest.approx(0.1) and got["recall"] == pytest.approx(0.5)
    assert got["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["novelty"] == pytest.approx(2.0)
    assert evaluate.coverage(recs, F.lit(12)).first()["coverage"] == pytest.approx(25.0)
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0])], "product_id string, embedding array<float>")
    assert evaluate.list_similarity(recs, vecs).first()["ils"] == pytest.approx(1.0)
    assert evaluate.list_similarity(recs, vecs.where("product_id = 'a'")).first()["ils"] == 0.0


def ndcg(rows, score, k=10):
    """Mean NDCG at ``k`` over users, equal scores in product order."""
    users, out = {}, []
    for r in rows:
        users.setdefault(r["user_id"], []).append(r)
    for own in users.values():
        ranked = sorted(own, key=lambda r: (-r[score], r["product_id"]))
        gain = sum(r["is_relevant"] / np.log2(i + 2) for i, r in enumerate(ranked[:k]))
        best = sum(1 / np.log2(i + 2) for i in range(min(k, sum(r["is_relevant"] for r in own))))
        out.append(gain / best if best else 0.0)
    return float(np.mean(out))


def ranking_rows(seed, users):
    """Relevance depends on a product of two features and a threshold; a third one is noise or missing."""
    rng, rows = random.Random(seed), []
    for u in range(users):
        for p in range(25):
            x, y, z = rng.random(), rng.random(), rng.random()
            rows.append((f"u{seed}-{u}", f"p{p:02d}", x, y, z if z > 0.2 else None, x, int(x * y > 0.45)))
    return rows


def test_lambdamart_is_fitted_once_and_ranks_other_rows(spark, tmp_path):
    schema = "user_id string, product_id string, x double, y double, z double, first double, is_relevant int"
    train, other = (spark.createDataFrame(ranking_rows(s, n), schema) for s, n in ((1, 80), (2, 30)))
    model = lambdamart.fit(train, ["x", "y", "z"])
    nodes = model.nodes.toPandas()
    assert nodes["tree"].nunique() == 200 and nodes.groupby("tree")["feature"].apply(lambda f: (f < 0).sum()).max() <= 31
    got = model.predict(other).collect()
    assert len(got) == 30 * 25 and ndcg(got, "reranked_score") > max(0.97, ndcg(got, "first"))
    model.save(str(tmp_path / "model"))
    again = lambdamart.LambdaModel.load(spark, str(tmp_path / "model")).predict(other.repartition(5))
    key = lambda rows: sorted((r["user_id"], r["product_id"], r["reranked_score"]) for r in rows)
    assert key(again.collect()) == key(got)
    ranked = rank.rerank(other, "auto", train=train, min_positives=10, features=["x", "y", "z"])
    assert key(ranked.collect()) == key(got)


def test_lambdamart_without_a_choice(spark):
    schema = "user_id string, product_id string, x double, is_relevant int"
    same = spark.createDataFrame([("u", f"p{i}", float(i), 1) for i in range(30)], schema)
    assert {r["reranked_score"] for r in rank.rank_lambdamart(same, ["x"], rounds=3).collect()} == {0.0}
    assert rank.rank_lambdamart(same.limit(0), ["x"], rounds=3).collect() == []
    users = spark.createDataFrame([(f"u{i}", f"p{j}", 0.0, 0) for i in range(20) for j in range(5)], schema)
    assert lambdamart.training_users(users, 23).count() == 4 and lambdamart.training_users(users, 2).count() == 1


def test_lambdamart_fits_all_rows_beyond_one_task(spark):
    """Rows that do not fit one task are all fitted, by the trees that one task would grow."""
    schema = "user_id string, product_id string, x double, y double, z double, first double, is_relevant int"
    rows = ranking_rows(5, 60)
    # Users of one kind like high x, all others low x: a draw of few users knows one kind only.
    rows = [(*r[:6], int(r[2] > 0.7 if int(r[0].split("-")[1]) % 2 else r[2] < 0.3 and r[3] > 0.5)) for r in rows]
    train = spark.createDataFrame(rows, schema).repartition(5)

    def scores(**options):
        model = lambdamart.fit(train, ["x", "y", "z"], options=lambdamart.LambdaOptions(subsample=1.0, colsample=1.0, **options))
        return np.array([r["s"] for r in model.predict(train, "s").orderBy("user_id", "product_id").collect()])

    assert np.allclose(scores(rounds=1), scores(rounds=1, train_rows=100), atol=1e-9)
    # Later trees part where two leaves gain the same.
    assert np.abs(scores(rounds=5) - scores(rounds=5, train_rows=100)).mean() < 0.03
    drawn = lambdamart.fit(train, ["x", "y", "z"], options=lambdamart.LambdaOptions(train_rows=100, rounds=5)).nodes.toPandas()
    assert drawn["tree"].nunique() == 5 and drawn.groupby("tree")["feature"].apply(lambda f: (f < 0).sum()).max() <= 31
    again = lambdamart.fit(train.repartition(3), ["x", "y", "z"], options=lambdamart.LambdaOptions(train_rows=100, rounds=5)).nodes.toPandas()
    assert drawn.equals(again)


def test_bin_edges_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([
        rng.normal(size=3000), rng.integers(0, 7, 3000).astype(float), np.where(rng.random(3000) < 0.6, 1.5, rng.random(3000)),
        np.where(rng.random(3000) < 0.2, np.nan, rng.lognormal(0, 9, 3000)), np.full(3000, np.nan), rng.integers(0, 400, 3000) * 1.0])
    x[:3, 0] = np.inf, -np.inf, 1e300
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    for bins in (3, 255):
        got = lambdamart.all_bin_edges(rows, x.shape[1], bins)
        assert all(np.array_equal(g, lambdamart.bin_edges(x[:, f], bins)) for f, g in enumerate(got))


def test_gradients_are_those_of_the_pairs():
    rng = np.random.default_rng(4)
    score, label = rng.normal(size=9), np.array([1, 0, 0, 1, 0, 1, 0, 0, 0])
    place = np.empty(9)
    place[np.argsort(-score)] = 1 / np.log2(np.arange(9) + 2)
    best, want = sum(1 / np.log2(i + 2) for i in range(3)), np.zeros(9)
    for i in np.flatnonzero(label == 1):
        for j in np.flatnonzero(label == 0):
            pull = abs(place[i] - place[j]) / best / (1 + np.exp(score[i] - score[j]))
            want[i] += pull
            want[j] -= pull
    assert np.allclose(lambdamart.pair_gradients(score, label)[0], want)


def test_ranker_gate(spark):
    df = spark.createDataFrame([(1,)] * 120 + [(0,)] * 100, "is_relevant int")
    assert rank.can_train_ranker(df) and not rank.can_train_ranker(df.where("is_relevant = 1"))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(6, 0.3, (60, 3))]), 6)
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<double>")
    want = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * len(x)), axis=1)[:, :4]
    got = {}
    for r in cluster.knn(df, 4, cell_rows=20).collect():
        got.setdefault(int(r["key"]), []).append(r["distance"])
    assert np.allclose([sorted(got[i]) for i in range(len(x))], want, atol=1e-6)


def test_density_clusters_find_blobs_and_copies(spark):
    rng = np.random.default_rng(8)
    blobs = [rng.normal(c, 0.15, (30, 2)) for c in (0.0, 5.0, 10.0)]
    rows = [(f"{b}-{i}", v.tolist()) for b, m in enumerate(blobs) for i, v in enumerate(m)]
    rows += [(f"3-{i}", [20.0, 20.0]) for i in range(30)] + [("far", [50.0, -50.0])]
    df = spark.createDataFrame(rows, "product_id string, reduced array<double>")
    got = cluster.density_cluster(df, 10, 4).collect()
    assert len(got) == len(rows)
    by_blob = {}
    for r in got:
        by_blob.setdefault(r["product_id"].split("-")[0], Counter())[r["major_cluster"]] += 1
    mains = {b: c.most_common(1)[0] for b, c in by_blob.items() if b != "far"}
    assert len({m[0] for m in mains.values()}) == 4 and all(n >= 25 and c >= 0 for c, n in mains.values())


def test_pca_is_centred_and_ordered(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, [3, 1, 0.2], (80, 3)) + 5
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "product_id string, embedding array<double>")
    y = np.array([r["reduced"] for r in vectors.reduce_dims(df, 3, 2).collect()])
    c = np.cov(y.T)
    assert np.allclose(y.mean(0), 0, atol=1e-8) and abs(c[0, 1]) < 1e-8 and c[0, 0] > c[1, 1]


def test_enrichment_fills_gaps(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, n int")

    def flaky(batch):
        if any(r["n"] == 2 for r in batch):
            raise RuntimeError("down")
        return {r["cache_key"]: {"v": "ok"} for r in batch}

    got = persona.enrich_batched(rows, "cache_key", ["n"], ["v"], flaky, batch_size=1).collect()
    assert {r["cache_key"]: r["v"] for r in got} == {"a": "ok", "b": None}


def test_quantiles_with_infinities_nan_and_nulls(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate([inf, 1.0, None, float("nan"), 2.0, 3.0, -inf, 2.0, 1e308, -1e308, 5e-324])], "x double, y double")
    got = stats.exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), ["x", "y", "none"], [0.0, 0.5, 1.0])
    assert got == {"x": [-inf, 2.0, inf], "y": [0.0, 5.0, 10.0], "none": [None, None, None]}
    assert stats.kth_value(df, F.col("x"), 4)[:3] == (2.0, 4, 2)
    with pytest.raises(ValueError):
        stats.kth_value(df, F.col("x"), 9)


def test_quantiles_equal_the_percentile_function(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 100_000 / 7).alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    probs = [0.01, 0.25, 0.5, 0.75, 0.999]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("x", "y")]).first()
    got = stats.exact_quantiles(df, ["x", "y"], probs)
    assert all(got[c] == pytest.approx(list(want[c]), rel=1e-12) for c in ("x", "y"))


def test_splits_keep_rows_without_a_time(spark):
    rows = [("u", None, 1), ("u", None, 2), ("u", "2024-01-01 00:00:00", 3), ("u", "2024-01-02 00:00:00", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "user_id string, ts string, n int").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {r["n"]: r["split"] for r in ordering.per_user_split(df, "ts", ["n"]).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "test", 5: "train"}
    dated = spark.range(10).select(F.lit("u").alias("user_id"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.col("id").alias("n"))
    both = dated.union(spark.range(10).select(F.lit("u"), F.lit(None).cast("timestamp_ntz"), F.col("id") + 100))
    train = {r["n"] for r in ordering.global_split(both, "ts", ["n"]).where("split = 'train'").collect()}
    assert train == {*range(8), *range(100, 110)}


def test_repeated_catalog_rows_give_an_item_once(spark):
    log = spark.createDataFrame([("u", "p", "purchase", 1), ("u", "q", "purchase", 2)], "user_id string, product_id string, event_type string, ts int")
    products = spark.createDataFrame([("p", "a", "x")] * 3 + [("q", "b", "x")], "product_id string, name string, category string")
    got = [(r["rank"], r["product_id"]) for r in history.first_distinct_items(log, products).orderBy("rank").collect()]
    assert got == [(1, "p"), (2, "q")]


def test_list_similarity_counts_zero_vectors_as_dissimilar(spark):
    recs = spark.createDataFrame([("u", p) for p in "abc"], "user_id string, product_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0])], "product_id string, embedding array<double>")
    assert evaluate.list_similarity(recs, vectors).first()["ils"] == pytest.approx(1 / 3)


def test_fill_in_one_slice(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "n int, x string")
    assert [r["x"] for r in ordering.fill_ordered(df, ["x"], "n", buckets=1).orderBy("n").collect()] == ["a", "a", "a"]


def test_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "b", [1]), (1, "a", [2]), (2, None, None)], "k int, v string, w array<int>")
    assert sorted((r["k"], r["v"]) for r in ordering.one_per_key(df, "k").collect()) == [(1, "a"), (2, None)]


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    loads, calls = tmp_path / "loads", tmp_path / "calls"
    loads.mkdir()
    calls.mkdir()

    def mark(folder):
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def load():
        mark(loads)

        def model(texts):
            mark(calls)
            return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

        return model

    docs = spark.createDataFrame([(i, None if i == 7 else "a" * i + "b") for i in range(400)], "id int, text string").repartition(6)
    got = {int(r["id"]): r["embedding"] for r in textmine.embed_text(docs, "id", "text", load=load, batch_size=10).collect()}
    assert len(got) == 400 and got[7] == [0.0, 0.0, 1.0] and all(got[i] == [i + 1.0, float(i), 1.0] for i in got if i != 7)
    workers = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(workers) == len(set(workers)) and len(list(calls.iterdir())) >= 40 > len(workers)
    light = textmine.embed_text(docs, "id", "text", encode=lambda texts: [[len(t)] for t in texts])
    assert {int(r["id"]): r["embedding"][0] for r in light.collect()}[9] == 10.0


def test_short_neighbour_lists_are_filled(spark):
    pairs = spark.createDataFrame(
        [("u", "a", 1.0), ("v", "a", 3.0), ("v", "c", 5.0), ("w", "e", 1.0)] + [("x", p, 1.0) for p in "bdf"], "user_id string, product_id string, rating double")
    users = spark.createDataFrame([("u",), ("v",), ("w",), ("x",), ("new",)], "user_id string")
    seen = spark.createDataFrame([("u", "b")], "user_id string, product_id string")
    lists = {}
    for r in sorted(cf.recommend_ibcf(users, pairs, 3, seen).collect(), key=lambda r: (r["user_id"], r["rank"])):
        lists.setdefault(r["user_id"], []).append((r["product_id"], r["score"] > 0, r["rank"]))
    assert lists == {
        "u": [("c", True, 1), ("d", False, 2), ("e", False, 3)], "v": [("b", False, 1), ("d", False, 2), ("e", False, 3)],
        "w": [("a", False, 1), ("b", False, 2), ("c", False, 3)], "x": [("a", False, 1), ("c", False, 2), ("e", False, 3)],
    }


@pytest.mark.parametrize("most_mapped, most_broadcast", [(256, 100_000), (2, 100_000), (2, 3)])
def test_codes_are_the_same_by_map_broadcast_and_salted_join(spark, monkeypatch, most_mapped, most_broadcast):
    monkeypatch.setattr(clean, "MAP_VALUES", most_mapped)
    monkeypatch.setattr(clean, "BROADCAST_VALUES", most_broadcast)
    values = ["é", "a", "B", "", None, "a", "unknown", "zz", "b"]
    rows = [(i, values[i % len(values)] if i > 60 else "a", i % 2) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, value string, code int")
    order = sorted({v for _, v, _ in rows if v is not None}, key=lambda v: v.encode())
    got = {r["id"]: r for r in clean.label_encode(df, ["value", "code"]).collect()}
    assert len(got) == 150
    for i, v, c in rows:
        assert (got[i]["value"], got[i]["code"], got[i]["code_encoded"]) == (v, c, c)
        assert got[i]["value_encoded"] == (None if v is None else order.index(v))
    known = df.where("value <> 'zz' or value is null")
    learned = sorted({"unknown" if v is None else v for _, v, _ in rows if v != "zz"}, key=lambda v: v.encode())
    coded = {r["id"]: r["value_encoded"] for r in clean.factorize(df, "value", known).collect()}
    assert coded == {i: learned.index(v or ("unknown" if v is None else "")) if v != "zz" else 0 for i, v, _ in rows}


def test_small_dictionaries_move_no_rows(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 5 as string) as c", "cast(id % 3 as string) as d")
    text = clean.label_encode(df, ["c", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_scores_meet_in_one_task_for_any_block_size(spark, monkeypatch):
    """Sums over a user's items are one row per score, and no aggregate of terms follows."""
    rng = random.Random(9)
    rated = {(f"u{rng.randrange(30)}", f"p{rng.randrange(25)}"): float(rng.choice([1, 3, 5])) for _ in range(200)}
    df = spark.createDataFrame([(u, p, r) for (u, p), r in rated.items()], "user_id string, product_id string, rating double")
    sims = {(r["product_a"], r["product_b"]): r["sim"] for r in cf.item_similarity(df, 7).collect()}
    want = {}
    for (u, a), r in rated.items():
        for (x, b), s in sims.items():
            if x == a and (u, b) not in rated:
                want[u, b] = want.get((u, b), 0.0) + s * r
    for rows, near in [(cf.RATED_ROWS, cf.SIM_ROWS), (20, 50)]:
        monkeypatch.setattr(cf, "RATED_ROWS", rows)
        monkeypatch.setattr(cf, "SIM_ROWS", near)
        scored = cf.ibcf_scores(df)
        assert "Aggregate" not in scored._jdf.queryExecution().executedPlan().toString()
        got = {(r["user_id"], r["product_id"]): r["score"] for r in scored.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_kmeans_fits_run_side_by_side_over_few_partitions(spark, monkeypatch):
    parts, meet = [], threading.Barrier(3)

    class Watched(rfm.KMeans):
        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            meet.wait(timeout=60)
            return super().fit(df)

    monkeypatch.setattr(rfm, "KMeans", Watched)
    monkeypatch.setattr(rfm, "FIT_ROWS", 30)
    df = vectors_of(spark, [(float(i % 5) * 10, float(i)) for i in range(60)]).repartition(20)
    model, cost = rfm.kmeans(df, 3, n_init=3)
    assert parts == [2, 2, 2] and cost == min(cost, model.summary.trainingCost) and len(model.clusterCenters()) == 3


def vectors_of(spark, rows):
    return rfm.vectors(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])


def test_tfidf_moves_texts_not_their_terms_and_spreads_hot_keys(spark):
    words = "alpha beta gamma delta omega".split()
    texts = [(i, " ".join(words[(i * j) % 5] for j in range(1 + i % 7))) for i in range(1200)]
    few = spark.createDataFrame(texts, "doc_id long, text string")
    plan = textmine.tfidf(few, "doc_id", "text", stopwords=())._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, term|hashpartitioning\(term", plan)
    many = spark.createDataFrame([*texts, *[(None, t) for _, t in texts[:40]], *[(7, t) for _, t in texts[:30]], (8, None)], few.schema)
    got = {(r["doc_id"], r["term"]): (r["tf"], round(r["weight"], 9)) for r in textmine.tfidf(many, "doc_id", "text", stopwords=()).collect()}
    counts = Counter((r["doc_id"], t) for r in many.collect() for t in (r["text"] or "").split())
    df, rows = Counter(t for _, t in counts), many.count()
    raw = {(d, t): n * (math.log((rows + 1) / (df[t] + 1)) + 1) for (d, t), n in counts.items()}
    length = Counter()
    for (d, _), w in raw.items():
        length[d] += w * w
    assert got == {k: (counts[k], round(w / math.sqrt(length[k[0]]), 9)) for k, w in raw.items()}
