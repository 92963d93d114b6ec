"""The density hierarchy against its definition on the full matrix of mutual reachability."""

import signal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilerec.operators import cluster, density


def parts_below(w, rows, limit):
    """Connected parts of ``rows`` over pairs of a weight below ``limit``."""
    left, out = set(rows), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            i = todo.pop()
            part.add(i)
            near = [j for j in left if w[i, j] < limit]
            left.difference_update(near)
            todo += near
        out.append(part)
    return out


def tree_weights(w):
    inside, best, out = np.zeros(len(w), bool), w[0].copy(), set()
    inside[0] = True
    for _ in range(len(w) - 1):
        at = int(np.argmin(np.where(inside, np.inf, best)))
        out.add(best[at])
        inside[at] = True
        best = np.minimum(best, w[at])
    return out


def plain_clusters(x, min_size, min_samples):
    """Label sets of the most stable clusters, from the definition."""
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    w = np.maximum(np.round(np.maximum(d, np.maximum(core[:, None], core[None])), 9), 1e-9)
    heights = sorted(tree_weights(w), reverse=True)  # parts change at no other weight

    def grow(rows, birth):
        """(stability, chosen label sets of the inside, whether this node has children)."""
        alive, stable = set(rows), 0.0
        for h in heights:
            parts = parts_below(w, alive, h)
            big = [p for p in parts if len(p) >= min_size]
            gone = alive - set().union(*big) if len(big) == 1 else alive
            stable += len(gone) * (1 / h - birth)
            if len(big) == 1:
                alive = big[0]
                continue
            kids = [(p, *grow(p, 1 / h)) for p in big]
            chosen = []
            for part, own, inner, inner_sets in kids:
                chosen += [part] if not inner_sets or own >= inner else inner_sets
            return stable, sum(max(own, inner) if inner_sets else own for _, own, inner, inner_sets in kids), chosen
        return stable, 0.0, []

    return {frozenset(s) for s in grow(range(len(x)), 0.0)[2]}


def label_sets(df, label="major_cluster"):
    out = {}
    for r in df.collect():
        out.setdefault(r[label], set()).add(int(r["product_id"]))
    return {frozenset(s) for k, s in out.items() if k >= 0}


def table(spark, x):
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "product_id string, reduced array<double>")


def blobs(seed, n, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-8, 8, (5, 2))
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s in zip(centres, (0.3, 0.5, 0.9, 0.4, 1.5))] + [rng.uniform(-12, 12, (n, 2))])
    return np.round(x / grid) * grid if grid else x


@pytest.mark.parametrize("x, min_size, min_samples", [
    (blobs(1, 40), 10, 5), (np.unique(blobs(3, 30, 0.5), axis=0), 6, 3), (blobs(4, 12), 40, 4), (blobs(5, 3)[:2], 2, 1),
])
def test_clusters_equal_the_definition(spark, x, min_size, min_samples):
    assert label_sets(cluster.density_cluster(table(spark, x), min_size, min_samples)) == plain_clusters(x, min_size, min_samples)


@pytest.mark.parametrize("x", [blobs(2, 14), np.unique(blobs(3, 16, 1.0), axis=0)])
def test_many_blocks_and_rounds_give_the_same(spark, x):
    many = cluster.density_cluster(table(spark, x), 4, 3, cell_rows=24, local_edges=0)
    assert label_sets(many) == plain_clusters(x, 4, 3)


def test_parts_on_a_line_fall_out_of_their_cluster_at_once(spark, monkeypatch):
    """Equal distances and names that rise along the line: every part points at the one before it."""
    x = np.concatenate([np.stack([np.full(n, 1e5 * i), np.arange(n)], axis=1) for i, n in enumerate((60, 40, 3))])
    rows = [(f"{i:03d}", v.tolist()) for i, v in enumerate(x)]
    rounds, chains = [], density._chains
    monkeypatch.setattr(density, "_chains", lambda *given: rounds.append(1) or chains(*given))
    df = spark.createDataFrame(rows, "product_id string, reduced array<double>")
    assert label_sets(cluster.density_cluster(df, 4, 2, local_edges=0)) == {frozenset(range(60)), frozenset(range(60, 100))}
    assert len(rounds) <= 4


def test_long_cells_meet_only_where_they_lie_side_by_side(spark):
    """The balls of cells of two long lines always touch, their boxes only do next to each other."""
    x = np.concatenate([np.stack([np.full(200, 1e5 * i), np.arange(200.0)], axis=1) for i in range(2)])
    rows = [(str(c * 5 + i), "0", v.tolist(), 1.0, c, 0) for c in range(80) for i, v in enumerate(x[c * 5 : c * 5 + 5])]
    own = density._own_trees(spark.createDataFrame(rows, "key string, grp string, vec array<double>, core double, cell int, part int"))
    pairs = {(r["cell"], r["other"]) for r in density._pairs(own).collect()}
    assert {(i, i + 40) for i in range(40)} <= pairs and len(pairs) < 500


def test_blocks_far_apart_share_their_shortest_edge():
    rng = np.random.default_rng(5)
    for gap in (0.0, 1.0, 1e3):
        sides = []
        for at, n in ((0.0, 30), (gap, 40)):
            x = np.round(rng.uniform(at, at + 3, (n, 2)))
            frame = pd.DataFrame({"grp": "g", "key": [f"{at}-{i}" for i in range(n)], "vec": list(x), "core": rng.integers(0, 2, n).astype(float)})
            sides.append(frame.assign(top=density._prim(x, frame["core"].to_numpy())[2].max()))
        top = max(s["top"].iloc[0] for s in sides)
        got = density._cross_edges(sides[0].assign(top=top), sides[1])
        whole = density._cross_edges(sides[0].assign(top=np.inf), sides[1])
        edges = [{(min(r.a, r.b), max(r.a, r.b), r.w) for r in e.itertuples()} for e in (got, whole)]
        assert edges[0] == edges[1] and len(edges[0]) >= 1


def test_a_leaf_born_where_it_joins_an_older_one_belongs_to_it():
    """The older leaf comes first and is its own home; the search for the other's home has to end there."""
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(10)
    try:
        home, nodes = density.dendrogram({0: 1.0, 1: 2.0, 2: 1.5}, [(0, 1, 2.0), (1, 2, 3.0)])
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert home == {0: 0, 1: 0, 2: 2}
    assert {k: v[:2] for k, v in nodes.items()} == {0: (("join", 1), 3.0), 2: (("join", 1), 3.0), ("join", 1): (None, np.inf)}


def test_sets_of_blocks_give_the_edges_of_one_forest():
    """Pairs of blocks of two sets are searched together; what leaves are fewer edges than rows, with all of the tree among them."""
    rng = np.random.default_rng(6)
    x, core = np.round(rng.uniform(0, 4, (160, 2)), 1), rng.integers(0, 3, 160) / 4
    block = np.repeat(np.arange(8), 20)
    frame = pd.DataFrame({"grp": "g", "key": [f"{i:03d}" for i in range(160)], "vec": list(x), "core": core})
    left, right = frame[block < 4].assign(cell=block[block < 4], part=0), frame[block >= 4].assign(other=block[block >= 4], other_part=0)
    pairs = pd.DataFrame([("g", i, 0, j, 0, np.inf) for i in range(4) for j in range(4, 8)], columns=["grp", "cell", "part", "other", "other_part", "top"])
    got = density._set_edges(pd.concat([left, pairs]), right)
    assert len(got) < 160
    a, b, w = density._prim(x, core)
    cross = (block[a] < 4) != (block[b] < 4)
    want = {(min(i, j), max(i, j), v) for i, j, v in zip(a[cross], b[cross], w[cross])}
    assert want <= {(min(int(r.a), int(r.b)), max(int(r.a), int(r.b)), r.w) for r in got.itertuples()}


def test_labels_do_not_depend_on_the_partitioning(spark):
    df, before, seen = table(spark, blobs(6, 30)), spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = cluster.density_cluster(df.repartition(parts), 8, 4).collect()
        seen.append(sorted((r["product_id"], r["major_cluster"]) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len({c for _, c in seen[0]}) > 3


def test_copies_count_and_groups_stay_apart(spark):
    x = np.concatenate([blobs(7, 20), np.repeat([[30.0, 30.0]], 12, axis=0), np.repeat([[31.0, 30.0]], 3, axis=0)])
    df = table(spark, x).withColumn("g", (F.col("product_id").cast("int") % 2)).withColumn("_local", F.lit("kept"))
    whole = label_sets(cluster.density_cluster(df, 8, 4))
    assert whole == plain_clusters(x, 8, 4)
    got = cluster.density_cluster(df, 5, 3, group="g")
    assert {r["_local"] for r in got.select("_local").collect()} == {"kept"}
    for g in (0, 1):
        own = np.flatnonzero(np.arange(len(x)) % 2 == g)
        want = {frozenset(int(own[i]) for i in s) for s in plain_clusters(x[own], 5, 3)}
        assert label_sets(got.where(F.col("g") == g)) == want


def test_subclusters_follow_their_rules(spark):
    x = np.concatenate([blobs(8, 25), np.random.default_rng(1).normal(50, 0.1, (6, 2))])
    major = [0] * 100 + [-1] * 50 + [2] * 6
    df = spark.createDataFrame([(str(i), v.tolist(), m, "kept") for i, (v, m) in enumerate(zip(x, major))],
                               "product_id string, reduced array<double>, major_cluster int, _local string")
    rows = cluster.subcluster(df, 10, 5).collect()
    assert len(rows) == len(x) and all(r["_local"] == "kept" for r in rows)
    by = {int(r["product_id"]): r["sub_cluster"] for r in rows}
    assert {by[i] for i in range(100, 150)} == {-1} and len({by[i] for i in range(150, 156)}) == 1
    inside = plain_clusters(x[:100], 10, 5)
    sets = {}
    for i in range(100):
        sets.setdefault(by[i], set()).add(i)
    left = set(range(100)) - set().union(*inside)
    assert {frozenset(s) for s in sets.values()} == inside | ({frozenset(left)} if left else set())
    assert sorted(set(by.values()) - {-1}) == list(range(len(sets) + 1))
