"""Product clusters: K-Means, density clusters, sub-clusters and quality scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.operators import density
from profilerec.operators.blocks import (
    BLOCK_BYTES, BLOCK_ROWS, MOST_CHUNKS, block_pairs, chunks, distances, euclidean, merge_best, wanted_pairs)
from profilerec.operators.ordering import free_names, global_row_index, head_per_group
from profilerec.operators.rfm import kmeans
from profilerec.session import StepTables, cut_lineage

NOISE = -1
#: Pairs of a row and a cell that a task holds at once when it looks for cells in reach.
REACH_PAIRS = 1 << 18
#: Rows of a part of a cell, of which two meet in one matrix.
PART_ROWS = 4096


def kmeans_clusters(df: DataFrame, k: int | None = None, max_k: int = 166, vector: str = "reduced",
                    cluster: str = "major_cluster", seed: int = 42, n_init: int = 10) -> DataFrame:
    """Adds ``cluster``; without ``k`` one cluster per 80 rows, at least 8 and at most ``max_k``."""
    n = df.count()
    k = k or min(max_k, max(8, n // 80))
    rows = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model, _cost = kmeans(rows, k, "_features", seed, n_init, cluster=cluster)
    return model.transform(rows).drop("_features")


def _squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, centre) without noise."""
    return df.where(F.col(cluster) >= 0).groupBy(cluster).agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("centre"),
    )


def silhouette(df: DataFrame, key: str = "product_id", cluster: str = "major_cluster", vector: str = "reduced") -> DataFrame:
    """(key, cluster, silhouette) with Euclidean distances, without noise.

    Distances are summed per point and cluster inside pairs of blocks; pairs never leave a task.
    """
    points = cut_lineage(df.where(F.col(cluster) >= 0).select(
        F.col(key).cast("string").alias("key"), F.col(cluster).cast("int").alias("own"),
        F.col(vector).cast("array<double>").alias("vec"),
    ))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["key", "own", "other", "total", "n"])
        d = distances(a["vec"], b["vec"])
        names, member = np.unique(b["own"].to_numpy(), return_inverse=True)
        onehot = np.eye(len(names))[member]
        total, n = d @ onehot, onehot.sum(axis=0)
        return pd.DataFrame({
            "key": np.repeat(a["key"].to_numpy(), len(names)), "own": np.repeat(a["own"].to_numpy(), len(names)),
            "other": np.tile(names, len(a)), "total": total.ravel(), "n": np.tile(n, len(a)),
        })

    def together(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby(["key", "own", "other"], as_index=False, sort=False, dropna=False)[["total", "n"]].sum()

    parts = block_pairs(points, points, "key", "key", sums, "key string, own int, other int, total double, n double", combine=together)
    per_cluster = parts.groupBy("key", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    a = F.sum(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    b = F.min(F.when(~same, F.col("total") / F.col("n")))
    scored = per_cluster.groupBy("key", "own").agg(a.alias("a"), b.alias("b"))
    value = F.when(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.greatest("a", "b") > 0),
        (F.col("b") - F.col("a")) / F.greatest("a", "b"),
    ).otherwise(0.0)
    return scored.select(F.col("key").alias(key), F.col("own").alias(cluster), value.alias("silhouette"))


def squared_silhouette(df: DataFrame, key: str = "product_id", cluster: str = "major_cluster", vector: str = "reduced") -> DataFrame:
    """Silhouette with squared distances from cluster moments; rows times clusters, not rows times rows.

    The mean squared distance from x to a cluster is |x - centre|^2 plus the cluster's mean squared
    spread, so one row per cluster stands for its points.
    """
    points = cut_lineage(df.where(F.col(cluster) >= 0).select(
        F.col(key).cast("string").alias("key"), F.col(cluster).cast("int").alias("own"),
        F.col(vector).cast("array<double>").alias("vec"),
    ))
    moments = cut_lineage(_dispersion(points, "own", "vec").select(
        F.col("own").alias("other"), "n", F.col("centre"), (F.col("within") / F.col("n")).alias("spread")
    ))

    def means(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["key", "own", "mine", "n", "nearest"])
        d = distances(a["vec"], b["centre"]) ** 2 + b["spread"].to_numpy()[None, :]
        same = a["own"].to_numpy()[:, None] == b["other"].to_numpy()[None, :]
        mine = np.where(same.any(axis=1), np.where(same, d, 0.0).sum(axis=1), np.nan)
        size = np.where(same, b["n"].to_numpy()[None, :], 0.0).sum(axis=1)
        nearest = np.where(same, np.inf, d).min(axis=1)
        return pd.DataFrame({"key": a["key"], "own": a["own"], "mine": mine, "n": size, "nearest": nearest})

    parts = block_pairs(points, moments, "key", "other", means, "key string, own int, mine double, n double, nearest double")
    scored = parts.groupBy("key", "own").agg(
        F.max(F.nanvl("mine", F.lit(None).cast("double"))).alias("mine"), F.max("n").alias("n"), F.min("nearest").alias("b")
    ).withColumn("a", F.when(F.col("n") > 1, F.col("mine") * F.col("n") / (F.col("n") - 1)))
    value = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return scored.select(
        F.col("key").alias(key), F.col("own").alias(cluster),
        F.when(F.col("a").isNotNull(), value).otherwise(0.0).alias("silhouette"),
    )


def _dispersion(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Per cluster: size, centre, sum of squared and mean plain distances to the centre."""
    centre = centroids(df, cluster, vector)
    squared = _squared(F.col(vector).cast("array<double>"), F.col("centre"))
    within = df.select(cluster, vector).join(centre, cluster).groupBy(cluster).agg(
        F.sum(squared).alias("within"), F.avg(F.sqrt(squared)).alias("scatter")
    )
    return centre.join(within, cluster)


def calinski_harabasz(df: DataFrame, cluster: str = "major_cluster", vector: str = "reduced") -> DataFrame:
    """One row: between over within dispersion; 0 with fewer than two clusters."""
    table = _dispersion(df, cluster, vector)
    points = array_to_vector("centre")
    grand = vector_to_array(Summarizer.mean(points, F.col("n").cast("double")))
    overall = table.agg(grand.alias("g")).scalar()
    sums = table.withColumn("overall", overall).agg(
        F.sum(F.col("n") * _squared(F.col("centre"), F.col("overall"))).alias("between"), F.sum("within").alias("within"),
        F.count("*").alias("k"), F.sum("n").alias("n"),
    )
    value = F.when(
        (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0),
        (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))),
    ).otherwise(0.0)
    return sums.select(value.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, cluster: str = "major_cluster", vector: str = "reduced") -> DataFrame:
    """One row: mean over clusters of the worst (scatter + scatter) / centre distance."""
    table = cut_lineage(_dispersion(df, cluster, vector).select(
        F.col(cluster).cast("int").alias("key"), F.col("centre").alias("vec"), "scatter"
    ))

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["key", "ratio"])
        d = distances(a["vec"], b["vec"])
        same = a["key"].to_numpy()[:, None] == b["key"].to_numpy()[None, :]
        spread = a["scatter"].to_numpy()[:, None] + b["scatter"].to_numpy()[None, :]
        ratio = np.where(same | (d == 0), 0.0, spread / np.where(d == 0, 1.0, d))
        return pd.DataFrame({"key": a["key"], "ratio": ratio.max(axis=1)})

    ratios = block_pairs(table, table, "key", "key", worst, "key int, ratio double").groupBy("key").agg(F.max("ratio").alias("r"))
    return ratios.agg(F.when(F.count("*") > 1, F.avg("r")).otherwise(0.0).alias("davies_bouldin"))


def cluster_counts(df: DataFrame, cluster: str = "major_cluster") -> DataFrame:
    c = F.col(cluster)
    return df.agg(F.countDistinct(F.when(c >= 0, c)).alias("n_clusters"), F.count_if(c == NOISE).alias("n_noise"))


def score_clustering(df: DataFrame, key: str = "product_id", cluster: str = "major_cluster", vector: str = "reduced",
                     exact: bool = True) -> dict[str, float]:
    """Counts and the three quality scores of one clustering; scores are 0 with fewer than two clusters."""
    counts = cluster_counts(df, cluster).first()
    out = {"n_clusters": counts["n_clusters"], "n_noise": counts["n_noise"]}
    if counts["n_clusters"] < 2:
        return {**out, "silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": 0.0}
    per_point = (silhouette if exact else squared_silhouette)(df, key, cluster, vector)
    return {
        **out,
        "silhouette": per_point.agg(F.avg("silhouette")).first()[0],
        "calinski_harabasz": calinski_harabasz(df, cluster, vector).first()[0],
        "davies_bouldin": davies_bouldin(df, cluster, vector).first()[0],
    }


def best_trial(trials: DataFrame) -> DataFrame:
    """Best parameters: silhouette, then Calinski-Harabasz, then lowest Davies-Bouldin."""
    return trials.orderBy(
        F.desc("silhouette"), F.desc("calinski_harabasz"), "davies_bouldin", "min_cluster_size", "min_samples"
    ).limit(1)


def _nearest(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """k nearest rows of the same tile; both sides are keyed by ``tile`` and hold at most a tile each."""
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["key", "other", "distance"])
        d = distances(a["vec"], b["at_vec"])
        np.round(d, 9, out=d)
        names = pd.factorize(np.concatenate([a["key"].to_numpy(object), b["at_key"].to_numpy(object)]))[0]
        np.copyto(d, np.inf, where=names[: len(a), None] == names[len(a) :])
        n = min(k, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        row = np.repeat(np.arange(len(a)), n)
        found = d[row, near.ravel()]
        ok = np.isfinite(found)
        return pd.DataFrame({
            "key": a["key"].to_numpy()[row][ok], "other": b["at_key"].to_numpy()[near.ravel()][ok], "distance": found[ok]
        })

    keys = ["tile", "part", "other_part"]
    renamed = targets.select(*[F.col(c).alias(f"at_{c}") for c in ("key", "vec", *keys)])
    return points.groupBy(*keys).cogroup(renamed.groupBy(*[f"at_{c}" for c in keys])).applyInPandas(
        search, "key string, other string, distance double"
    )


def knn(points: DataFrame, k: int, group: str | None = None, cell_rows: int = 4096, seed: int = 42) -> DataFrame:
    """(key, other, distance): the exact k nearest rows of each row, within its ``group`` if given.

    ``points`` has key and vec. Rows are put into K-Means cells. A first search in the own cell
    bounds the k-th distance; further cells are searched only when their ball can reach that bound.
    Large cells are cut into parts, so no task holds more than two parts.
    """
    points = points.select("key", "vec", (F.col(group) if group else F.lit(0)).cast("string").alias("grp"))
    n = points.count()
    n_cells = max(1, math.ceil(n / cell_rows))
    if n_cells == 1:
        celled, centres = points.withColumn("cell", F.lit(0)), None
    else:
        rows = points.withColumn("_v", array_to_vector("vec"))
        model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="_v", predictionCol="cell").fit(rows)
        celled, centres = model.transform(rows).drop("_v"), np.array(model.clusterCenters())
    celled = cut_lineage(celled.withColumn("tile", F.concat_ws("/", "grp", F.col("cell").cast("string"))))
    parts = celled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(max(cell_rows, PART_ROWS))).cast("int").alias("n_parts"))
    sized = celled.join(parts, "tile")
    own_part = F.pmod(F.xxhash64("key"), F.col("n_parts")).cast("int")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))
    targets = sized.withColumn("other_part", own_part).withColumn("part", all_parts).select(
        "tile", "part", "other_part", "key", "vec")
    queries = sized.withColumn("part", own_part).withColumn("other_part", all_parts).select(
        "tile", "part", "other_part", "key", "vec")
    near = _nearest(queries, targets, k)
    best = head_per_group(near, ["key"], ["distance", "other"], k)
    if centres is None:
        return best.select("key", "other", "distance")
    best = cut_lineage(best)
    found = best.select("key", "other", "distance").unionByName(_nearest_far(celled, best, centres, k, n))
    return head_per_group(found, ["key"], ["distance", "other"], k).select("key", "other", "distance")


def _nearest_far(celled: DataFrame, best: DataFrame, centres: np.ndarray, k: int, n: int) -> DataFrame:
    """Rows of other cells that may be among the ``k`` nearest of a row, whose own cell gave ``best``.

    Cells lie in blocks of many rows. A row is sent once to every block that holds a cell in its reach, not once per
    cell, and a block once to every block with rows that ask it; of each pair of blocks only the best rows leave a task.
    """
    n_cells, dims = centres.shape
    radius_rows = celled.mapInPandas(
        lambda batches: (
            pd.DataFrame({"cell": b["cell"], "r": np.linalg.norm(np.vstack(b["vec"].to_numpy()) - centres[b["cell"]], axis=1)})
            for b in batches if len(b)
        ), "cell int, r double",
    ).groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect()
    radius, count = np.zeros(n_cells), np.zeros(n_cells)
    for row in radius_rows:
        radius[row["cell"]], count[row["cell"]] = row["r"], row["n"]
    most_rows = BLOCK_ROWS * min(MOST_CHUNKS // 2, max(1, BLOCK_BYTES // (8 * dims) // BLOCK_ROWS))
    n_blocks = max(math.ceil(n / most_rows), min(math.ceil(n / BLOCK_ROWS), math.ceil(math.sqrt(wanted_pairs(celled)))))
    rows = math.ceil(n / n_blocks)
    # Cells that follow each other in a block lie near each other along the direction in which centres differ most.
    spread = centres - centres.mean(axis=0)
    order = np.argsort(spread @ np.linalg.eigh(spread.T @ spread)[1][:, -1], kind="stable")
    block = np.zeros(n_cells, np.int64)
    block[order] = np.r_[0, np.cumsum(count[order])[:-1]] // rows
    block = np.unique(block, return_inverse=True)[1]
    bounds = np.searchsorted(block[order], np.arange(block.max() + 1))
    lengths = (centres * centres).sum(1)[None, :]
    # Where bounds are wide a row reaches every cell, so rows are taken a slice at a time.
    step = max(1, REACH_PAIRS // n_cells)

    def in_reach(x: np.ndarray, limit: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + lengths[:, cells] - 2 * x @ centres[cells].T, 0))
        return (d - radius[None, cells] <= limit[:, None] + 1e-6) & (cell[:, None] != cells[None, :])

    def asking(batches):
        for b in (batch.iloc[low : low + step] for batch in batches for low in range(0, len(batch), step)):
            hit = in_reach(np.vstack(b["vec"].to_numpy()), b["bound"].fillna(np.inf).to_numpy(), b["cell"].to_numpy(), order)
            r, c = np.nonzero(np.logical_or.reduceat(hit, bounds, axis=1))
            yield b.iloc[r].assign(tile=c)

    # A block of cells holds about ``rows`` rows; a large cell makes a larger one, which is cut into parts.
    home = F.pandas_udf(lambda cell: pd.Series(block[cell]), "int")
    homes = celled.withColumn("home", home("cell"))
    sizes = homes.groupBy("grp", "home").agg(F.ceil(F.count("*") / F.lit(most_rows)).cast("int").alias("n_parts"))
    placed = cut_lineage(homes.join(sizes, ["grp", "home"]).withColumn("home_part", F.pmod(F.xxhash64("key"), F.col("n_parts")).cast("int")).drop("n_parts"))
    bound = best.where(F.col("rank") == k).select("key", F.col("distance").alias("bound"))
    asked_by = placed.join(bound, "key", "left").select("key", "vec", "grp", "cell", "bound", "home", "home_part")
    kinds = "key string, vec array<double>, grp string, cell int, bound double, home int, home_part int, tile int"
    queries = asked_by.mapInPandas(asking, kinds).join(sizes.withColumnRenamed("home", "tile"), ["grp", "tile"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
    keys = ["grp", "tile", "part", "home", "home_part"]
    asked = cut_lineage(queries.select(*keys).distinct())
    targets = placed.select("grp", F.col("home").alias("tile"), F.col("home_part").alias("part"), "key", "vec", "cell").join(asked, ["grp", "tile", "part"])
    targets = targets.select(*[F.col(c).alias(f"at_{c}") for c in (*keys, "key", "vec", "cell")])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["key", "other", "distance"])
        place = np.empty(n_cells, np.int64)
        place[order] = np.arange(n_cells)
        b = b.iloc[np.argsort(place[b["at_cell"].to_numpy()], kind="stable")]
        y, cell = np.vstack(b["at_vec"].to_numpy()).astype(float), b["at_cell"].to_numpy()
        names = pd.factorize(np.concatenate([a["key"].to_numpy(object), b["at_key"].to_numpy(object)]), sort=True)[0]
        mine, theirs = names[: len(a)], names[len(a) :]
        key_of, out = np.argsort(np.argsort(theirs, kind="stable"), kind="stable"), []
        by_key = b["at_key"].to_numpy()[np.argsort(theirs, kind="stable")]
        for low, high in chunks(len(a), BLOCK_ROWS):
            part = a.iloc[low:high]
            x, limit = np.vstack(part["vec"].to_numpy()).astype(float), part["bound"].fillna(np.inf).to_numpy().copy()
            best_of = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros((0, 0)))
            for start, end in chunks(len(b), BLOCK_ROWS // 4):
                here = np.unique(cell[start:end])
                reach = np.flatnonzero(in_reach(x, limit, part["cell"].to_numpy(), here).any(axis=1))
                d = euclidean(x[reach], y[start:end])
                np.round(d, 9, out=d)
                ok = (d <= limit[reach, None]) & (mine[low:high][reach, None] != theirs[None, start:end])
                ok &= part["cell"].to_numpy()[reach, None] != cell[None, start:end]
                r, c = np.nonzero(ok)
                if len(r):
                    more = (reach[r], key_of[start + c], -d[r, c], np.zeros((len(r), 0)))
                    best_of, kth = merge_best(best_of, more, k, len(x))
                    limit = np.minimum(limit, -kth)
            row, column, score, _ = best_of
            out.append(pd.DataFrame({"key": part["key"].to_numpy()[row], "other": by_key[column], "distance": -score}))
        return pd.concat(out, ignore_index=True)

    return queries.groupBy(*keys).cogroup(targets.groupBy(*[f"at_{c}" for c in keys])).applyInPandas(
        search, "key string, other string, distance double")


class DensityHierarchy:
    """Spanning trees of the mutual reachability of ``df``, from which clusters of any size bound are read.

    Equal vectors are merged and counted first. With ``group``, every group has a tree of its own. One search
    for the neighbours of the largest ``min_samples`` serves all smaller ones; a tree is built once for each.
    """

    def __init__(self, df: DataFrame, min_samples: int | Sequence[int], key: str = "product_id", vector: str = "reduced",
                 group: str | None = None, cell_rows: int = density.CELL_ROWS, local_edges: int = density.LOCAL_EDGES):
        samples = [min_samples] if isinstance(min_samples, int) else list(min_samples)
        self.cell_rows, self.local_edges, self.columns = cell_rows, local_edges, df.columns
        self.steps = StepTables(df.sparkSession, "density")
        vec = F.transform(F.col(vector).cast("array<double>"), lambda x: F.round(x, 12))
        grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("0")
        self.rows = df.select(F.struct("*").alias("row"), vec.alias("vec"), grp.alias("grp"), F.col(key).cast("string").alias("key"))
        merged = self.rows.groupBy("grp", "vec").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
        # Keys need not be unique: a vector of its own has a name of its own.
        named = merged.withColumn("key", F.concat_ws("/", "key", F.md5(F.concat_ws("/", F.to_json("vec"), "grp"))))
        self.reps = self.steps.write(named, "reps")
        self.near = self.steps.write(knn(self.reps, max(samples), "grp"), "near")
        self._trees: dict[int, tuple[DataFrame, DataFrame]] = {}

    def tree(self, min_samples: int) -> tuple[DataFrame, DataFrame]:
        """(rows with core distance, edges of the spanning trees)."""
        if min_samples not in self._trees:
            core = _core_distances(self.near, self.reps, min_samples)
            points = self.steps.write(self.reps.join(core, "key"), f"points-{min_samples}")
            self._trees[min_samples] = points, density.spanning_tree(points, self.cell_rows)
        return self._trees[min_samples]

    def clusters(self, min_cluster_size: int, min_samples: int, cluster: str = "major_cluster") -> DataFrame:
        """All rows with ``cluster``: numbers in the order of groups and smallest keys, -1 for noise."""
        points, edges = self.tree(min_samples)
        found = density.clusters(points, edges, min_cluster_size, self.local_edges).where("no >= 0")
        found = cut_lineage(found.join(self.reps.select("grp", "key", "vec"), ["grp", "key"]))
        first = found.groupBy("grp", "no").agg(F.min("key").alias("first"))
        numbers = global_row_index(first, ["grp", "first"], "number").select("grp", "no", F.col("number").cast("int"))
        by_vector = found.join(numbers, ["grp", "no"]).select("grp", "vec", "number")
        kept = [F.col("row")[c].alias(c) for c in self.columns if c != cluster]
        return self.rows.join(by_vector, ["grp", "vec"], "left").select(*kept, F.coalesce("number", F.lit(NOISE)).alias(cluster))


def density_cluster(df: DataFrame, min_cluster_size: int = 50, min_samples: int = 50, key: str = "product_id",
                    vector: str = "reduced", group: str | None = None, cluster: str = "major_cluster", **options) -> DataFrame:
    """Adds ``cluster``: the most stable density clusters of the full hierarchy, -1 for noise.

    With ``group``, every group is clustered on its own, and numbers run over all of them. A group whose
    rows never part into two clusters is noise as a whole.
    """
    return DensityHierarchy(df, min_samples, key, vector, group, **options).clusters(min_cluster_size, min_samples, cluster)


def _core_distances(near: DataFrame, reps: DataFrame, min_samples: int) -> DataFrame:
    """(key, core): distance at which a row has ``min_samples`` neighbours, copies counted.

    A row with fewer neighbours takes the farthest of them, one without any takes 0.
    """
    reached = near.join(reps.select(F.col("key").alias("other"), F.col("copies").alias("other_copies")), "other").join(
        reps.select("key", "copies"), "key")
    so_far = W.partitionBy("key").orderBy("distance", "other").rowsBetween(W.unboundedPreceding, 0)
    counted = reached.withColumn("have", F.sum("other_copies").over(so_far) + F.col("copies") - 1)
    enough = counted.groupBy("key").agg(
        F.min(F.when(F.col("have") >= min_samples, F.col("distance"))).alias("at"), F.max("distance").alias("last"),
        F.max("copies").alias("copies"))
    core = F.when(F.col("copies") - 1 >= min_samples, 0.0).otherwise(F.coalesce("at", "last"))
    return reps.select("key").join(enough.select("key", core.alias("core")), "key", "left").fillna(0.0, ["core"])


def grid_search(df: DataFrame, sizes=(50, 100, 150, 200), samples=(50, 100), key: str = "product_id",
                vector: str = "reduced", exact: bool = True) -> DataFrame:
    """One row of counts and scores per parameter pair, from one neighbour search and one tree per ``samples``."""
    hierarchy, trials = DensityHierarchy(df.select(key, vector), samples, key, vector), []
    for size in sizes:
        for sample in samples:
            labelled = cut_lineage(hierarchy.clusters(size, sample))
            scores = score_clustering(labelled, key, "major_cluster", vector, exact)
            trials.append((size, sample, *[float(v) for v in scores.values()]))
    fields = "min_cluster_size int, min_samples int, n_clusters double, n_noise double, silhouette double, " \
             "calinski_harabasz double, davies_bouldin double"
    return df.sparkSession.createDataFrame(trials, fields)


def subcluster(df: DataFrame, min_cluster_size: int = 10, min_samples: int = 5, key: str = "product_id",
               vector: str = "reduced", major: str = "major_cluster", **options) -> DataFrame:
    """Adds ``sub_cluster``: density clusters inside each major cluster, numbered over all of them.

    A major cluster below ``min_cluster_size`` rows, or without any density cluster, is one
    sub-cluster; rows left over in the others share one more. Noise stays -1.
    """
    local, last, number = free_names(df.columns, "local", "last", "number")
    inside = df.where(F.col(major) >= 0)
    found = cut_lineage(density_cluster(inside, min_cluster_size, min_samples, key, vector, major, local, **options))
    kinds = found.select(major, local).distinct().withColumn(last, F.col(local) == NOISE)
    numbers = global_row_index(kinds, [major, last, local], number).select(major, local, F.col(number).cast("int").alias("sub_cluster"))
    columns = [c for c in df.columns if c != "sub_cluster"]
    named = found.select(*columns, local).join(numbers, [major, local])
    noise = df.where(F.col(major) < 0).withColumn("sub_cluster", F.lit(NOISE))
    return named.select(*columns, "sub_cluster").unionByName(noise.select(*columns, "sub_cluster"))
