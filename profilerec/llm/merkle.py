"""A Merkle manifest of a dataset: row leaves, a tree per group, a root over all groups, and folds.

``H`` is the lowercase hex SHA-256 of the concatenated inputs, digests as hex text. A leaf is ``H`` of the
row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a group
ascend by key; every ``fanout`` consecutive nodes become their ``H`` until one is left, the subroot. The
subroots, in the order of the groups, give the root the same way.

A parent keeps a copy of the hash state before each child slot, so that a changed child is folded from
the state of its slot on, with the replacement and the siblings to its right alone.

Rows are numbered by a range partition, and nodes by division, so no group has to meet in one task: a task
folds at most ``fanout ** block_levels`` leaves of one group, together with the one path of nodes above
them, which all of these leaves share.

Defined results: null groups come first, null keys come first within a group, rows that share a key are
ordered by leaf, equal rows are separate leaves with one digest. Empty tables have no rows and no root.
Other columns of the documents are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilerec.session import StepTables

#: Columns of a leaf of ``documents``, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class ManifestOptions:
    """``fanout ** block_levels`` leaves meet in one task."""

    fanout: int = 16
    block_levels: int = 3

    @property
    def block(self) -> int:
        return self.fanout**self.block_levels


def leaf_digest(*values: Column) -> Column:
    """``H`` of one row's values."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


class Parent:
    """The hash of a run of children, with the state before each of its slots."""

    def __init__(self, children: Sequence[bytes]):
        self.children = children
        state = hashlib.sha256()
        self.before = []
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``: the children before it are not hashed again."""
        state = self.before[slot].copy()
        state.update(replacement)
        state.update(b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join([*self.children[:slot], *self.children[slot + 1 :]])


def levels(nodes: list[bytes], fanout: int, most: int | None = None) -> list[list[Parent]]:
    """Parents level by level, ``most`` levels exactly if given, else until one node is left."""
    out = []
    while len(out) < most if most is not None else len(nodes) > 1:
        row = [Parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(row)
        nodes = [p.digest for p in row]
    return out


def fold_path(digest: bytes, path: Sequence[tuple[Parent, int]]) -> bytes:
    for parent, slot in path:
        digest = parent.fold(slot, digest)
    return digest


def _placed(steps: StepTables, rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``at``, the position within ``tree``, and ``size``, the rows of the tree.

    ``rows`` are range partitioned by tree and ``order`` and written once; each task numbers its own rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "tree", *[F.col(c).asc_nulls_first() for c in order])
    table = steps.write(ranged.withColumn("part", F.spark_partition_id()), f"{name}-ranged")
    per_tree = W.partitionBy("tree")
    counts = table.groupBy("tree", "part").agg(F.count("*").alias("n")).select(
        "tree", "part", F.sum("n").over(per_tree).alias("size"),
        F.coalesce(F.sum("n").over(per_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"),
    )
    local = F.row_number().over(W.partitionBy("tree", "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    numbered = table.withColumn("local", local).join(counts, ["tree", "part"])
    return numbered.withColumn("at", F.col("skip") + F.col("local")).drop("part", "local", "skip")


class _Forest:
    """The families above given nodes (tree, at, digest, size) as tables, one per level, and the tops."""

    def __init__(self, steps: StepTables, nodes: DataFrame, fanout: int, name: str):
        self.fanout, self.families, self.tops = fanout, [], []
        level = 0
        while True:
            self.tops.append(nodes.where("size = 1").select("tree", "digest"))
            nodes = nodes.where("size > 1")
            if nodes.isEmpty():
                return
            grouped = nodes.groupBy("tree", "size", F.floor(F.col("at") / fanout).cast("long").alias("parent")).agg(
                F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c")
            )
            family = steps.write(grouped.select("tree", "size", "parent", F.col("c.digest").alias("children")), f"{name}-{level}")
            self.families.append(family)
            nodes = family.select(
                "tree", F.col("parent").alias("at"), F.sha2(F.array_join("children", ""), 256).alias("digest"),
                F.ceil(F.col("size") / fanout).cast("long").alias("size"),
            )
            level += 1

    def roots(self) -> DataFrame:
        """(tree, digest) of all trees."""
        out = self.tops[0]
        for more in self.tops[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, above: DataFrame, *carry: str) -> DataFrame:
        """(tree, at, path, carry) of the given nodes; ``path`` holds (slot, children) from the node up.

        ``above`` has (tree, path, carry) of the trees' own roots. Paths go down by one join of unique
        keys per level, so no node is asked for by all that lie below it.
        """
        now = None
        for family, top in zip([*self.families[::-1], None], self.tops[::-1]):
            starts = top.select("tree").join(above, "tree").withColumn("at", F.lit(0).cast("long"))
            now = starts if now is None else now.unionByName(starts)
            if family is None:
                return now
            slots = F.posexplode("children").alias("slot", "child")
            runs = family.select("tree", F.col("parent").alias("at"), "children")
            down = now.join(runs, ["tree", "at"]).select("tree", "at", "path", *carry, "children", slots)
            # Trees whose top lies below this level join in at a later step.
            now = down.select(
                "tree", (F.col("at") * self.fanout + F.col("slot")).alias("at"),
                F.concat(F.array(F.struct(F.col("slot").cast("int").alias("slot"), "children")), "path").alias("path"), *carry,
            )


_PATH = "array<struct<slot:int,children:array<string>>>"


class Manifest:
    """The trees over documents, kept as tables in the shared folder until :meth:`drop`.

    ``changed`` gives the leaf that a row has now, null where it is unchanged; :meth:`verify` folds it.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", group: str = "source", columns: Sequence[str] = LEAF_COLUMNS,
                 changed: Column | None = None, options: ManifestOptions | None = None):
        self.options = options or ManifestOptions()
        spark, self.steps = docs.sparkSession, StepTables(docs.sparkSession, "manifest")
        self.key, self.kind = key, docs.schema[key].dataType
        name = F.col(f"`{group}`").cast("string")
        rows = docs.select(
            F.coalesce(F.concat(F.lit("v"), name), F.lit("")).alias("tree"), F.col(f"`{key}`").alias("row_key"),
            leaf_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"),
            (F.lit(None) if changed is None else changed).cast("string").alias("changed"),
        )
        hashed = self.steps.write(rows, "hashed")
        block = F.floor(F.col("at") / self.options.block).cast("long")
        placed = _placed(self.steps, hashed, ["row_key", "leaf"], "leaves").withColumn("block", block)
        self.leaves = self.steps.write(placed.withColumn("row_key", F.col("row_key").cast("string")), "leaves")
        self.steps.drop("hashed", "leaves-ranged")
        tops = self.leaves.select("tree", "block", "at", "size", "leaf").groupBy("tree", "block").applyInPandas(
            self._block_top(), "tree string, at bigint, size bigint, digest string"
        )
        self.groups = _Forest(self.steps, self.steps.write(tops, "blocks"), self.options.fanout, "groups")
        self.subroots = self.steps.write(self.groups.roots(), "subroots")
        named = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.order = self.steps.write(_placed(self.steps, named, ["name"], "order"), "order")
        self.union = _Forest(self.steps, self.order.select("tree", "at", "digest", "size"), self.options.fanout, "union")
        top = self.union.roots().select("digest").first()
        #: Hex digest of the whole dataset; None if it has no rows.
        self.root = top and top["digest"]
        self.spark = spark

    def _block_top(self):
        options = self.options

        def top(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("at")
            size = int(part["size"].iloc[0])
            nodes = [x.encode() for x in part["leaf"]]
            above = levels(nodes, options.fanout, options.block_levels if size > options.block else None)
            digest = (above[-1][0].digest if above else nodes[0]).decode()
            return pd.DataFrame({"tree": part["tree"].iloc[:1], "at": part["block"].iloc[:1], "size": -(-size // options.block), "digest": digest})

        return top

    def group_roots(self) -> DataFrame:
        """(group, subroot) of every group."""
        return self.subroots.select(F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("group"), F.col("digest").alias("subroot"))

    def block_paths(self) -> DataFrame:
        """(tree, at, path, subroot): the families above every block of leaves, from the block to the root."""
        start = self.spark.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"))
        over = self.union.paths(start).join(self.order.select("tree", "at", "name"), ["tree", "at"])
        above = over.select(F.col("name").alias("tree"), "path").join(self.subroots.select("tree", F.col("digest").alias("subroot")), "tree")
        return self.groups.paths(above, "subroot")

    def verify(self) -> DataFrame:
        """(key, leaf, subroot, root, proof_sha256, folded_root, verified, slots, n_siblings) of every row.

        ``proof_sha256`` is ``H`` of all siblings, level by level up to the root and from left to right;
        ``folded_root`` is folded from the changed leaf, or else the original one, and the siblings.
        """
        root, options = self.root, self.options
        paths = self.block_paths().select(
            "tree", F.col("at").alias("block"), "subroot", F.col("path.slot").alias("path_slots"), F.col("path.children").alias("path_children")
        )

        def fold(leaves: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
            leaves, path = leaves.sort_values("at"), paths.iloc[0]
            upper = [(Parent([c.encode() for c in run]), int(s)) for s, run in zip(path["path_slots"], path["path_children"])]
            upper_siblings = b"".join(parent.siblings(slot) for parent, slot in upper)
            nodes = [x.encode() for x in leaves["leaf"]]
            lower = levels(nodes, options.fanout, options.block_levels if leaves["size"].iloc[0] > options.block else None)
            out = []
            for i, (key, leaf, new) in enumerate(zip(leaves["row_key"], leaves["leaf"], leaves["changed"])):
                at, way = i, []
                for row in lower:
                    way.append((row[at // options.fanout], at % options.fanout))
                    at //= options.fanout
                proof = hashlib.sha256(b"".join(parent.siblings(slot) for parent, slot in way) + upper_siblings).hexdigest()
                way += upper
                folded = fold_path((new if isinstance(new, str) else leaf).encode(), way).decode()
                count = sum(len(parent.children) - 1 for parent, _ in way)
                out.append((key, leaf, path["subroot"], proof, folded, [slot for _, slot in way], count))
            return pd.DataFrame(out, columns=["row_key", "leaf", "subroot", "proof_sha256", "folded_root", "slots", "n_siblings"])

        schema = "row_key string, leaf string, subroot string, proof_sha256 string, folded_root string, slots array<int>, n_siblings long"
        keys = ["tree", "block"]
        folded = self.leaves.groupBy(*keys).cogroup(paths.groupBy(*keys)).applyInPandas(fold, schema)
        return folded.select(
            F.col("row_key").cast(self.kind).alias(self.key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == F.lit(root)).alias("verified"), "slots", "n_siblings",
        )
