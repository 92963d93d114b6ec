"""Exact similarity join on word shingles by blocked sparse products, and the classes it links.

1. Equal sets become one class, by a fingerprint of the set. A class can only link if the share of
   its shingles that occur in other sets reaches the least similarity; the others drop out, and so
   do shingles of one set.
2. With rare shingles first, a set can only link to a set that shares a shingle of its prefix, whose
   length follows from its size. Classes that share one are candidates.
3. Rows of the class by shingle incidence matrix, grouped by candidate component and by size, are
   multiplied block by block; overlap counts below the bound that the two sizes imply are discarded.
4. Links join classes into components. Each block reports a spanning forest of its links and their
   number, never the pairs themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.llm import exchange, tokens
from profilerec.llm.components import connected_components
from profilerec.llm.lm import gather_blocks
from profilerec.session import StepTables


@dataclass(frozen=True)
class JaccardOptions:
    """Sets link when ``100 * intersection >= percent * union``; ``block`` rows make a block of the product.

    ``block_bytes`` of text are one unit of work. Keys that only count in how many sets a shingle
    occurs have ``spare_bits`` more than the logarithm of the bytes of all texts: two that meet
    cost work, not results.
    """

    words: int = 4
    percent: int = 85
    block: int = 1024
    block_bytes: int = 8 << 20
    spare_bits: int = 10

    def least_overlap(self, a, b):
        """Smallest intersection of linked sets of sizes ``a`` and ``b``."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least_shared(self, n):
        """A linked set shares at least so many of its ``n`` shingles."""
        return -(-self.percent * n // 100)


#: Texts that are sorted together; a shingle keeps the bits that their number leaves.
TOGETHER = 1024
#: Components of at most this part of a block are multiplied together with others, a block's worth at a time.
SMALL = 16
PRINTS, SHINGLES = 0, 1


def _sets(data, offsets, powers, options):
    """(shingle, text number) of the distinct shingles of each text, in order; set sizes; fingerprints."""
    shingles, owners, sizes, prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
    for low in range(0, len(offsets) - 1, TOGETHER):
        cut = offsets[low : low + TOGETHER + 1]
        n = len(cut) - 1
        word, text = tokens.words(data[cut[0] : cut[-1]], cut - cut[0], powers)
        h, own = tokens.shingles(word, text, n, options.words)
        # One sort of one number: the text, then its shingle without the last 10 bits.
        key = np.sort((own.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        h, own = key & np.uint64((1 << 54) - 1), (key >> np.uint64(54)).astype(np.int64)
        size = np.bincount(own, minlength=n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(h), dtype=np.uint64)])
        end = np.cumsum(size)
        prints.append(tokens.mix((total[end] - total[end - size]) * np.uint64(3) + size.astype(np.uint64)))
        shingles.append(h)
        owners.append(own + low)
        sizes.append(size)
    return np.concatenate(shingles), np.concatenate(owners), np.concatenate(sizes), np.concatenate(prints)


def _sets_of_block(row, options):
    """Sets of a whole block: as :func:`_sets`, for all its texts, and which set is the first of its kind in it."""
    powers, parts, begin = tokens.Powers(), [], 0
    for data, offsets in tokens.block_parts(row["sizes"], zstandard.decompress(row["body"])):
        h, own, size, print_ = _sets(data, offsets, powers, options)
        parts.append((h, own + begin, size, print_))
        begin += len(size)
    h, own, size, print_ = (np.concatenate(x) for x in zip(*parts))
    first = np.zeros(len(size), bool)
    first[np.unique(print_, return_index=True)[1]] = True
    return h, own, size, print_, first & (size > 0)


def _ask(batches, options, bits: int, buckets: int):
    for batch in batches:
        for row in batch.to_pylist():
            h, own, size, print_, first = _sets_of_block(row, options)
            keys = tokens.mix(h[first[own]]) >> np.uint64(64 - bits)
            yield exchange.request_batch([
                *exchange.requests(row["block"], PRINTS, print_, np.ones(len(print_)), buckets),
                *exchange.requests(row["block"], SHINGLES, keys, np.ones(len(keys)), buckets, bits),
            ])


def _incidence(options, bits: int):
    """Rows of all texts, and with them the shared shingles of each set that may link to another one."""

    def run(key, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        h, own, size, print_, first = _sets_of_block(row, options)
        _, unit = exchange.read_answer(answers, PRINTS, print_)
        mine = first & (unit == row["block"])
        asked = first[own]
        number = np.zeros(len(h), np.int64)
        number[asked] = exchange.read_answer(answers, SHINGLES, tokens.mix(h[asked]) >> np.uint64(64 - bits))[0]
        shared = number > 1
        count = np.bincount(own[shared], minlength=len(size))
        begin = np.searchsorted(own, np.arange(len(size) + 1))
        items, lead = [None] * len(size), [None] * len(size)
        for i in np.flatnonzero(mine & (count >= options.least_shared(size))):
            s = slice(begin[i], begin[i + 1])
            use = shared[s]
            x, f = h[s][use], number[s][use]
            items[i] = x.tobytes()
            # Rare shingles first: of these, a linked set shares one.
            lead[i] = x[np.lexsort((x, f))][: len(x) - options.least_shared(size[i]) + 1].view(np.int64)
        out = pd.DataFrame({"doc_id": row["ids"], "n": size, "key": print_.view(np.int64), "items": items, "lead": lead})
        return out.astype({"doc_id": "Int64"})

    return run


def _components_of(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row number that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def multiply(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlap counts of every set of ``a`` with every set of ``b``, accumulated over column blocks."""
    rows_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rows_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    columns = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(columns):
        return out
    at_a, at_b = (np.minimum(np.searchsorted(columns, x), len(columns) - 1) for x in (flat_a, flat_b))
    ok_a, ok_b = columns[at_a] == flat_a, columns[at_b] == flat_b
    rows_a, at_a, rows_b, at_b = rows_a[ok_a], at_a[ok_a], rows_b[ok_b], at_b[ok_b]
    for low in range(0, len(columns), width):
        size = min(width, len(columns) - low)
        left, right = np.zeros((len(a), size), np.float32), np.zeros((len(b), size), np.float32)
        use = (at_a >= low) & (at_a < low + size)
        left[rows_a[use], at_a[use] - low] = 1
        use = (at_b >= low) & (at_b < low + size)
        right[rows_b[use], at_b[use] - low] = 1
        out += left @ right.T
    return out


def _links_of_block(block: pd.DataFrame, options: JaccardOptions) -> pd.DataFrame:
    """(key, root, links) of the rows of one pair of blocks; a single block is paired with itself."""
    sets = [np.frombuffer(s, np.uint64) for s in block["items"]]
    size, key = block["n"].to_numpy(np.int64), block["key"].to_numpy(np.int64)
    weight, side = block["copies"].to_numpy(np.int64), block["side"].to_numpy()
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() else None
    alone = block["alone"].iloc[0]
    if not alone and (two is None or not len(one)):
        return pd.DataFrame({"key": key[:0], "root": key[:0], "links": key[:0]})
    other = one if alone else two
    overlap = multiply([sets[i] for i in one], [sets[i] for i in other])
    adjacent = overlap >= options.least_overlap(size[one][:, None], size[other][None, :])
    if alone:
        np.fill_diagonal(adjacent, False)
        rows, full = one, adjacent
    else:
        rows, n = np.concatenate([one, two]), len(one)
        full = np.zeros((len(rows), len(rows)), bool)
        full[:n, n:], full[n:, :n] = adjacent, adjacent.T
    links = full @ weight[rows]
    root = key[rows][_components_of(full)]
    some = links > 0
    return pd.DataFrame({"key": key[rows][some], "root": root[some], "links": links[some]})


def similarity_classes(docs: DataFrame, options: JaccardOptions | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, links): one row per row of ``docs`` (doc_id, text).

    ``n_shingles`` is the size of the document's set of distinct shingles of ``words`` words; fewer
    words make one shingle of all of them. ``component_id`` is the smallest doc_id reachable by
    links, itself included, and ``links`` the number of other rows it links to. Texts that are null
    or without words have an empty set, link to nothing and are their own component, as is a row
    without any link. Equal texts link. An empty table gives an empty table; other columns are
    ignored.
    """
    options = options or JaccardOptions()
    spark = docs.sparkSession
    steps = StepTables(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("note"), "text")
    blocks = steps.write(rows.mapInArrow(
        lambda b: gather_blocks(b, options.block_bytes), "block bigint, ids array<bigint>, notes array<boolean>, sizes array<bigint>, body binary"), "blocks")
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    bits = min(64, math.ceil(math.log2(size + 2)) + options.spare_bits)
    buckets = max(1, math.ceil(size / (24 << 20)))
    asked = blocks.select("block", "sizes", "body").mapInArrow(lambda b: _ask(b, options, bits, buckets), exchange.REQUEST)
    answers = steps.write(exchange.answer(asked), "answers")
    sets = steps.write(blocks.select("block", "ids", "sizes", "body").groupBy("block").cogroup(answers.groupBy("unit")).applyInPandas(
        _incidence(options, bits), "doc_id bigint, n bigint, key bigint, items binary, lead array<bigint>"), "sets")
    steps.drop("blocks", "answers")
    known = sets.select("doc_id", "n", "key")
    classes = steps.write(known.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    posted = steps.write(sets.where("lead is not null").select("key", F.explode("lead").alias("h")), "postings")
    heads = posted.groupBy("h").agg(F.min("key").alias("head"), F.max("key").alias("tail")).where("head <> tail").select("h", "head")
    pairs = steps.write(posted.join(steps.write(heads, "heads"), "h").where("key <> head").select("key", "head").distinct(), "pairs")
    steps.drop("postings", "heads")
    groups = steps.write(connected_components(pairs, "key", "head").withColumnRenamed("node", "key"), "groups")
    sized = groups.join(sets.where("items is not null").select("key", "n"), "key").join(classes.select("key", "copies"), "key")
    # Linked sizes differ by one band at most; a component that fits one block needs no bands.
    whole = steps.write(sized.groupBy("component").agg(F.count("*").alias("all")), "whole")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(options.percent / 100) + 1e-9).cast("int")
    member = sized.join(whole, "component").withColumn("band", F.when(F.col("all") > options.block, band).otherwise(0))
    member = steps.write(member, "member")
    parts = F.ceil(F.col("rows") / options.block).cast("int")
    shape = member.groupBy("component", "band").agg(F.count("*").alias("rows")).select("component", "band", parts.alias("parts"))
    shape = steps.write(shape, "shape")
    near = shape.select("component", "band", "parts").join(
        shape.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")), ["component", "band"], "left"
    ).join(
        shape.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("below")), ["component", "band"], "left"
    )
    near = steps.write(near.fillna(0, ["above", "below"]), "near")
    spread = member.join(near, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    up_to = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    own, zero = F.col("own"), F.lit(0)
    same = F.transform(up_to("parts"), lambda p: F.struct(
        F.col("band").alias("band"), zero.alias("step"), F.least(p, own).alias("low"), F.greatest(p, own).alias("high"), F.when(own <= p, 0).otherwise(1).alias("side")))
    over = F.transform(up_to("above"), lambda p: F.struct(
        F.col("band").alias("band"), F.lit(1).alias("step"), own.alias("low"), p.alias("high"), zero.alias("side")))
    under = F.transform(up_to("below"), lambda p: F.struct(
        (F.col("band") - 1).alias("band"), F.lit(1).alias("step"), p.alias("low"), own.alias("high"), F.lit(1).alias("side")))
    # A small component shares a group with others; any other pair of blocks is a group of its own.
    few = F.col("all") <= options.block // SMALL
    small = whole.where(few).agg(F.sum("all")).first()[0] or 0
    bins = max(1, math.ceil(small / options.block))
    bin_ = F.when(few, F.pmod(F.xxhash64("component"), F.lit(bins)))
    meetings = spread.select("key", "copies", bin_.alias("bin"), F.transform(F.concat(same, over, under), lambda m: F.struct(
        m["side"].alias("side"), ((m["step"] == 0) & (m["low"] == m["high"])).alias("alone"),
        F.xxhash64("component", m["band"], m["step"], m["low"], m["high"]).alias("pair"))).alias("meetings"))
    meetings = steps.write(meetings, "meetings")
    meet = sets.where("items is not null").select("key", "n", "items").join(meetings, "key").select(
        "key", "n", "items", "copies", "bin", F.explode("meetings").alias("m")).select("key", "n", "items", "copies", "bin", "m.side", "m.alone", "m.pair")

    def products(part: pd.DataFrame) -> pd.DataFrame:
        found = [_links_of_block(block, options) for _, block in part.groupby("pair", sort=False) if len(block) > 1]
        return pd.concat(found) if found else pd.DataFrame({"key": [], "root": [], "links": []}).astype("int64")

    dealt = meet.withColumn("group", F.coalesce("bin", "pair")).drop("bin").groupBy("group").applyInPandas(products, "key bigint, root bigint, links bigint")
    linked = steps.write(dealt, "links")
    joined = connected_components(linked.where("key <> root"), "key", "root").withColumnRenamed("node", "key")
    joined = steps.write(joined, "joined")
    steps.drop("groups", "near", "shape", "whole", "member", "meetings", "pairs")
    least = steps.write(joined.join(classes, "key").groupBy("component").agg(F.min("first").alias("component_first")), "least")
    others = linked.groupBy("key").agg(F.sum("links").alias("other_links"))
    summary = classes.join(joined.join(least, "component"), "key", "left").join(others, "key", "left").select(
        "key", "copies", F.coalesce("component_first", "first").alias("component_id"), F.coalesce("other_links", F.lit(0)).alias("other_links")
    )
    result = known.join(steps.write(summary, "summary"), "key", "left")
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("copies") - 1 + F.col("other_links")).otherwise(0).alias("links"),
    )
