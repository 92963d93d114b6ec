"""Benchmark decontamination by spaced seeds.

Fixed masks select some of a few adjacent words and ignore the others, so a seed survives
substitutions at the ignored places. Hashes of the selected words of test items and of documents
are joined; each hit fixes an alignment, along which the words around it are compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.llm.linear import slices
from profilerec.session import StepTables


@dataclass(frozen=True)
class SeedOptions:
    """An overlap counts from ``matches`` equal words at the same places on, with a share of at least ``identity`` equal.

    An item of fewer words counts if all its words match. ``margin`` words on both sides of a
    hit are compared. Each such overlap holds a seed of one of the ``masks``: without the last two,
    11 of the 286 ways to replace 3 of 15 words hold none. ``sieve_bits`` is the size of a fixed bit field that keeps seeds that no item
    has out of the join; a full field costs time, not results.
    """

    masks: tuple[str, ...] = ("111111", "11101111", "110110111", "1011101011", "1101011101", "101010010011", "111110001")
    matches: int = 12
    identity: float = 0.8
    margin: int = 96
    sieve_bits: int = 23


def _seeds(word: np.ndarray, text: np.ndarray, masks) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask (hash, position of the first word) of every seed within one text."""
    out = []
    for number, mask in enumerate(masks):
        span = len(mask)
        if len(word) < span:
            continue
        h = np.full(len(word) - span + 1, number + 1, np.uint64)
        for k, on in enumerate(mask):
            if on == "1":
                h = tokens.mix(h * np.uint64(5) + word[k : k + len(h)])
        inside = np.flatnonzero(text[: len(h)] == text[span - 1 :])
        out.append((h[inside], inside))
    return out


def _item_rows(batches, masks):
    powers = tokens.Powers()
    for rows, data, offsets in slices(batches, "text"):
        n = len(rows)
        word, text = tokens.words(data, offsets, powers)
        first = np.searchsorted(text, np.arange(n + 1))
        found = _seeds(word, text, masks)
        h = np.concatenate([*[x for x, _ in found], np.zeros(0, np.uint64)])
        at = np.concatenate([*[p for _, p in found], np.zeros(0, np.int64)])
        order = np.argsort(text[at], kind="stable") if len(at) else at
        h, at = h[order], at[order]
        own = text[at]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]), pa.int32())
        yield pa.RecordBatch.from_arrays([
            rows.column(0), pa.array([word[first[i] : first[i + 1]].tobytes() for i in range(n)], pa.binary()),
            pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((at - first[own]).astype(np.int32))),
        ], ["item_id", "item", "hashes", "places"])


def _best_run(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the stretch with the largest sum of 1 per equal and -3 per different word.

    Overlaps are found by :func:`_best_stretch`; this one only serves the older test.
    """
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def _best_stretch(equal: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with most equal words among those with a share of at least ``identity``.

    Of several the shortest, then the first; it begins and ends with an equal word.
    """
    # A stretch has the share if its sum is not negative; whole numbers, so that 12 of 15 are 0.8.
    total = np.concatenate([[0], np.cumsum(equal.astype(np.int64) * 1_000_000 - round(identity * 1_000_000))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # The first start whose sum up to there is not above that of the end leaves most equal words.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    matched = count - count[start]
    most = int(matched.max())
    if most == 0:
        return 0, 0, 0
    at, last = np.flatnonzero(equal), count[matched == most] - 1
    k = last[np.argmin(at[last] - at[last - most + 1])]
    return int(at[k - most + 1]), int(at[k]) + 1, most


def overlaps(docs: DataFrame, items: DataFrame, options: SeedOptions | None = None) -> DataFrame:
    """(doc_id, item_id, matched, length, doc_start, item_start): the best overlap of each pair that has one.

    ``docs`` has doc_id and text, ``items`` item_id and text. ``length`` words from the places
    ``doc_start`` and ``item_start`` on are aligned, ``matched`` of them are equal. Null and empty
    texts overlap with nothing, and an item of fewer words than the shortest mask with nothing
    either. Rows with the same id count as one document or item; of equally good overlaps the first
    is returned. Empty tables give an empty table; other columns are ignored.
    """
    options = options or SeedOptions()
    spark = docs.sparkSession
    steps = StepTables(spark, "decontaminate")
    doc_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    masks, margin = options.masks, options.margin
    schema = T.StructType([T.StructField("item_id", item_type), *T.StructType.fromDDL("item binary, hashes array<bigint>, places array<int>").fields])
    tests = steps.write(items.where("item_id is not null").select("item_id", "text").mapInArrow(lambda b: _item_rows(b, masks), schema), "items")
    seeds = steps.write(tests.select("item_id", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        F.col("s.hashes").alias("h"), "item_id", F.col("s.places").alias("item_at")).distinct(), "seeds")
    bit = F.shiftrightunsigned(F.col("h"), 64 - options.sieve_bits)
    one = F.lit(1).cast("bigint")
    cells = seeds.select(F.shiftrightunsigned(bit, 6).alias("w"), F.call_function("shiftleft", one, bit.bitwiseAND(63).cast("int")).alias("b"))
    field = np.zeros(1 << (options.sieve_bits - 6), np.uint64)
    for r in cells.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas().itertuples():
        field[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    sieve = spark.sparkContext.broadcast(field)
    shift = np.uint64(64 - options.sieve_bits)

    def regions(batches):
        """Stretches of a document around seeds that pass the sieve, with those seeds."""
        powers, bits = tokens.Powers(), sieve.value
        for rows, data, offsets in slices(batches, "text"):
            word, text = tokens.words(data, offsets, powers)
            hs, ps = [], []
            for h, at in _seeds(word, text, masks):
                cell = h >> shift
                hit = np.flatnonzero((bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1))
                hs.append(h[hit])
                ps.append(at[hit])
            h = np.concatenate([*hs, np.zeros(0, np.uint64)])
            at = np.concatenate([*ps, np.zeros(0, np.int64)])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            first = np.searchsorted(text, np.arange(len(rows) + 1))
            own = text[at]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(at) > 2 * margin)]))
            end = np.append(new[1:], len(at))
            low = np.maximum(at[new] - margin, first[own[new]])
            high = np.minimum(at[end - 1] + margin, first[own[new] + 1])
            ends = pa.array(np.append(new, len(at)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(own[new])), pa.array(low - first[own[new]]),
                pa.array([word[a:b].tobytes() for a, b in zip(low, high)], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array((at - np.repeat(low, end - new)).astype(np.int32))),
            ], ["doc_id", "region_at", "region", "hashes", "places"])

    schema = T.StructType([T.StructField("doc_id", doc_type), *T.StructType.fromDDL(
        "region_at bigint, region binary, hashes array<bigint>, places array<int>").fields])
    found = steps.write(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(regions, schema).withColumn(
        "number", F.monotonically_increasing_id()), "regions")
    hits = found.select("number", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "number", F.col("s.hashes").alias("h"), F.col("s.places").alias("at"))
    lines = hits.join(seeds, "h").select("number", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = steps.write(lines, "lines").join(found.select("number", "doc_id", "region_at", "region"), "number").join(
        tests.select("item_id", "item").dropDuplicates(["item_id", "item"]), "item_id")

    def verify(batches):
        for b in batches:
            kept, out = [], []
            shifts, begins = b.column(3).to_numpy(), b.column(2).to_numpy()
            regions_, items_ = b.column(4), b.column(5)
            for i in range(len(b)):
                region, item = np.frombuffer(regions_[i].as_buffer(), np.uint64), np.frombuffer(items_[i].as_buffer(), np.uint64)
                low, high = max(0, shifts[i]), min(len(region), shifts[i] + len(item))
                start, end, matched = _best_stretch(region[low:high] == item[low - shifts[i] : high - shifts[i]], options.identity)
                if matched >= min(options.matches, len(item)):
                    kept.append(i)
                    out.append((matched, end - start, begins[i] + low + start, low - shifts[i] + start))
            if kept:
                columns = [pa.array(np.array(c, np.int64)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), b.column(1).take(pa.array(kept)), *columns],
                                                 ["doc_id", "item_id", "matched", "length", "doc_start", "item_start"])

    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), *T.StructType.fromDDL(
        "matched bigint, length bigint, doc_start bigint, item_start bigint").fields])
    good = pairs.select("doc_id", "item_id", "region_at", "shift", "region", "item").mapInArrow(verify, schema)
    best = F.max(F.struct("matched", (-F.col("length")).alias("l"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.l")).alias("length"),
        (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, options: SeedOptions | None = None) -> DataFrame:
    """Rows of ``docs`` that overlap with no item; rows with a null id stay. All columns are kept."""
    found = overlaps(docs, items, options).select("doc_id").distinct()
    # Written first: the measured size lets Spark choose how to join.
    found = StepTables(docs.sparkSession, "contaminated").write(found, "ids")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
