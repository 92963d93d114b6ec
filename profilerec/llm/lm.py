"""Language-model scores by deleted interpolation of n-grams.

Documents are gathered into blocks. Each block asks, for its distinct n-grams, how often they occur
in all training documents, and adds its own counts: one record per n-gram and block, so a frequent
n-gram costs no more than a rare one. Requests are dealt by the hash of the n-gram and answered in
their own order. The weights of the maximum-likelihood estimates depend on how often the context
occurs; expectation-maximisation learns them on the training tokens, each scored with its own
occurrence deleted from the counts, from a histogram over all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.session import StepTables

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


@dataclass(frozen=True)
class InterpolationOptions:
    """``order`` is the longest n-gram; ``block_bytes`` of text are one unit of work.

    Keys of words have 64 bits. Keys of longer n-grams have ``spare_bits`` more than the logarithm
    of the number of texts' bytes, at most 64, so that a key meets another one with a probability
    of 2 to the power of minus ``spare_bits``. ``fine`` histogram steps are one doubling.
    """

    order: int = 3
    block_bytes: int = 4 << 20
    spare_bits: int = 20
    fine: int = 4
    rounds: int = 40


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then compressed."""
    if not len(values):
        return b""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def restore(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def gather_blocks(batches, limit: int, note=pa.bool_()):
    """Blocks of at least ``limit`` bytes of whole texts from (id, note, text); the last of a task may be smaller."""
    part, number = TaskContext.get().partitionId(), 0
    ids, notes, sizes, texts, total = [], [], [], [], 0

    def out():
        body = zstandard.compress(b"".join(texts), 3)
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([notes], pa.list_(note)),
            pa.array([sizes], pa.list_(pa.int64())), pa.array([body], pa.binary()),
        ], ["block", "ids", "notes", "sizes", "body"])

    for batch in batches:
        for first, n, data, offsets in tokens.groups(batch.column(2)):
            ids += batch.column(0).slice(first, n).to_pylist()
            notes += batch.column(1).slice(first, n).to_pylist()
            sizes += np.diff(offsets).tolist()
            texts.append(data.tobytes())
            total += len(data)
            if total >= limit:
                yield out()
                number += 1
                ids, notes, sizes, texts, total = [], [], [], [], 0
    if ids:
        yield out()


def _history(sizes, body: bytes, order: int, powers: tokens.Powers) -> tuple[list[np.ndarray], np.ndarray]:
    """([token, the one before, ...], text number) of every token of a block, with an end after each text."""
    n, found, owners, begin = len(sizes), [], [], 0
    for data, offsets in tokens.block_parts(sizes, zstandard.decompress(body)):
        word, text = tokens.words(data, offsets, powers)
        found.append(word)
        owners.append(text + begin)
        begin += len(offsets) - 1
    word, text = np.concatenate([*found, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
    seq = np.full(len(word) + n, END)
    seq[np.arange(len(word)) + text] = word
    own = np.repeat(np.arange(n), np.bincount(text, minlength=n) + 1)
    place = np.arange(len(seq)) - np.searchsorted(own, own)
    back = [seq]
    for k in range(1, order):
        before = np.full(len(seq), START)
        before[k:] = seq[:-k] if len(seq) > k else seq[:0]
        before[place < k] = START
        back.append(before)
    return back, own


def _keys(back: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, per order; beyond words cut to ``bits`` bits."""
    h, out = back[0], [back[0]]
    for k in range(1, len(back)):
        h = tokens.mix(h * np.uint64(7) + back[k] + np.uint64(k))
        out.append(h >> np.uint64(64 - bits))
    return out


def _ask(batches, order: int, bits: int, buckets: int):
    powers = tokens.Powers()
    for batch in batches:
        for row in batch.to_pylist():
            back, own = _history(row["sizes"], row["body"], order, powers)
            learned = np.array(row["notes"], bool)[own]
            out = []
            for k, key in enumerate(_keys(back, bits)):
                unique, place = np.unique(key, return_inverse=True)
                count = np.bincount(place, learned, len(unique)).astype(np.uint32)
                width = 64 if k == 0 else bits
                bucket = bucket_of(unique, width, buckets)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in range(buckets):
                    u, c = unique[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]
                    if len(u):
                        steps = np.diff(u, prepend=np.uint64(0))
                        out.append((b, row["block"], k, squeeze(steps), squeeze(c)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                             ["bucket", "block", "k", "keys", "counts"])


def bucket_of(keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """Equal ranges of the key space, in key order."""
    top = keys >> np.uint64(max(width - 32, 0)) if width > 32 else keys << np.uint64(32 - width)
    return ((top * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _answer(part: pd.DataFrame) -> pd.DataFrame:
    """Per request the totals of its keys, in its order; and how many words and tokens were learned here."""
    rows, types, learned = [], 0, 0
    for k, group in part.groupby("k"):
        keys = [np.cumsum(restore(x, np.uint64), dtype=np.uint64) for x in group["keys"]]
        counts = np.concatenate([restore(x, np.uint32) for x in group["counts"]]).astype(np.int64)
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, len(unique)).astype(np.int64)
        if k == 0:
            types, learned = int((total > 0).sum()), int(total.sum())
        at = 0
        for block, own in zip(group["block"], keys):
            rows.append((block, k, squeeze(total[place[at : at + len(own)]].astype(np.uint64)), 0, 0))
            at += len(own)
    out = pd.DataFrame([(None, -1, b"", types, learned), *rows], columns=["block", "k", "totals", "types", "learned"])
    out["bucket"] = part["bucket"].iloc[0]
    return out.astype({"block": "Int64"})


def _state(order: int, bits: int):
    def run(key, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        back, own = _history(list(row["sizes"]), row["body"], order, tokens.Powers())
        columns = []
        for k, key_ in enumerate(_keys(back, bits)):
            mine = answers[answers["k"] == k].sort_values("bucket")
            totals = np.concatenate([*[restore(x, np.uint64) for x in mine["totals"]], np.zeros(0, np.uint64)])
            columns.append(totals[np.unique(key_, return_inverse=True)[1]])
        return pd.DataFrame({
            "ids": [row["ids"]], "trained": [row["notes"]], "lengths": [np.bincount(own, minlength=len(row["sizes"]))],
            "counts": [[squeeze(c) for c in columns]],
        })

    return run


def _estimates(counts: list[np.ndarray], lengths: np.ndarray, n: int, documents: int, less: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(estimate per order, context frequency) per token; ``less`` occurrences of the token are deleted."""
    first = np.cumsum(lengths) - lengths
    out, context = [], None
    for k, c in enumerate(counts):
        if k == 0:
            given = np.full(len(c), n, np.float64)
        else:
            # The context of a token is the n-gram, one shorter, that ends before it.
            given = np.empty(len(c))
            given[1:] = counts[k - 1][:-1]
            given[first] = documents
            context = given
        out.append(np.where(given > less, np.maximum(c.astype(float) - less, 0) / np.maximum(given - less, 1), 0.0))
    if context is None:
        context = np.full(len(counts[0]), n, np.float64)
    return out, np.maximum(context - less, 0)


def _class(context: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0, then one per doubling."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _levels(estimates: list[np.ndarray], v: int, low: int, fine: int) -> list[np.ndarray]:
    """Steps of each estimate above ``low`` steps over the uniform one, -1 where it is 0; room for 64 doublings."""
    out = []
    for x in estimates:
        level = np.round(np.log2(np.maximum(x * (v + 1), 1e-300)) * fine) - low
        out.append(np.where(x > 0, np.clip(level, 0, 64 * fine - 2), -1).astype(np.int64))
    return out


def learn_weights(histogram: pd.DataFrame, order: int, fine: int, rounds: int, low: int = 0) -> np.ndarray:
    """Row per context class: weights of the uniform estimate and of each order, by expectation-maximisation.

    ``histogram`` has c (class), b1, b2, ... (estimate in steps above ``low`` steps over the
    uniform one, -1 for none) and n (tokens). Each weight starts equal and gets one extra token's share, so none is zero.
    """
    classes = 66
    weights = np.full((classes, order + 1), 1.0 / (order + 1))
    if not len(histogram):
        weights[:, 1:], weights[:, 0] = 0.0, 1.0
        return weights
    c, n = histogram["c"].to_numpy(int), histogram["n"].to_numpy(float)
    p = np.column_stack([np.ones(len(c)), *[np.where(histogram[f"b{k}"] < 0, 0.0, 2.0 ** ((histogram[f"b{k}"] + low) / fine)) for k in range(1, order + 1)]])
    for _ in range(rounds):
        share = weights[c] * p
        share = share / share.sum(axis=1, keepdims=True) * n[:, None]
        total = np.column_stack([np.bincount(c, share[:, k], classes) for k in range(order + 1)]) + 1.0 / (order + 1)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def interpolation_scores(docs: DataFrame, trained: Column, options: InterpolationOptions | None = None) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    The model learns from the rows that meet ``trained`` (null: no) and scores all. Tokens are the
    words of the whole text, then one end; a null or empty text is the end alone. ``base_score`` is
    the sum of log10 of the add-one unigram estimate, ``score`` that of the interpolated model, and
    ``n_known`` counts tokens that training has. Without training rows all estimates are 1. Rows of
    equal ids are scored each; an empty table gives an empty table; other columns are ignored.
    """
    options = options or InterpolationOptions()
    spark, order = docs.sparkSession, options.order
    steps = StepTables(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"), "text")
    blocks = steps.write(rows.mapInArrow(
        lambda b: gather_blocks(b, options.block_bytes), "block bigint, ids array<bigint>, notes array<boolean>, sizes array<bigint>, body binary"), "blocks")
    shape = blocks.select(
        F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bytes"), F.size(F.filter("notes", lambda t: t)).alias("learned"),
    ).agg(F.sum("bytes").alias("bytes"), F.sum("learned").alias("documents")).first()
    size, documents = shape["bytes"] or 0, shape["documents"] or 0
    bits = min(64, math.ceil(math.log2(size + 2)) + options.spare_bits)
    # So many buckets that one holds the requests for about this many bytes of text.
    buckets = max(1, math.ceil(size / (12 << 20)))
    asked = blocks.mapInArrow(lambda b: _ask(b, order, bits, buckets), "bucket int, block bigint, k int, keys binary, counts binary")
    answers = steps.write(asked.groupBy("bucket").applyInPandas(
        _answer, "block bigint, k int, totals binary, types bigint, learned bigint, bucket int"), "answers")
    known = answers.where("k = -1").agg(F.sum("types").alias("v"), F.sum("learned").alias("n")).first()
    v, n = known["v"] or 0, known["n"] or 0
    state = steps.write(
        blocks.groupBy("block").cogroup(answers.where("k >= 0").groupBy("block")).applyInPandas(
            _state(order, bits), "ids array<bigint>, trained array<boolean>, lengths array<bigint>, counts array<binary>"), "state")
    steps.drop("blocks", "answers")
    names = [f"b{k}" for k in range(1, order + 1)]
    # An estimate is at least 1 / n, so its level is no lower than that of v / n.
    low = math.floor(math.log2((v + 1) / max(n, 1)) * options.fine) - 1

    def bins(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"])
                use = np.repeat(np.array(row["trained"], bool), lengths)
                p, context = _estimates([restore(c, np.uint64) for c in row["counts"]], lengths, n, documents, 1)
                # One number per token: the class, then the levels, each with room for 64 doublings.
                room, cell = 64 * options.fine, _class(context)[use]
                for x in _levels(p, v, low, options.fine):
                    cell = cell * room + x[use] + 1
                cells, count = np.unique(cell, return_counts=True)
                columns = []
                for _ in range(order):
                    columns.insert(0, cells % room - 1)
                    cells = cells // room
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (cells, *columns, count)], ["c", *names, "n"])

    cells = state.select("trained", "lengths", "counts").mapInArrow(bins, "c bigint, " + ", ".join(f"{x} bigint" for x in names) + ", n bigint")
    weights = learn_weights(cells.groupBy("c", *names).agg(F.sum("n").alias("n")).toPandas(), order, options.fine, options.rounds, low)

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"])
                counts = [restore(c, np.uint64) for c in row["counts"]]
                p, context = _estimates(counts, lengths, n, documents, 0)
                w = weights[_class(context)]
                mixed = w[:, 0] / (v + 1)
                for k in range(order):
                    mixed = mixed + w[:, k + 1] * p[k]
                first = np.cumsum(lengths) - lengths
                base = np.log10((counts[0].astype(float) + 1) / (n + v + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["trained"], pa.bool_()), pa.array(lengths.astype(np.int64)),
                    pa.array(np.add.reduceat(counts[0] > 0, first, dtype=np.int64)), pa.array(np.full(len(lengths), n, np.int64)),
                    pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(mixed), first)),
                ], ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return state.mapInArrow(score, T.StructType.fromDDL(schema))
