"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

Every feature is an index with a value; the pairwise part is scored in linear time as half the
square of the sum of factor vectors less the sum of their squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.llm.linear import distinct_words, labelled_sample, plain_words, slices

#: Structure statistics, each cut into STEPS levels.
STATISTICS = (
    "log_bytes", "log_words", "upper_share", "digit_share", "punct_share", "high_share", "space_share", "mean_word",
    "distinct_share", "top_word_share", "line_words", "repeated_line_share", "mark_word_share", "repeated_pair_share",
)
STEPS = 24


@dataclass(frozen=True)
class QualityOptions:
    """``train_rows`` bounds the labelled texts that are fitted in one task; all texts are scored."""

    bits: int = 16
    rank: int = 8
    train_rows: int = 16_000
    epochs: int = 6
    batch: int = 256
    rate: float = 0.05
    ridge: float = 1e-5
    threshold: float = 0.7

    @property
    def size(self) -> int:
        return (1 << self.bits) + len(STATISTICS) * (STEPS + 1)


def _class_table(ranges) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high] = True
    return table


UPPER, DIGIT = _class_table([(65, 91)]), _class_table([(48, 58)])
HIGH, SPACE = _class_table([(128, 256)]), _class_table([(9, 14), (32, 33)])
PUNCT = _class_table([(33, 48), (58, 65), (91, 97), (123, 127)])


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _repeats(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values, count of the most frequent value) per text."""
    if not len(word):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((word, text))
    w, t = word[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])]))
    count = np.diff(np.append(new, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, t[new], count)
    return np.bincount(t[new], minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray, powers: tokens.Powers) -> np.ndarray:
    """One row per text, one column per name in ``STATISTICS``; shares of nothing are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    part = lambda a, b: a / np.maximum(b, 1.0)
    word, text = tokens.words(data, offsets, powers)
    start, end, _ = tokens.word_bounds(data, offsets)
    words = np.bincount(text, minlength=n).astype(float)
    different, top = _repeats(word, text, n)
    breaks = data == 10
    lines = _sums(breaks, offsets) + 1
    # A line's hash is that of its bytes; its words are summed, which is enough to find repeats.
    line = np.cumsum(breaks)[start] if len(start) else np.zeros(0, np.int64)
    runs = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])) if len(word) else np.zeros(0, int)
    place = np.arange(len(word)) - np.repeat(runs, np.diff(np.append(runs, len(word)))) if len(word) else np.zeros(0, int)
    summed = np.add.reduceat(tokens.mix(word + place.astype(np.uint64)), runs) if len(runs) else np.zeros(0, np.uint64)
    filled = np.bincount(text[runs], minlength=n).astype(float)
    different_lines, _ = _repeats(summed, text[runs], n)
    mark = PUNCT[data[np.maximum(end - 2, start)]] & PUNCT[data[end - 1]] if len(start) else np.zeros(0, bool)
    pair = tokens.mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)
    same = text[:-1] == text[1:] if len(word) > 1 else np.zeros(0, bool)
    pairs = np.bincount(text[:-1][same], minlength=n).astype(float) if len(word) > 1 else np.zeros(n)
    different_pairs, _ = _repeats(pair[same], text[:-1][same] if len(word) > 1 else text[:0], n)
    return np.column_stack([
        np.log1p(size) / 14, np.log1p(words) / 12, part(_sums(UPPER[data], offsets), size), part(_sums(DIGIT[data], offsets), size),
        part(_sums(PUNCT[data], offsets), size), part(_sums(HIGH[data], offsets), size), part(_sums(SPACE[data], offsets), size),
        part(size, words) / 30, part(different, words), part(top, words), np.log1p(part(words, lines)) / 8,
        1 - part(different_lines, filled) * (filled > 0), part(np.bincount(text, mark, n) if len(text) else np.zeros(n), words),
        1 - part(different_pairs, pairs) * (pairs > 0),
    ])


def features(data: np.ndarray, offsets: np.ndarray, powers: tokens.Powers, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, text number), ordered by text: hashed words, then one level per statistic."""
    n = len(offsets) - 1
    word, text = distinct_words(*plain_words(data, offsets, powers))
    bucket = (word >> np.uint64(64 - bits)).astype(np.int64)
    count = np.bincount(text, minlength=n)
    # Shares are most telling near 0, so levels are equal steps of the square root.
    level = np.minimum((np.sqrt(np.clip(statistics(data, offsets, powers), 0, 1)) * STEPS).astype(np.int64), STEPS)
    k = len(STATISTICS)
    index = np.concatenate([bucket, ((1 << bits) + np.arange(k) * (STEPS + 1) + level).ravel()])
    value = np.concatenate([(1.0 / np.sqrt(np.maximum(count, 1)))[text], np.ones(n * k)])
    owner = np.concatenate([text, np.repeat(np.arange(n), k)])
    order = np.argsort(owner, kind="stable")
    return index[order], value[order], owner[order]


def log_odds(index: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int, w0: float, w: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Of each text; every text has a feature, and features are ordered by text."""
    first = np.searchsorted(owner, np.arange(n))
    z = np.bincount(owner, w[index] * value, n) + w0
    for f in range(factors.shape[1]):
        x = factors[index, f] * value
        z += 0.5 * (np.add.reduceat(x, first) ** 2 - np.add.reduceat(x * x, first))
    return z


def fit_machine(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], options: QualityOptions) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) by mini-batches with adaptive rates; the order of rows is a fixed shuffle."""
    rng = np.random.default_rng(7)
    w0, w = 0.0, np.zeros(options.size)
    factors = rng.normal(0, 0.02, (options.size, options.rank))
    g0, gw, gf = 1e-6, np.full(options.size, 1e-6), np.full((options.size, options.rank), 1e-6)
    for _ in range(options.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), options.batch):
            chosen = order[at : at + options.batch]
            n = len(chosen)
            index = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in chosen]).astype(float)
            owner = np.repeat(np.arange(n), [len(rows[i][0]) for i in chosen])
            first = np.searchsorted(owner, np.arange(n))
            x = factors[index] * value[:, None]
            total = np.add.reduceat(x, first)
            z = w0 + np.bincount(owner, w[index] * value, n) + 0.5 * (total**2 - np.add.reduceat(x * x, first)).sum(axis=1)
            error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / n
            used, place = np.unique(index, return_inverse=True)
            slope = np.bincount(place, error[owner] * value, len(used)) + options.ridge * w[used]
            gw[used] += slope**2
            w[used] -= options.rate * slope / np.sqrt(gw[used])
            part = (error[owner] * value)[:, None] * (total[owner] - x)
            bend = np.column_stack([np.bincount(place, part[:, f], len(used)) for f in range(options.rank)]) + options.ridge * factors[used]
            gf[used] += bend**2
            factors[used] -= options.rate * bend / np.sqrt(gf[used])
            g0 += error.sum() ** 2
            w0 -= options.rate * error.sum() / np.sqrt(g0)
    return w0, w, factors


def fit(docs: DataFrame, labels: DataFrame, usable, options: QualityOptions | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """The machine learned from labelled texts (column ``quality``) whose id meets ``usable``.

    No usable label gives zero weights, hence a score of 0.5 for every text.
    """
    options = options or QualityOptions()
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", usable, options.train_rows)

    def rows_of(batches):
        powers = tokens.Powers()
        for rows, data, offsets in slices(batches, "text"):
            index, value, owner = features(data, offsets, powers, options.bits)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["id", "label", "index", "value"])

    given = sample.select("doc_id", F.col("_label").cast("int").alias("label"), "text").mapInArrow(
        rows_of, "id bigint, label int, index array<int>, value array<float>"
    )

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        w0, w, factors = fit_machine(part["label"].to_numpy(float), list(zip(part["index"], part["value"])), options)
        return pd.DataFrame({"bias": [w0], "weights": [w.astype(np.float32).tobytes()], "factors": [factors.astype(np.float32).tobytes()]})

    # The sample is bounded by ``train_rows``, so it may meet in one task.
    found = given.groupBy().applyInPandas(learn, "bias double, weights binary, factors binary").first()
    if found is None:
        return 0.0, np.zeros(options.size, np.float32), np.zeros((options.size, options.rank), np.float32)
    return found["bias"], np.frombuffer(found["weights"], np.float32), np.frombuffer(found["factors"], np.float32).reshape(options.size, options.rank)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], options: QualityOptions | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Null texts count as empty; an empty text is scored by its statistics. Columns named like the
    added ones are replaced. The model has a fixed size and travels as one broadcast.
    """
    options = options or QualityOptions()
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        powers, (w0, w, factors) = tokens.Powers(), shared.value
        for part, data, offsets in slices(batches, "text"):
            z = log_odds(*features(data, offsets, powers, options.bits), len(part), w0, w, factors)
            result = pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, result], [*kept, "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= options.threshold, 1).otherwise(0))
