"""Toxicity classifier that is regularised by counterfactual identity swaps.

A logistic model over the presence of hashed words; the words of the model are those that several
labelled texts share, by their 64-bit hashes, so no other word can collide with one of them in
practice. For labelled texts that mention a group, each identity term is
exchanged for a term of another group, and the squared change of the log odds is added to the
loss, so that the terms themselves carry no weight of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilerec.llm import tokens
from profilerec.llm.linear import distinct_words, labelled_sample, pack_lists, plain_words, slices

#: Terms that name a group, by kind of group; a swap stays within its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("immigrants", "natives", "refugees", "locals"), ("immigrant", "native", "refugee", "local"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly", "teenage"),
    ("americans", "mexicans", "chinese", "indians", "russians", "germans", "french"),
)


@dataclass(frozen=True)
class ToxicityOptions:
    """``train_rows`` bounds the labelled texts that are fitted in one task; all texts are scored."""

    train_rows: int = 20_000
    least_texts: int = 3
    most_share: float = 0.2
    rounds: int = 250
    lasso: float = 6e-4
    ridge: float = 2e-5
    swap_weight: float = 1.0
    threshold: float = 0.7
    groups: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


def _hash(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    word, _ = plain_words(data, np.array([0, len(data)], np.int64), tokens.Powers())
    return int(word.view(np.int64)[0])


def swaps(options: ToxicityOptions) -> dict[int, list[int]]:
    """Hash of a term: hashes of the other terms of its kind."""
    out: dict[int, list[int]] = {}
    for group in options.groups:
        own = [_hash(t) for t in group]
        for h in own:
            out.setdefault(h, []).extend(o for o in own if o != h)
    return out


def _features(batches):
    powers = tokens.Powers()
    for rows, data, offsets in slices(batches, "text"):
        word, text = distinct_words(*plain_words(data, offsets, powers))
        yield pa.RecordBatch.from_arrays([rows.column(0), pack_lists(text, len(rows), word.view(np.int64))], ["label", "features"])


def _descend(y, owner, index, size, swap, lasso: float, ridge: float, weight: float, rounds: int) -> np.ndarray:
    """Minimiser of the mean log loss, the swap penalty and the two norms: accelerated proximal steps.

    ``swap`` lists (owner, term, partner) of every mention. The last weight is the bias.
    """
    n = max(len(y), 1)
    swap_owner, term, partner = swap
    groups, swap_row = np.unique(swap_owner, return_inverse=True)
    pull = weight / max(len(groups), 1)

    def change(w):
        return np.bincount(swap_row, w[term] - w[partner], len(groups))

    def curve(w):  # the largest curvature of the smooth part, applied to w
        z = np.bincount(owner, w[index], len(y)) + w[-1]
        out = np.append(np.bincount(index, z[owner], size), z.sum()) * 0.25 / n
        if len(term):
            c = change(w)[swap_row] * pull
            out += np.bincount(term, c, size + 1) - np.bincount(partner, c, size + 1)
        return out + ridge * w

    probe, step = np.ones(size + 1) / np.sqrt(size + 1), 1.0
    for _ in range(20):
        probe = curve(probe)
        step = 0.9 / max(float(np.linalg.norm(probe)), 1e-9)
        probe *= step / 0.9
    w = ahead = np.zeros(size + 1)
    t = 1.0
    for _ in range(rounds):
        z = np.bincount(owner, ahead[index], len(y)) + ahead[-1]
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(index, error[owner], size) + ridge * ahead[:-1], error.sum())
        if len(term):
            c = change(ahead)[swap_row] * pull
            grad += np.bincount(term, c, size + 1) - np.bincount(partner, c, size + 1)
        new = ahead - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lasso, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def fit_weights(labels: np.ndarray, rows: list[np.ndarray], options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes in order, weights, bias): a lasso fit picks the words, a second fit weighs them."""
    y = labels.astype(float)
    found = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    other = swaps(options)
    words, texts = np.unique(found, return_counts=True)
    usable = (texts >= options.least_texts) & (texts <= max(options.most_share * len(y), options.least_texts))
    named = np.fromiter(other, np.int64, len(other))
    vocabulary = np.union1d(words[usable], named)
    for lasso in (options.lasso, 0.0):
        place = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
        known = vocabulary[place] == found
        index, own, size = place[known], owner[known], len(vocabulary)
        # One swap per mention; the partner rotates with the row, so that every pair of terms meets.
        at = np.flatnonzero(np.isin(vocabulary[index], named))
        choice = [other[int(vocabulary[index[i]])] for i in at]
        partner = np.searchsorted(vocabulary, np.array([c[int(own[i]) % len(c)] if c else vocabulary[index[i]] for i, c in zip(at, choice)], np.int64))
        w = _descend(y, own, index, size, (own[at], index[at], partner), lasso, options.ridge, options.swap_weight, options.rounds if lasso else 4 * options.rounds)
        if lasso:
            vocabulary = np.union1d(vocabulary[w[:-1] != 0], named)
    return vocabulary, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, usable, options: ToxicityOptions | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, weights, bias) from labelled texts (column ``toxic``) whose id meets ``usable``.

    No usable label gives an empty model, hence a score of 0.5 for every text.
    """
    options = options or ToxicityOptions()
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", usable, options.train_rows)
    features = sample.select(F.col("_label").cast("int").alias("label"), "text").mapInArrow(_features, "label int, features array<bigint>")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        vocabulary, weights, bias = fit_weights(part["label"].to_numpy(), list(part["features"]), options)
        return pd.DataFrame({"words": [vocabulary.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    # The sample is bounded by ``train_rows``, so it may meet in one task.
    found = features.groupBy().applyInPandas(learn, "words binary, weights binary, bias double").first()
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(found["words"], np.int64), np.frombuffer(found["weights"]), found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], options: ToxicityOptions | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Every different word of the whole text counts once. Null and empty texts get the score of the
    bias alone. Columns named like the added ones are replaced. The model holds at most the words
    of the labelled sample and travels with the tasks.
    """
    options = options or ToxicityOptions()
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    vocabulary, weights, bias = model

    def run(batches):
        powers = tokens.Powers()
        for part, data, offsets in slices(batches, "text"):
            z = np.full(len(part), bias)
            word, text = plain_words(data, offsets, powers)
            if len(vocabulary) and len(word):
                place = np.minimum(np.searchsorted(vocabulary, word.view(np.int64)), len(vocabulary) - 1)
                hit = vocabulary[place] == word.view(np.int64)
                pairs = np.unique(text[hit] * len(vocabulary) + place[hit])
                z += np.bincount(pairs // len(vocabulary), weights[pairs % len(vocabulary)], len(part))
            result = pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, result], [*kept, "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= options.threshold, 1).otherwise(0))
