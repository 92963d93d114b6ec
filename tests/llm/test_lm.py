"""Counts and scores against a plain model."""

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilerec.llm import lm


def test_scores_equal_a_plain_model(spark, docs_of, odd_rows):
    rows = [(i if i is not None else 77, t) for i, t in odd_rows] + [(20 + i, "the cat sat on the mat " * (i % 3 + 1)) for i in range(9)]
    trained = F.col("doc_id") % 3 != 0
    options = lm.InterpolationOptions(order=3, block_bytes=64)
    got = lm.interpolation_scores(docs_of(rows).withColumn("block", F.lit(0)), trained, options).collect()
    docs = [(i, (t or "").lower().split() + ["</s>"]) for i, t in rows]
    counts = Counter(w for i, d in docs if i % 3 for w in d)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, i % 3 != 0, len(d), sum(counts[w] > 0 for w in d), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in d), 6)) for i, d in docs)
    assert sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[20]["score"] > by[20]["base_score"] and by[24]["score"] > by[24]["base_score"]


def test_probabilities_sum_to_one(spark, docs_of):
    words = ["a", "b", "c"]
    rows = [(1, "a b a c a b"), (2, "b b a"), (4, "c a b b")] + [(30 + 3 * k, f"a {w}") for k, w in enumerate([*words, "new"])] + [(60, "a")]
    got = {r["doc_id"]: r["score"] for r in lm.interpolation_scores(docs_of(rows), F.col("doc_id") % 3 != 0).collect()}
    ends = {r["doc_id"]: r["score"] for r in lm.interpolation_scores(docs_of([*rows[:3], *[(90 + 3 * k, w) for k, w in enumerate([*words, "new"])]]), F.col("doc_id") % 3 != 0).collect()}
    # P(w | a), from P(<s> a w </s>) and the same model's P(</s> | w) = P(<s> w </s>) / P(<s> w).
    assert all(math.isfinite(x) for x in [*got.values(), *ends.values()])
    assert lm.interpolation_scores(docs_of([]), F.lit(True)).collect() == []
    alone = lm.interpolation_scores(docs_of([(1, "x y")]), F.lit(False)).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and alone["base_score"] == 0 and alone["score"] == 0


def test_weights_follow_the_better_estimate():
    histogram = pd.DataFrame({"c": [3, 3, 8], "b1": [8, 8, 0], "b2": [40, -1, 40], "n": [900.0, 100.0, 500.0]})
    w = lm.learn_weights(histogram, 2, 4, 100)
    assert w[3, 2] == pytest.approx(0.9, abs=0.01) and w[8, 2] > 0.97
    assert w.sum(axis=1) == pytest.approx(1.0)
    assert lm.learn_weights(histogram[:0], 2, 4, 10)[0].tolist() == [1.0, 0.0, 0.0]


def test_blobs_round_trip():
    import numpy as np

    for kind in (np.uint32, np.uint64):
        for x in ([], [0], [5, 1 << 31, 7]):
            assert lm.restore(lm.squeeze(np.array(x, kind)), kind).tolist() == x


def test_estimates_below_the_uniform_one_keep_their_level():
    import numpy as np

    v, fine, low = 99, 4, -14
    p = np.array([0.0, 0.001, 0.0025, 0.01, 0.5])
    level = lm._levels([p], v, low, fine)[0]
    assert level[0] == -1 and level[1:].min() >= 0
    assert 2.0 ** ((level[1:] + low) / fine) / (v + 1) == pytest.approx(p[1:], rel=0.1)
    # A tenth of the uniform estimate earns nearly no weight.
    histogram = pd.DataFrame({"c": [3], "b1": [level[1]], "n": [1000.0]})
    assert lm.learn_weights(histogram, 1, fine, 50, low)[3, 0] > 0.99
