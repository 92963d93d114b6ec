"""Held-out accuracy on planted signals, identity terms, and odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilerec.llm import quality, toxicity

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "ka") for b in ("na", "pe", "ri", "to", "fu", "ze", "ga")]


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rng.choice(WORDS) for _ in range(rng.randrange(10, 60))]
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["vile", "Scum,", "rotten"])
        if rng.random() < (0.5 if bad else 0.1):
            text.append("muslims")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_held_out_rows_and_leaves_identity_terms_alone(spark, docs_of, toxic_rows):
    rows, labels = toxic_rows
    labels = [*labels, (0, 1, 1), (None, 1, 1), (9999, 1, 1), (1, None, None)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = docs_of(rows)
    model = toxicity.fit(docs, table, F.col("doc_id") % 5 != 0)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert sum(scored[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    free = toxicity.fit(docs, table, F.col("doc_id") % 5 != 0, toxicity.ToxicityOptions(swap_weight=0.0))
    weight = lambda m, w: m[1][np.searchsorted(m[0], toxicity._hash(w))]
    assert abs(weight(model, "muslims") - weight(model, "jews")) < 0.2 * abs(weight(free, "muslims") - weight(free, "jews"))


def test_odd_texts_and_tables(spark, docs_of, odd_rows, toxic_rows):
    rows, labels = toxic_rows
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    odd = docs_of([*odd_rows, (11, "the")]).withColumn("score", F.lit("old")).withColumn("label", F.lit(3)).withColumn("_label", F.lit(4))
    for module in (toxicity, quality):
        model = module.fit(docs_of(rows), table, F.lit(True))
        got = module.score(odd, model).collect()
        assert len(got) == len(odd_rows) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        assert module.score(odd.limit(0), model).collect() == []
        empty = module.fit(odd.limit(0), table, F.lit(True))
        assert {r["score"] for r in module.score(docs_of([(1, None), (2, "some words")]), empty).collect()} == {0.5}


def test_quality_learns_structure(spark, docs_of):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        text = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(30, 120))]
        kind = i % 5
        if kind == 0:
            text = [w.upper() + "!!" for w in text]
        elif kind == 1:
            text = text[:3] * 30
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind > 1), 0))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs_of(rows), table, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs_of(rows), model).collect()}
    held = [i for i in range(500) if i % 4 == 2]
    assert sum(got[i] == (i % 5 > 1) for i in held) >= 0.95 * len(held)


def test_pairwise_part_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    w, factors = rng.normal(size=20), rng.normal(size=(20, 3))
    index, value, owner = np.array([1, 4, 9, 4, 7]), np.array([0.5, 1.0, 2.0, 1.0, -1.0]), np.array([0, 0, 0, 1, 1])
    z = quality.log_odds(index, value, owner, 2, 0.3, w, factors)
    for t in range(2):
        i, x = index[owner == t], value[owner == t]
        pairs = sum(factors[i[a]] @ factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert z[t] == pytest.approx(0.3 + w[i] @ x + pairs)
