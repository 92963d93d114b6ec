"""Overlaps against every alignment of every document with every item."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from profilerec.llm import decontaminate


def brute(docs, items):
    out = set()
    for i, t in docs:
        for k, u in items:
            d, q = (t or "").lower().split(), (u or "").lower().split()
            for s in range(-len(q) + 1, len(d)) if len(q) >= 6 else []:
                low, high = max(0, s), min(len(d), s + len(q))
                equal = np.array([d[j] == q[j - s] for j in range(low, high)], bool)
                a, b = decontaminate._best_run(equal)
                m = int(equal[a:b].sum())
                if m >= min(12, len(q)) and m >= 0.8 * (b - a) and i is not None:
                    out.add((i, k))
    return out


def test_overlaps_equal_all_alignments(spark, docs_of, odd_rows):
    rng = random.Random(9)
    words = [f"q{i}" for i in range(200)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([6, 11, 12, 20, 40, 59, 200])] + [(50, None), (51, ""), (52, "too short")]
    items.append((3, items[3][1]))
    docs = list(odd_rows)
    for i in range(100, 190):
        q = rng.choice(items[:7])[1].split()
        a = rng.randrange(max(1, len(q) - 11)) if rng.random() < 0.5 else 0
        part = q[a:]
        for p in range(rng.choice([0, 5, 7]), len(part), rng.choice([6, 8, 10, 1000])):
            part[p] = "other"
        docs.append((i, " ".join(text(rng.randrange(60)) + part + text(rng.randrange(60))).title()))
    docs.append((300, "nothing of the kind " * 20))
    df = docs_of(docs).withColumn("number", F.lit(1)).withColumn("item_id", F.lit(1))
    table = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.overlaps(df, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    kept = decontaminate.decontaminate(df, table).collect()
    bad = {r["doc_id"] for r in got}
    assert len(kept) == sum(i not in bad for i, _ in docs)
    assert decontaminate.overlaps(df.limit(0), table).collect() == [] and decontaminate.overlaps(df, table.limit(0)).collect() == []


def meets(equal, length):
    """Whether any stretch has 12 equal words (all, of a shorter item) and 80 % equal, tried one by one."""
    count = [0, *np.cumsum(equal).tolist()]
    return any(
        count[b] - count[a] >= min(12, length) and 5 * (count[b] - count[a]) >= 4 * (b - a)
        for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
    )


def replaced(n, k):
    return [[i not in out for i in range(n)] for out in itertools.combinations(range(n), k)]


def test_best_stretch_equals_all_stretches():
    rng = random.Random(4)
    rows = [*replaced(16, 2), *replaced(16, 3), *replaced(20, 3), [], [False] * 5, *([rng.random() < 0.75 for _ in range(40)] for _ in range(300))]
    for equal in rows:
        start, end, matched = decontaminate._best_stretch(np.array(equal, bool), 0.8)
        every = [(sum(equal[a:b]), a - b, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * sum(equal[a:b]) >= 4 * (b - a)]
        m, n, a = max([x for x in every if x[0] > 0], default=(0, 0, 0))
        assert (start, end, matched) == (-a, -a - n, m)


def test_every_overlap_of_the_stated_threshold_is_found(spark, docs_of):
    items, docs, want = [], [], set()
    for number, (n, k) in enumerate([(15, 3), (16, 2), (16, 3), (16, 4), (20, 4), (13, 2)]):
        item = [f"i{number}w{j}" for j in range(n)]
        items.append((number, " ".join(item)))
        for row, equal in enumerate(replaced(n, k)[:: 1 if n < 20 else 37]):
            doc = 10_000 * number + row
            docs.append((doc, " ".join(["left", *(w if same else "other" for w, same in zip(item, equal)), "right"])))
            want |= {(doc, number)} if meets(equal, n) else set()
    got = decontaminate.overlaps(docs_of(docs), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["matched"] >= 12 and 5 * r["matched"] >= 4 * r["length"] for r in got)
