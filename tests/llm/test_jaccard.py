"""Links and classes against all pairs of sets."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from profilerec.llm import jaccard


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set())
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    smallest = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((repr(rows[i][0]), len(sets[i]), smallest[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("options", [jaccard.JaccardOptions(), jaccard.JaccardOptions(words=5, percent=80, block=4, block_bytes=1000, spare_bits=0)])
def test_classes_equal_all_pairs(spark, docs_of, odd_rows, options):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(60)]
    rows = list(odd_rows)
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 90]))]
        for c in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy += [rng.choice(words) for _ in range(rng.choice([1, 5, 10]))]
            rows.append((100 + 20 * g + c, " ".join(copy)))
    got = jaccard.similarity_classes(docs_of(rows).withColumn("key", F.lit(1)).withColumn("component", F.lit(2)), options).collect()
    mine = sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"], r["links"]) for r in got)
    assert mine == brute(rows, options.words, options.percent)


def test_empty_table(docs_of):
    assert jaccard.similarity_classes(docs_of([])).collect() == []


def test_a_group_holds_one_pair_of_blocks(spark, docs_of, monkeypatch, tmp_path):
    """120 near copies in blocks of 4: no frame of a task may grow with their number."""
    rng, folder, apply = random.Random(3), str(tmp_path), PandasGroupedOpsMixin.applyInPandas

    def watched(self, func, schema):
        def counted(part):
            if "pair" in part.columns:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(len(part)))
            return func(part)

        return apply(self, counted, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", watched)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :])) for i in range(120) for p in [rng.randrange(120)]]
    options = jaccard.JaccardOptions(block=4, percent=80)
    got = jaccard.similarity_classes(docs_of(rows), options).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"], r["links"]) for r in got) == brute(rows, 4, 80)
    frames = [int(f.read_text()) for f in tmp_path.iterdir()]
    # 30 parts of 4 on average, dealt by hash: two of them may hold a few more.
    assert len(frames) >= 30 * 31 // 2 - 31 and max(frames) <= 32, (len(frames), max(frames))
