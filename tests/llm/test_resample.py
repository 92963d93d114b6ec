"""Importance weights and draws against a plain program, for unigrams and longer runs, and odd rows."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profilerec.llm import resample
from profilerec.llm.resample import ResampleOptions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, most):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, o):
    bucket = lambda g: zlib.crc32(g.encode()) % o.buckets
    count = [[0] * o.buckets, [0] * o.buckets]
    for side, texts in enumerate(([t for _, t in rows], target)):
        for t in texts:
            for g in grams(t, o.grams)[1]:
                count[side][bucket(g)] += 1
    big_s, big_t = sum(count[0]), sum(count[1])
    gain = [math.floor(1000 * math.log(((t + 1) * (big_s + o.buckets)) / ((s + 1) * (big_t + o.buckets)))) for s, t in zip(*count)]
    out, fit = [], []
    for i, text in rows:
        words, found = grams(text, o.grams)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{o.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= o.least_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * o.percent // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


@pytest.mark.parametrize("options", [ResampleOptions(grams=1), ResampleOptions(grams=3, buckets=97, least_words=3, percent=55)])
def test_equals_a_plain_program(spark, docs_of, odd_rows, options):
    rows = [*odd_rows, (20, "MIXED Case,punctuation;ünï-cödé 42"), (21, "\x00\x7f--"), (22, "de la x")]
    rows += [(100 + i, " ".join(f"w{(i * j) % 31}" for j in range(5 + i % 40))) for i in range(120)]
    target = ["w1 w2 w3 w4 w5 w5", None, "", "cödé 42 w7"]
    docs = docs_of(rows).withColumn("weight", F.lit("old")).withColumn("rank", F.lit(1)).withColumn("extra", F.lit(2)).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = resample.resample(docs, bench, options)
    assert rows_of(got) == plain(rows, target, options)
    assert set(docs.columns) < set(got.columns) and got.where("extra = 2").count() == len(rows)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "some words")], "item_id int, text string")
    docs = docs_of([(i, "some words " * 20) for i in range(30)])
    assert resample.resample(docs.limit(0), bench).collect() == []
    options = ResampleOptions(grams=2)
    assert rows_of(resample.resample(docs, bench.limit(0), options)) == plain([(i, "some words " * 20) for i in range(30)], [], options)


def test_rows_like_the_target_are_drawn_more_often(spark, docs_of):
    rows = [(i, " ".join(f"{'near' if i % 4 == 0 else 'far'}{(i + j) % 17}" for j in range(25))) for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(f"near{j}" for j in range(17))) for i in range(40)], "item_id int, text string")
    drawn = [r["doc_id"] for r in resample.resample(docs_of(rows), bench).where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) >= 30


def test_a_batch_of_several_groups_of_texts():
    texts = [f"É{'x' * (i % 50)} Ünï {i} " * 40 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    options, at = ResampleOptions(grams=2, buckets=1000), 0
    pieces = list(resample._pieces(batch, "text"))
    assert len(pieces) > 2
    for piece, column in pieces:
        found = resample.Features(column, options)
        ends = found.n_features.cumsum()
        for i in range(0, len(piece), 97):
            want = [zlib.crc32(g.encode()) % 1000 for g in grams(texts[at + i], 2)[1]]
            assert sorted(found.bucket[ends[i] - found.n_features[i] : ends[i]].tolist()) == sorted(want)
        at += len(piece)
    assert at == len(texts)
