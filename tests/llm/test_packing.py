"""Pieces put together again, mixture of windows, and ids against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from profilerec.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, rows, length):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    pieces = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in pieces:
        assert r["sequence_id"] * length + r["offset"] == at
        at += r["length"]
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(own.encode(t or "", add_special_tokens=False).ids + [0])
    assert at == sum(len(x) for v in texts.values() for x in v)
    for i, coded in texts.items():
        if len(coded) == 1:
            mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
            assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist() == coded[0]
            assert {r["doc_tokens"] for r in mine} == {len(coded[0])}


def test_pieces_hold_every_id_once(spark, docs_of, odd_rows):
    rows = [*odd_rows, (50, "<|endoftext|> it's 12 <|x|>  \n\n y\u3000z"), (51, "word " * 3000)]
    df = docs_of(rows, "a").union(docs_of([(60, "hello there " * 900)], "b")).union(docs_of([(61, "x")], None)).withColumn("queue", F.lit(3))
    options = packing.PackingOptions(length=64, window=4)
    check(packing.pack(df.repartition(3), PATH, options).collect(), [*rows, (60, "hello there " * 900), (61, "x")], 64)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_windows_hold_the_target_shares(spark, docs_of):
    df = docs_of([(i, "alpha beta gamma " * 40) for i in range(60)], "a").union(docs_of([(100 + i, "delta epsilon " * 70) for i in range(20)], "b"))
    options = packing.PackingOptions(length=32, window=8, targets=(("a", 1.0), ("b", 3.0)))
    pieces = packing.pack(df, PATH, options, with_ids=False).toPandas()
    pieces["window"] = pieces["sequence_id"] // 8
    b = pieces[pieces["doc_id"] >= 100].groupby("window")["length"].sum()
    assert (abs(b.iloc[:8] - 192) <= 3).all()  # three of four in each window until the queue is empty
    with pytest.raises(KeyError):
        pieces["ids"]


def test_few_queues_share_the_rest(spark, docs_of):
    df = docs_of([(1, "a " * 50)], "a")
    for i in range(2, 9):
        df = df.union(docs_of([(i, "b " * 50)], f"s{i}"))
    rows = packing.pack(df, PATH, packing.PackingOptions(length=16, queues=2)).collect()
    check(rows, [(1, "a " * 50), *[(i, "b " * 50) for i in range(2, 9)]], 16)


def test_a_source_of_few_long_documents_has_its_own_queue(spark, docs_of):
    """300 sources of two short documents and two of a single long one: windows hold the shares of both."""
    rows = [(i, "word " * 3, "en", f"s{i % 300:03d}", 15) for i in range(600)] + [(1000 + i, "long " * 2000, "en", "yz"[i], 10000) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    options = packing.PackingOptions(length=128, window=4)
    pieces = packing.pack(df, PATH, options).collect()
    check(pieces, [r[:2] for r in rows], 128)
    total = sum(r["length"] for r in pieces)
    for doc in (1000, 1001):
        share = 3 * 512 * sum(r["length"] for r in pieces if r["doc_id"] == doc) / total
        early = sum(r["length"] for r in pieces if r["doc_id"] == doc and r["sequence_id"] < 12)
        # Single tokens of the 300 small queues fall into the same rounds and shift a window.
        assert abs(early - share) <= 310


def test_missing_targets_share_the_rest(spark, docs_of):
    df = docs_of([(i, "alpha beta gamma " * 40) for i in range(20)], "a")
    df = df.union(docs_of([(100 + i, "delta epsilon " * 70) for i in range(60)], "b")).union(docs_of([(200 + i, "zeta eta " * 70) for i in range(60)], "c"))
    pieces = packing.pack(df, PATH, packing.PackingOptions(length=32, window=8, targets=(("a", 0.5),)), with_ids=False).toPandas()
    a = pieces[pieces["doc_id"] < 100].groupby(pieces["sequence_id"] // 8)["length"].sum()
    assert (abs(a.iloc[:8] - 128) <= 3).all()
    with pytest.raises(ValueError):
        packing.pack(df, PATH, packing.PackingOptions(targets=(("a", 1.0),)))
