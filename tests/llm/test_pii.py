"""Base spans against Python's patterns, selected spans on planted cases, redaction, and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from profilerec.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def card(rng, valid=True):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(d) == valid:
            return d


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    words = ["über", "la", "the", "of", "mañana", "call", "it", "x"]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(6, 30))]
        item = [
            f"n{i}.o@mail{i % 9}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng), card(rng, False),
            f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"{rng.randrange(256, 999)}.1.2.3", f"+{i}",
        ][i % 7]
        text[rng.randrange(len(text))] = item
        rows.append((i, " ".join(text)))
    return rows


def test_base_spans_equal_the_plain_patterns(spark, docs_of, odd_rows, planted):
    rng = random.Random(5)
    alphabet = ["1", "25", "4", ".", "@", "-", " ", "+", "(", ")", "a", "é", "_", "\n", "999", "𝒳", "%", "4532015112830366", "1.2.3.4"]
    noise = [(2000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(1500)]
    long = [(5000, "7" * 3000), (5001, "a." * 1500), (5002, "1.2.3.4 " * 600), (5003, "+1 23 " * 600), (5004, "a" * 3000 + "@b.c")]
    fixed = [(6000, "a@b.c_x@d.e"), (6001, "1.2.3.4.5.6.7.8"), (6002, "x@y z@w.v."), (6003, "4532015112830366"), (6004, "001.02.3.0255")]
    rows = [*[r for r in odd_rows if len(r[1] or "") < 10_000], *planted, *noise, *long, *fixed]
    docs = docs_of(rows).select("doc_id", "text", F.lit("clash").alias("base"), F.lit(1).alias("row")).repartition(6)
    got = pii.search(docs).select("row.doc_id", "row.text", "base").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["base"]] == plain(r["text"]), r["doc_id"]


def test_time_grows_with_very_long_texts(spark, docs_of):
    rows = [(1, "7" * 200_000), (2, "a." * 100_000), (3, "1.2.3.4 " * 10_000), (4, "+1 23 " * 20_000), (5, "a" * 150_000 + "@b.c")]
    got = {r["doc_id"]: r["base"] for r in pii.search(docs_of(rows)).select("row.doc_id", "base").collect()}
    assert [len(got[i]) for i in range(1, 6)] == [0, 0, 10_000, 0, 1]
    assert tuple(got[3][-1]) == ("ip", 79_992, 79_999) and tuple(got[5][0]) == ("email", 0, 150_004)


def test_selected_spans_and_redaction(spark, docs_of, planted):
    rng = random.Random(11)
    pair, wrong = f"{card(rng)} {card(rng)}", f"{card(rng, False)} {card(rng, False)}"
    near = "call +1 (826) 555-4081 190.137.223.204 now"
    extra = [(9001, f"the {pair} of"), (9002, near), (9003, f"the {wrong} of"), (9004, None), (9005, "")]
    docs = docs_of([*planted, *extra]).withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert len(got) == len(planted) + len(extra)
    spans = lambda i: [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]]
    assert spans(9001) == [("card", 4, 20), ("card", 21, 37)] and got[9001]["text"] == "the [card] [card] of"
    assert ("phone", 5, 22) in spans(9002) and ("ip", 23, 38) in spans(9002) and got[9002]["text"] == "call [phone] [ip] now"
    assert spans(9003) == [] and got[9004]["text"] is None and got[9005]["text"] == ""
    for i, text in planted:
        assert spans(i) == plain(text)
        assert not plain(text) or plain(text)[0][0] in got[i]["text"]


def test_no_rows_and_one_class(spark, docs_of):
    assert pii.redact(docs_of([]).limit(0)).collect() == []
    (one,) = pii.redact(docs_of([(1, "nothing here")])).collect()
    assert one["text"] == "nothing here" and one["spans"] == []


def test_pooled_thresholds():
    assert pii.lowest_score([(0, 0, 9), (5, 3, 4), (6, 2, 4), (9, 20, 20)], 10, 0.95, 5) == 0.9
    assert pii.lowest_score([(0, 0, 9), (9, 2, 2)], 10, 0.95, 5) is None
    assert pii.lowest_score([], 10, 0.95, 5) is None
    assert pii.lowest_score([(2, 1, 9), (3, 9, 9), (4, 8, 9), (5, 0, 9)], 10, 0.7, 5) is None


def test_trees_are_fitted_on_all_labelled_spans(spark, monkeypatch):
    weights = []

    class Watched(pii.GBTClassifier):
        def fit(self, rows):
            weights.append(rows.agg(F.sum("weight")).first()[0])
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Watched)
    span = F.struct(F.lit("ip").alias("kind"), F.lit(0).alias("start"), F.lit(7).alias("end"), (F.col("id") % 2).cast("int").alias("label"),
                    F.array(*[(F.col("id") % 10).cast("double")] * 17).alias("features"))
    selector = pii.fit(spark.range(40_000).select(F.array(span).alias("labelled")), pii.PiiOptions(trees=2, depth=2))
    assert weights == [30_000.0] and selector.thresholds["ip"] is not None
