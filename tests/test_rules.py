"""Literal edge cases of the column rules."""

import pytest
from pyspark.sql import functions as F

from profilerec.functions import ids, rules, text
from profilerec.operators.rfm import candidate_ks, choose_k


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def one(spark, inputs, fn, kind="string"):
    return values(spark, [(v,) for v in inputs], f"x {kind}", fn(F.col("x")))


def test_user_ids(spark):
    cases = {
        None: "", "  ": "", "2.0": "2", " 7 ": "7", "1e3": "1000", "2.50": "2.5", "A1": "A1", "1.0d": "1.0d", "nan": "nan",
        "inf": "inf", "12345678.5": "12345678.5", "0.001": "0.001", "0.00005": "5e-05", "-3.0": "-3",
    }
    assert one(spark, list(cases), ids.normalize_user_id) == list(cases.values())


def test_product_ids(spark):
    cases = {None: "", " ab_12 ": "ab", "a_1_2": "a_1", "a_1x": "a_1x", "_9": ""}
    assert one(spark, list(cases), ids.normalize_product_id) == list(cases.values())


def test_money(spark):
    cases = {"$1,234.50": 1234.5, "-3": -3.0, "Total: 5": 5.0, "": None, "1.2.3": None, "$10 - $20": None}
    assert one(spark, list(cases), ids.parse_money) == list(cases.values())


def test_timestamps(spark):
    cases = {
        "2024-01-02 03:04:05": "2024-01-02 03:04:05", "02/01/2024 03:04": "2024-02-01 03:04:00",
        "13/01/2024 03:04": "2024-01-13 03:04:00", "bad": None,
    }
    got = one(spark, list(cases), ids.parse_timestamp)
    assert [str(v) if v else None for v in got] == list(cases.values())


def test_age_groups(spark):
    cases = [(0, "10s"), (19, "10s"), (19.5, "20s"), (29, "20s"), (59.01, "60+"), (200, "60+"), (201, "unknown"),
             (-1, "unknown"), (None, "unknown")]
    got = one(spark, [None if a is None else float(a) for a, _ in cases], rules.age_group, "double")
    assert got == [g for _, g in cases]


@pytest.mark.parametrize("row,stage", [
    (("view", 60, 1, 0, 0), "Dormant"), (("purchase", 59, 0, 0, 1), "Post-Purchase"), (("view", 0, 1, 0, 1), "Action"),
    (("like", 0, 3, 1, 0), "Desire"), (("like", 0, 2, 1, 0), "Interest"), (("view", 0, 1, 0, 0), "Awareness"),
    (("view", 0, 1, 1, 0), "Unknown"), (("signup", 0, 0, 0, 0), "Unknown"),
])
def test_journey_stage(spark, row, stage):
    got = values(spark, [row], "a string, d int, v int, l int, p int",
                 rules.journey_stage(F.col("a"), F.col("d"), F.col("v"), F.col("l"), F.col("p")))
    assert got == [stage]


@pytest.mark.parametrize("flags,label", [
    ("TTTT", "VIP Explorer"), ("TTTF", "Low-Value Loyal"), ("TTFF", "Low-Value Loyal"), ("FTTF", "At-Risk High-Value"),
    ("TFFT", "New Explorer"), ("FFTT", "Dormant"), ("TTFT", "Regular"),
])
def test_segment_label(spark, flags, label):
    recent, frequent, valuable, diverse = (f == "T" for f in flags)
    row = (4.0 if recent else 6.0, 6.0 if frequent else 4.0, 6.0 if valuable else 4.0, 6.0 if diverse else 4.0)
    middle = {c: F.lit(5.0) for c in ("recency", "frequency", "monetary", "involvement_diversity")}
    got = values(spark, [row], "a double, b double, c double, d double",
                 rules.segment_label(F.col("a"), F.col("b"), F.col("c"), F.col("d"), middle))
    assert got == [label]


def test_weights(spark):
    rows = [(5.0, "Regular"), (4.0, "VIP Explorer"), (4.0, "Regular")]
    args = (F.col("i"), F.lit(5.0), F.col("s"))
    assert values(spark, rows, "i double, s string", rules.cf_weight(*args)) == [0.4, 0.4, 0.7]
    assert values(spark, rows, "i double, s string", rules.llm_weight(*args)) == [0.6, 0.6, 0.3]


def test_choose_k():
    assert choose_k([5, 6, 7], [10, 6, 5]) == 6
    assert choose_k([2, 3], [4, 1]) == 3
    assert candidate_ks(1) == [1] and candidate_ks(3) == [2, 3] and candidate_ks(6) == [5, 6]


def test_keyword_overlap(spark):
    got = values(spark, [("#solo, #set", "Solo, big set", "")], "a string, b string, c string",
                 text.keyword_overlap(F.col("a"), F.col("b"), F.col("c")))
    assert got == [2]


def test_merge_dedupe(spark):
    got = values(spark, [(["a", "b", "c"], ["b", "d", "a"])], "a array<string>, b array<string>",
                 text.merge_dedupe_ordered(F.col("a"), F.col("b")))
    assert got == [["a", "b", "c", "d"]]


def test_keywords_and_terms(spark):
    got = values(spark, [(["#Solo ", "and", "solo", "ab", "Big--Set!", "x y z"],)], "a array<string>",
                 text.normalize_keywords(F.col("a"), 5))
    assert got == [["solo", "big--set", "x y z"]]
    got = values(spark, [(["red ring red", "blue ring", "the item"],)], "a array<string>", text.top_terms(F.col("a"), 3))
    assert got == [["red", "ring", "blue"]]


def test_json_block(spark):
    cases = ['say {"a": {"b": 1}} ok', "{broken", "none", '{"a": }']
    assert one(spark, cases, text.json_block) == ['{"a": {"b": 1}}', None, None, None]
