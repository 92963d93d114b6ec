"""Formatting: layouts, round trips, masks and odd records."""

from pyspark.sql import functions as F

from profilerec.llm import chat


def formatted(df, columns):
    done = chat.format_turns(chat.canonical_turns(df, columns))
    return done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()


def test_each_layout_is_found_by_its_paths(spark):
    schema = (
        "id int, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
        "instruction string, input string, output string, system string, prompt string, completion string, response string, extra string"
    )
    none = (None,) * 10
    rows = [
        (1, [("user", "hi"), ("assistant", "yo")], *none[1:], ), (2, None, [("human", "hi"), ("gpt", "yo")], *none[2:]),
        (3, None, None, "do", None, "done", None, None, None, None, None), (4, None, None, "do", "this", "done", "be kind", None, None, None, None),
        (5, None, None, None, None, None, None, "q", "a", None, None), (6, None, None, None, None, None, None, "q", None, "a", None),
        (7, *none), (8, None, None, "do", None, "done", None, "q", None, None, None), (9, [], *none[1:]),
        (10, [("user", None), (None, "x")], *none[1:]),
    ]
    df = spark.createDataFrame(rows, schema)
    columns = [c for c in df.columns if c not in ("id", "extra")]
    got = {r["id"]: r for r in formatted(df, columns)}
    assert [got[i]["layout"] for i in range(1, 11)] == [
        "messages", "speakers", "instruction", "instruction", "prompt_completion", "prompt_response", None, None, "messages", "messages"]
    assert [tuple(t) for t in got[2]["back"]] == [("user", "hi"), ("assistant", "yo")]
    assert [tuple(t) for t in got[4]["back"]] == [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]
    assert got[7]["formatted"] is None and got[8]["turns"] is None
    assert got[9]["formatted"] == "" and got[9]["back"] == [] and got[9]["loss"] == ""
    assert [tuple(t) for t in got[10]["back"]] == [("user", ""), ("", "x")]
    assert got[1]["schema_hash"] == got[10]["schema_hash"] and got[1]["schema_hash"] != got[2]["schema_hash"]


def test_control_strings_round_trip_and_stay_out_of_the_text(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\3c \\5c5b \\", "|>\n", "", "é😀\r\n[", "x" * 100_000]
    rows = [(i, n, role, t) for i, t in enumerate(texts) for n, role in enumerate(["user", "a|>\n[", "assistant", "assistant"])]
    df = spark.createDataFrame(rows, "c int, turn int, role string, text string")
    records = chat.records_of_rows(df, "c", "turn", "role", "text")
    for r in formatted(records, ["messages"]):
        text = texts[r["c"]]
        assert [tuple(t) for t in r["back"]] == [(role, text) for role in ["user", "a|>\n[", "assistant", "assistant"]]
        assert r["loss"] == text * 2 and r["formatted"].count("<|end|>") == 4
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert all("<" not in s and "[" not in s for s in spans)


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, None, None, "x"), (1, 1, "assistant", "b", "x"), (None, 0, "user", "q", "x"), (1, None, "user", "first", "x")]
    df = spark.createDataFrame(rows, "c int, turn int, role string, text string, formatted string")
    records = chat.records_of_rows(df, "c", "turn", "role", "text").withColumn("formatted", F.lit("old")).withColumn("turns", F.lit(0)).withColumn("layout", F.lit(1))
    got = {r["c"]: r for r in formatted(records, ["messages"])}
    assert [tuple(t) for t in got[1]["back"]] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[None]["loss"] == ""
    assert formatted(records.limit(0), ["messages"]) == []


def test_formatting_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "c int, turn int, role string, text string")
    done = chat.format_turns(chat.canonical_turns(chat.records_of_rows(df, "c", "turn", "role", "text"), ["messages"]))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
