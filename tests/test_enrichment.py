"""The answer store across runs, counted model calls, single retries and failures."""

import os

from pyspark.sql import functions as F

from profilerec.operators import persona
from profilerec.plans import profiles
from profilerec.sources import adapters as A
from profilerec.sources.enrichment import EnrichmentStore

SF = "/root/testdata/sf0.001"
ITEMS = "array<struct<rank:int,name:string,category:string>>"


def records(spark, n):
    rows = [(f"u{i}", f"{i % 10}0-{i % 10}9", "F", "Regular", [(1, f"thing {i % 10}", "toys")]) for i in range(n)]
    return spark.createDataFrame(rows, f"user_id string, age_group string, gender string, behavior_cluster_label string, items {ITEMS}").repartition(1)


def counting(folder, fail=()):
    """A model that leaves one file per record it is asked for, and fails on the age groups in ``fail``."""

    def model(rows):
        import uuid

        for r in rows:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if any(r["age_group"] in fail for r in rows):
            raise RuntimeError("refused")
        return {r["cache_key"]: {"persona": f"model: {r['age_group']}"} for r in rows}

    return model


def test_the_model_runs_once_per_request_and_never_for_stored_ones(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = EnrichmentStore(spark, str(tmp_path / "store"), persona.PERSONA_COLUMNS)
    assert store.rows().count() == 0
    done, fresh = persona.personas_with_cache(records(spark, 40), store, counting(calls))
    assert done.count() == 40 and done.count() == 40 and fresh.count() == 10
    assert len(list(calls.iterdir())) == 10
    assert {r["persona"][:6] for r in done.collect()} == {"model:"} and store.rows().count() == 10
    again, none = persona.personas_with_cache(records(spark, 60), store, counting(calls))
    assert none.count() == 0 and len(list(calls.iterdir())) == 10
    first = {r["user_id"]: r["persona"] for r in done.collect()}
    assert {r["user_id"]: r["persona"] for r in again.collect() if r["user_id"] in first} == first


def test_bad_records_are_asked_alone_and_stay_open(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = EnrichmentStore(spark, str(tmp_path / "store"), persona.PERSONA_COLUMNS)
    done, fresh = persona.personas_with_cache(records(spark, 20), store, counting(calls, fail=("30-39",)), batch_size=20)
    counts = persona.failure_count(fresh).first()
    assert (counts["n_requests"], counts["n_failed"]) == (10, 1)
    assert [r["error"] for r in fresh.where("error is not null").collect()] == ["RuntimeError: refused"]
    assert len(list(calls.iterdir())) == 20  # one list of ten, then each alone
    texts = {r["age_group"]: r["persona"] for r in done.collect()}
    assert texts["20-29"] == "model: 20-29" and texts["30-39"].startswith("30-39 f customer")
    assert store.rows().count() == 9
    mended, later = persona.personas_with_cache(records(spark, 20), store, counting(calls))
    assert later.count() == 1 and len(list(calls.iterdir())) == 21
    assert {r["persona"] for r in mended.where("age_group = '30-39'").collect()} == {"model: 30-39"}


def test_commits_are_idempotent_and_broken_ones_do_not_count(spark, tmp_path):
    store = EnrichmentStore(spark, str(tmp_path / "store"), ["v"])
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "cache_key string, v string")
    store.append(one)
    store.append(one.repartition(2))
    assert len(store._batches()) == 1 and store.append(one.limit(0)).count() == 0
    store.append(spark.createDataFrame([("a", "other"), ("c", "3")], "cache_key string, v string"))
    got = {r["cache_key"]: r["v"] for r in store.rows().collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] in ("1", "other")
    assert {r["cache_key"]: r["v"] for r in EnrichmentStore(spark, store.path, ["v"]).rows().collect()} == got
    half = tmp_path / "store" / "batch-half"
    half.mkdir()
    assert {r["cache_key"]: r["v"] for r in store.rows().collect()} == got


def test_customer_profiles_use_the_store(spark, tmp_path):
    store = EnrichmentStore(spark, str(tmp_path / "store"), persona.PERSONA_COLUMNS)
    tables = A.customers(spark, SF), A.interactions_ord(spark, SF), A.products(spark, SF)
    calls = tmp_path / "calls"
    calls.mkdir()
    people, _ = profiles.customer_profiles(*tables, n_init=1, store=store, model=counting(calls))
    n = people.count()
    asked = len(list(calls.iterdir()))
    assert n == tables[0].select("user_id").distinct().count() and 0 < asked == store.rows().count()
    assert people.where(~F.col("persona").startswith("model:")).count() == 0
    assert {"persona", "interest_keywords", "purchase_motive"} <= set(people.columns)
