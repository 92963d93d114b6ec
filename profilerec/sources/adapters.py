"""Maps the star-schema test tables to the logical tables of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilerec.functions.ids import parse_money
from profilerec.sources.tables import read_table

EVENT_ORDER = ["event_id"]
ORDER_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def event_columns() -> list:
    """Projection of the event log to the interaction columns; ``click`` is a like."""
    return [
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.when(F.col("event_type") == "click", "like").otherwise(F.col("event_type")).alias("event_type"),
    ]


def interactions_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*event_columns())


def interactions_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        *ORDER_ORDER,
        F.col("l_shipdate").alias("ts"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(kind == "A", "view").when(kind == "R", "like").otherwise("purchase").alias("event_type"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    sizes = F.array(*[F.lit(s) for s in ("S", "M", "L", "XL")])
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.col("c_acctbal").alias("spend"),
        F.col("c_mktsegment").alias("category"),
        (F.lit(15) + F.pmod(key, F.lit(60))).cast("double").alias("age"),
        F.when(F.pmod(key, F.lit(2)) == 0, "F").otherwise("M").alias("gender"),
        F.element_at(sizes, (F.pmod(F.col("c_nationkey"), F.lit(4)) + 1).cast("int")).alias("size"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        money.alias("price_text"),
        parse_money(money).alias("price"),
        (F.pmod(F.col("p_size"), F.lit(8)) - 1).alias("major_cluster"),
        F.pmod(F.col("p_size"), F.lit(3)).alias("sub_cluster"),
    )


def product_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("product_id"), "embedding", "label"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
