"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the three source files.
CUSTOMER_COLUMNS = {
    "Customer ID": "user_id", "Age": "age", "Gender": "gender", "Category": "category", "Size": "size",
    "Color": "color", "Season": "season", "Subscription Status": "subscription_status",
    "Shipping Type": "shipping_type", "Discount Applied": "discount_applied",
    "Promo Code Used": "promo_code_used", "Payment Method": "payment_method",
    "Frequency of Purchases": "frequency_of_purchases", "Purchase Amount (USD)": "spend",
    "Review Rating": "rating_avg", "Previous Purchases": "prev_purchases",
}
PRODUCT_COLUMNS = {
    "Uniqe Id": "product_id", "Product Name": "name", "Category": "category",
    "About Product": "about", "Product Details": "details", "Product Description": "description",
    "Technical Details": "technical_details", "Selling Price": "price", "Quantity": "quantity",
}
INTERACTION_COLUMNS = {
    "user id": "user_id", "product id": "product_id", "Interaction type": "event_type", "Time stamp": "ts",
}
CUSTOMER_NUMBERS = ("age", "spend", "rating_avg", "prev_purchases")
CUSTOMER_LABELS = (
    "gender", "category", "size", "color", "season", "subscription_status", "shipping_type",
    "discount_applied", "promo_code_used", "payment_method", "frequency_of_purchases",
)
PRODUCT_TEXTS = ("name", "category", "about", "details", "description", "technical_details")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is None:
            return reader.csv(path)
    return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_embeddings(df: DataFrame, path: str, key: str = "product_id", vector: str = "embedding") -> None:
    write_table(df.select(key, F.col(vector).cast("array<float>").alias(vector)), path)


def read_embeddings(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "product_id") -> DataFrame:
    """Stored vectors, matched to ``ids`` by key and never by position."""
    stored = read_table(spark, path)
    return stored if ids is None else ids.select(key).join(stored, key)


def json_map(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, json) rows; the values become one JSON object per key."""
    return df.select(F.col(key).cast("string").alias(key), F.to_json(F.struct(*values)).alias("json"))


def write_json_map(df: DataFrame, path: str, key: str, values: list[str]) -> None:
    df.select(key, *values).write.mode("overwrite").json(path)
