"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared CTEs: the logical tables as SQL.
EV = """ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id,
  json_extract_string(props, '$.k') AS product_id,
  CASE WHEN event_type = 'click' THEN 'like' ELSE event_type END AS event_type FROM events)"""
ORD = """od AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts,
  CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS product_id,
  CASE l_returnflag WHEN 'A' THEN 'view' WHEN 'R' THEN 'like' ELSE 'purchase' END AS event_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CUST = """cust AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_acctbal AS spend, c_mktsegment AS category,
  CAST(15 + c_custkey % 60 AS DOUBLE) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  (['S','M','L','XL'])[c_nationkey % 4 + 1] AS size FROM customer)"""
PROD = """prod AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_type AS category,
  p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
  p_size % 8 - 1 AS major_cluster, p_size % 3 AS sub_cluster FROM part)"""


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
