"""The driver's tables as logs.  Which column is the key and what is a tombstone is a convention of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL that Spark and DuckDB both run; {string} is the name of the text type.
EVENTS = """SELECT 'user:' || lpad(cast(user_id AS {string}), 6, '0') AS key, cast(event_id + 1 AS bigint) AS seq, event_type = 'error' AS tomb,
  CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events"""
ORDERS = """SELECT 'cust:' || lpad(cast(o_custkey AS {string}), 9, '0') AS key, cast(o_orderkey + 1 AS bigint) AS seq, o_orderstatus = 'F' AS tomb,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS value FROM orders"""
TURNS = """SELECT 'conv:' || lpad(cast(conv_id AS {string}), 6, '0') || ':' || lpad(cast(turn AS {string}), 3, '0') AS key, cast(conv_id * 1000 + turn + 1 AS bigint) AS seq,
  false AS tomb, true AS batch, cast(conv_id AS bigint) AS batch_id, turn = max(turn) OVER (PARTITION BY conv_id) AND role = 'assistant' AS batch_end, text AS value FROM conversations"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(string="string").replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's newest event; errors are tombstones."""
    return _view(spark, sf_dir, "events", EVENTS)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's newest order by key; finished ones are tombstones."""
    return _view(spark, sf_dir, "orders", ORDERS)


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, a batch for each conversation; one that does not end with the assistant is unfinished."""
    return _view(spark, sf_dir, "conversations", TURNS)
