"""The registered queries, one or more for each operator, and SQL for the same results.

Ranges carry ``pos``, the place in the order of keys, because results are compared without order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import record_crc
from ..functions.tables import shared_dir, with_position
from . import views
from .views import conversations_log, events_log, orders_log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_EVENTS, _ORDERS, _TURNS = (x.format(string="varchar") for x in (views.EVENTS, views.ORDERS, views.TURNS))
LOW, HIGH, LIMIT, CAP = "user:000010", "user:000019", 5, 7
_SIZE = "29 + strlen(key) + strlen(value)"


def _sql(select: str, log: str = _EVENTS, more: str = "") -> str:
    """``select`` over log (all records), won (newest ones) and state (live ones)."""
    return f"""WITH log AS ({log}){more},
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
state AS (SELECT * FROM won WHERE NOT tomb)
{select}"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` of a limited range with their place; there are as many as the limit says."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("key")).cast("long"))


_POS = "cast(row_number() OVER (ORDER BY key) AS bigint) AS pos"


@query(f"WITH log AS ({_EVENTS}) SELECT key, seq, tomb, value FROM log")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).select("key", "seq", "tomb", "value")


@query(_sql(f"SELECT key, seq, tomb, cast({_SIZE} AS bigint) AS size FROM won", _ORDERS))
def latest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_view(orders_log(spark, sf_dir))


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.live(orders_log(spark, sf_dir)).select("key", "seq", "value")


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def live_state_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest_by_window(orders_log(spark, sf_dir)).where("not tomb").select("key", "seq", "value")


@query(_sql("SELECT key, seq, value FROM state WHERE key = 'user:000000'"))
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.get(events_log(spark, sf_dir), "user:000000")


@query(_sql("SELECT (SELECT min(key) FROM won WHERE tomb) AS key, cast(count(*) AS bigint) AS n FROM state WHERE key = (SELECT min(key) FROM won WHERE tomb)"))
def point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    key = op.index_view(log).where("tomb").agg(F.min("key").alias("key")).first()["key"]
    return op.get(log, key).agg(F.lit(key).alias("key"), F.count("*").alias("n"))


@query(_sql(f"SELECT key, seq, value, {_POS} FROM state WHERE key BETWEEN '{LOW}' AND '{HIGH}'"))
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(op.scan_range(events_log(spark, sf_dir), LOW, HIGH), "key")


@query(_sql(f"SELECT key, seq, value, {_POS} FROM state WHERE key <= '{HIGH}'"))
def range_open_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(op.scan_range(events_log(spark, sf_dir), None, HIGH), "key")


@query(_sql(f"SELECT key, seq, value, {_POS} FROM state WHERE key >= '{LOW}'"))
def range_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(op.scan_range(events_log(spark, sf_dir), LOW, ""), "key")


@query(_sql(f"SELECT key, seq, value, {_POS} FROM state", _ORDERS))
def range_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(op.scan_range(orders_log(spark, sf_dir)), "key")


@query(_sql(f"SELECT *, {_POS} FROM (SELECT key, seq, value FROM state WHERE key >= '{LOW}' ORDER BY key LIMIT {LIMIT})"))
def range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(op.scan_range(events_log(spark, sf_dir), LOW, None, LIMIT))


@query(_sql(f"SELECT *, {_POS}, (SELECT count(*) FROM state) > {CAP} AS has_more FROM (SELECT key, seq, value FROM state ORDER BY key LIMIT {CAP})"))
def range_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = op.scan_capped(events_log(spark, sf_dir), limit=1000, cap=CAP)
    return _placed(rows).withColumn("has_more", F.lit(more))


@query(_sql("SELECT cast(count(*) AS bigint) AS n FROM state WHERE false"))
def range_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scan_range(events_log(spark, sf_dir), HIGH, LOW).agg(F.count("*").alias("n"))


@query(_sql(f"SELECT *, {_POS} FROM (SELECT key, seq, value FROM state WHERE key > (SELECT max(key) FROM (SELECT key FROM state ORDER BY key LIMIT {LIMIT})) ORDER BY key LIMIT {LIMIT})"))
def range_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    last = op.scan_range(log, limit=LIMIT).agg(F.max("key")).first()[0]
    return _placed(op.next_page(log, last, limit=LIMIT))


@query(_sql("SELECT key, seq, value FROM state", f"SELECT * FROM ({_EVENTS}) UNION ALL SELECT * FROM (SELECT key, seq + 10000000, false, 'new' FROM ({_EVENTS}) AS x WHERE seq % 97 = 0)"))
def put_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    newer = log.where("seq % 97 = 0").select("key", (F.col("seq") + 10_000_000).alias("seq"), F.lit(False).alias("tomb"), F.lit("new").alias("value"))
    return op.live(op.apply_records(log, newer)).select("key", "seq", "value")


def _unlucky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").selectExpr("'cust:' || lpad(cast(c_custkey AS string), 9, '0') AS key")


_UNLUCKY = "SELECT 'cust:' || lpad(cast(c_custkey AS varchar), 9, '0') AS key FROM customer WHERE c_custkey % 3 = 0"


@query(_sql("SELECT key, seq, value FROM state WHERE key NOT IN (SELECT key FROM gone)", _ORDERS, f", gone AS ({_UNLUCKY})"))
def delete_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    base = log.agg(F.max("seq")).first()[0]
    dead = op.tombstones(log, _unlucky(spark, sf_dir), base).select(*log.columns)
    return op.live(op.apply_records(log, dead)).select("key", "seq", "value")


@query(_sql("SELECT key, cast((SELECT max(seq) FROM log) + row_number() OVER (ORDER BY key) AS bigint) AS seq, true AS tomb FROM state WHERE key IN (SELECT key FROM gone)", _ORDERS, f", gone AS ({_UNLUCKY})"))
def delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return op.tombstones(log, _unlucky(spark, sf_dir), log.agg(F.max("seq")).first()[0]).select("key", "seq", "tomb")


@query(_sql("SELECT DISTINCT key FROM gone WHERE key NOT IN (SELECT key FROM state)", _ORDERS, f", gone AS ({_UNLUCKY})"))
def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.missing_keys(orders_log(spark, sf_dir), _unlucky(spark, sf_dir))


_PAIRS = "SELECT 'brand:' || p_brand AS key, p_name AS value, p_partkey AS ord FROM part"


@query("SELECT key, cast(max(ord_rank) AS bigint) AS seq, arg_max(value, ord_rank) AS value FROM (SELECT *, 100 + row_number() OVER (ORDER BY ord) AS ord_rank FROM (" + _PAIRS + ")) GROUP BY key")
def batch_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_PAIRS.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return op.live(op.puts(rows, 100, "ord", batch_id=1)).select("key", "seq", "value")


@query(f"WITH log AS ({_TURNS}) SELECT key, seq, batch_id, batch_end, value FROM log WHERE batch_id IN (SELECT batch_id FROM log WHERE batch_end)")
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.batch_gate(conversations_log(spark, sf_dir)).select("key", "seq", "batch_id", "batch_end", "value")


@query(f"WITH log AS ({_TURNS}) SELECT batch_id, cast(count(*) AS bigint) AS records FROM log GROUP BY batch_id HAVING NOT bool_or(batch_end)")
def batch_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unfinished_batches(conversations_log(spark, sf_dir))


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def apply_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return op.live(op.apply_records(op.apply_records(log, log), log.where("seq % 2 = 0"))).select("key", "seq", "value")


@query(f"WITH log AS ({_ORDERS}) SELECT key, cast(count(DISTINCT seq) AS bigint) AS records FROM log GROUP BY key")
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return op.deduplicated(log.unionByName(log)).groupBy("key").agg(F.count("*").alias("records"))


@query("SELECT cast(0 AS bigint) AS conflicts")
def same_seq_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return op.same_seq_conflicts(log.unionByName(log)).agg(F.count("*").alias("conflicts"))


@query(_sql("SELECT key, seq, value FROM state"))
def late_older_loses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    older = log.select("key", (F.col("seq") - 10_000_000).alias("seq"), F.lit(False).alias("tomb"), F.lit("late").alias("value"))
    return op.live(op.apply_records(log, older)).select("key", "seq", "value")


@query(f"WITH log AS ({_EVENTS}) SELECT key, seq, tomb, value FROM log WHERE seq > 900")
def records_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.records_since(events_log(spark, sf_dir), 900, merge_seq=100).select("key", "seq", "tomb", "value")


@query(f"WITH log AS ({_TURNS}) SELECT key, seq, false AS batch, false AS batch_end, value FROM log")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.snapshot(conversations_log(spark, sf_dir)).select("key", "seq", "batch", "batch_end", "value")


@query(_sql("SELECT key, seq, tomb, value FROM state", _ORDERS))
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.compact_log(orders_log(spark, sf_dir)).select("key", "seq", "tomb", "value")


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def compact_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    barrier = log.agg((F.max("seq") / 2).cast("long")).first()[0]
    old = op.compact_log(log.where(F.col("seq") <= barrier)).select(*log.columns)
    return op.live(op.apply_records(old, op.records_since(log, barrier, barrier))).select("key", "seq", "value")


_SPACE = f"""SELECT cast((SELECT count(*) FROM state) AS bigint) AS keys, cast((SELECT count(*) FROM won WHERE tomb) AS bigint) AS tombstones,
  cast((SELECT sum({_SIZE}) FROM state) AS bigint) AS live_bytes, cast(sum({_SIZE}) - (SELECT sum({_SIZE}) FROM state) AS bigint) AS dead_bytes, cast(sum({_SIZE}) AS bigint) AS total_bytes,
  cast(round((sum({_SIZE}) - (SELECT sum({_SIZE}) FROM state)) / sum({_SIZE}), 3) AS double) AS reclaimable, max(seq) AS max_seq, cast(count(*) AS bigint) AS records FROM log"""


@query(_sql(_SPACE))
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.space(events_log(spark, sf_dir))


@query(_sql(_SPACE, _ORDERS))
def stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.space(orders_log(spark, sf_dir))


@query(_sql(f"SELECT sum({_SIZE}) - (SELECT sum({_SIZE}) FROM state) >= 0.4 * sum({_SIZE}) AS should_compact FROM log", _ORDERS))
def should_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.should_compact(orders_log(spark, sf_dir), files=2)


@query("SELECT cast(count(*) FILTER (p_brand IS NULL OR p_partkey % 10 = 0) AS bigint) AS empty_keys, cast(count(*) FILTER (p_partkey % 10 = 1) AS bigint) AS large_keys, cast(0 AS bigint) AS large_values, cast(count(*) AS bigint) AS rows FROM part")
def validate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN repeat('k', 65537) ELSE p_brand END AS key", "p_name AS value")
    return op.input_faults(rows)


@query(f"WITH log AS ({_EVENTS}) SELECT key, seq, value FROM log WHERE seq % 50 <> 0")
def crc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    damaged = log.withColumn("crc", record_crc(log)).withColumn("value", F.when(F.col("seq") % 50 == 0, F.concat(F.col("value"), F.lit("x"))).otherwise(F.col("value")))
    return op.verified(damaged, "skip").select("key", "seq", "value")


@query("SELECT s_suppkey AS id, cast(round(s_acctbal) AS bigint) AS seq FROM supplier ORDER BY seq DESC, id LIMIT 1")
def elect(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal").cast("long").alias("seq"))
    return op.elect(votes, nodes=11)


def _store(spark: SparkSession, name: str):
    from pyspark.sql.types import StringType

    from ..sources.store import Store

    return Store(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", StringType())


def _filled(spark: SparkSession, sf_dir: str):
    """A store with the orders log in three commits, of which the last repeats part of the first."""
    log = _as_records(orders_log(spark, sf_dir))
    store = _store(spark, "orders")
    half = log.agg((F.max("seq") / 2).cast("long")).first()[0]
    store.apply(log.where(F.col("seq") > half))
    store.apply(log.where(F.col("seq") <= half))
    store.apply(log.where(F.col("seq") % 7 == 0))
    return store


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).state().select("key", "seq", "value")


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.compact()
    return store.checked().select("key", "seq", "value")


@query(_sql("SELECT key, value FROM state WHERE key NOT IN (SELECT key FROM gone)", _ORDERS, f", gone AS ({_UNLUCKY})"))
def store_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete_all(_unlucky(spark, sf_dir))
    return store.state().select("key", "value")


def _as_records(log: DataFrame) -> DataFrame:
    return log.selectExpr("key", "seq", "cast(0 AS bigint) AS ts_ns", "tomb", "false AS batch", "false AS batch_end", "cast(null AS bigint) AS batch_id", "value")


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest-wins state kept by a stream over the log's files, run to the end of what is there."""
    from ..streaming import keep_latest, read_log_stream

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = _as_records(orders_log(spark, sf_dir))
    log.repartition(4).write.parquet(f"{folder}/log")
    store = _store(spark, "newest")
    keep_latest(read_log_stream(spark, f"{folder}/log", log.schema, max_files=2), store, f"{folder}/checkpoint").awaitTermination()
    return store.state().select("key", "seq", "value")


@query(f"WITH log AS ({_ORDERS}) SELECT cast(count(*) + count(*) FILTER (seq % 7 = 0) AS bigint) AS records, cast(count(*) FILTER (seq % 50 = 0) + count(*) FILTER (seq % 50 = 0 AND seq % 7 = 0) AS bigint) AS damaged FROM log")
def store_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values altered behind the store's back: how many records there are, and how many a verified read refuses."""
    from ..sources.manifest import Version

    store = _filled(spark, sf_dir)
    at = store.version()
    stored = spark.read.parquet(*[f"{store.path}/{c['path']}" for c in at.commits])
    altered = stored.withColumn("value", F.when(F.col("seq") % 50 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    altered.write.parquet(f"{store.path}/data/altered")
    store.manifest.publish(Version(at.version + 1, [{"id": 1, "path": "data/altered", "records": 0}], at.last_seq, 0, [], at.next_commit + 1))
    counts = store.log(verify="no").agg(F.count("*").alias("records")).join(store.log(verify="skip").agg(F.count("*").alias("sound")))
    return counts.select("records", (F.col("records") - F.col("sound")).alias("damaged"))


@query(f"WITH log AS ({_EVENTS}) SELECT file_id, key, seq, tomb, value FROM (SELECT *, seq % 4 AS file_id, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq) AS nth FROM log) WHERE file_id <> 3 OR nth <= 20")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary record files: one ends in the middle of a record, one has a damaged record, after which nothing is read."""
    from ..sources.recordfiles import parse_files, record_bytes

    log = _as_records(events_log(spark, sf_dir)).withColumn("file_id", F.col("seq") % 4)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    one = F.hex(record_bytes())
    damaged = F.when((F.col("file_id") == 3) & (F.col("nth") == 21), F.concat(F.lit("00000000"), F.substring(one, 9, 1 << 30))).otherwise(one)
    files = log.withColumn("nth", rank).select("file_id", F.struct("nth", damaged.alias("hex")).alias("r")).groupBy("file_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    whole = F.unhex(F.concat(F.array_join(F.transform("rows", lambda r: r["hex"]), ""), F.when(F.col("file_id") == 1, "0102030405").otherwise("")))
    parsed = parse_files(files.select("file_id", whole.alias("content")))
    return parsed.select("file_id", F.col("key").cast("string").alias("key"), "seq", "tomb", F.col("value").cast("string").alias("value"))


@query(_sql("SELECT key, seq, value FROM state", _ORDERS))
def stream_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower that starts before a compaction, is left behind by it, and catches up."""
    from ..streaming import follow

    source, replica = _filled(spark, sf_dir), _store(spark, "replica")
    follow(source, replica, f"{replica.path}-checkpoint").awaitTermination()
    source.compact()
    follow(source, replica, f"{replica.path}-checkpoint").awaitTermination()
    return replica.state().select("key", "seq", "value")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: an ordered range of the live state."""
    return op.scan_range(events_log(spark, "/root/testdata/sf0.001"), LOW, HIGH)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
