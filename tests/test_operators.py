"""Operators on small logs: order of events, tombstones, batches, ranges, checksums."""

import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake import operators as op
from seqlake.functions import CorruptRecord, NeedFullSync, log_schema, record_crc, record_size

S = log_schema(T.StringType())


def log(spark, *rows):
    """Rows (key, seq, value or None for a tombstone[, batch_id, ends])."""
    return spark.createDataFrame([(k, s, 0, v is None, bool(b), bool(b and b[1]), b[0] if b else None, v or "") for k, s, v, *b in [(*r[:3], *r[3:]) for r in rows] for b in [b]], S)


def state(df):
    return {r.key: r.value for r in op.live(df).collect()}


def test_newest_wins_then_tombstones_go(spark):
    df = log(spark, ("a", 1, "1"), ("a", 2, None), ("b", 3, "x"), ("b", 5, ""), ("c", 9, None), ("c", 4, "old"))
    assert state(df) == {"b": ""}
    assert {r.key for r in df.where("not tomb").groupBy("key").agg(F.max("seq")).collect()} == {"a", "b", "c"}  # what filtering first would give


def test_both_plans_of_latest_agree(spark, sf_dir):
    from seqlake.plans.views import orders_log

    df = orders_log(spark, sf_dir)
    assert sorted(map(tuple, op.latest(df).collect())) == sorted(map(tuple, op.latest_by_window(df).collect()))


def test_apply_in_any_order_and_repeatedly(spark):
    rows = [("a", 1, "1"), ("b", 2, "2"), ("a", 3, "3"), ("b", 4, None)]
    df = log(spark, *[rows[i] for i in (2, 0, 3, 1, 0, 3, 2)])
    assert state(df) == {"a": "3"}
    assert op.deduplicated(df).count() == 4
    assert op.same_seq_conflicts(df).isEmpty()
    assert [tuple(r) for r in op.same_seq_conflicts(log(spark, ("a", 1, "x"), ("a", 1, "y"))).collect()] == [("a", 1)]


def test_tombstone_before_an_older_put(spark):
    assert state(log(spark, ("k", 2, None), ("k", 1, "value"))) == {}


def test_unfinished_batch_is_left_out(spark):
    df = log(spark, ("before", 1, "kept"), ("b1", 2, "x", 7, False), ("b2", 3, "x", 7, False), ("c1", 4, "x", 8, False), ("c2", 5, "x", 8, True))
    assert set(state(op.batch_gate(df))) == {"before", "c1", "c2"}
    assert [tuple(r) for r in op.unfinished_batches(df).collect()] == [(7, 2)]


def test_compaction_and_snapshot_strip_batches(spark):
    df = log(spark, ("b1", 1, "one", 1, False), ("b2", 2, "two", 1, True), ("b2", 3, "new"))
    for out in (op.compact_log(df), op.snapshot(df)):
        assert [(r.key, r.seq, r.batch, r.batch_end, r.batch_id) for r in out.orderBy("key").collect()] == [("b1", 1, False, False, None), ("b2", 3, False, False, None)]


def test_ranges(spark):
    rows = [(f"key{i:03d}", i + 1, f"val{i:03d}") for i in range(100)] + [("aaa", 201, "first"), ("zzz", 202, "last"), ("key050", 300, None)]
    df = log(spark, *rows)
    keys = lambda *a, **b: [r.key for r in op.scan_range(df, *a, **b).collect()]
    assert keys("key010", "key019") == [f"key{i:03d}" for i in range(10, 20)]
    assert len(keys()) == 101 and keys() == sorted(keys())
    assert keys("key049", "key051") == ["key049", "key051"]
    assert keys("key019", "key010") == []
    assert keys("", "", limit=5) == ["aaa", "key000", "key001", "key002", "key003"]
    page, more = op.scan_capped(df, limit=7, cap=10)
    assert page.count() == 7 and more
    page, more = op.scan_capped(df, "key090", "key099", cap=10)
    assert page.count() == 10 and not more
    assert [r.key for r in op.next_page(df, "key003", limit=2).collect()] == ["key004", "key005"]


def test_long_run_of_deleted_keys(spark):
    base = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(False).alias("tomb"), F.lit("v").alias("value"))
    dead = base.where("key < 'k02960'").select("key", (F.col("seq") + 3000).alias("seq"), F.lit(True).alias("tomb"), F.lit("").alias("value"))
    df = base.unionByName(dead)
    assert op.scan_range(df).count() == 40 and op.scan_range(df, limit=3).first().key == "k02960"


def test_key_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0, False, False, False, None, "x")], S).write.parquet(f"{tmp_path}/log")
    plan = op.get(spark.read.parquet(f"{tmp_path}/log"), "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan


def test_records_since_needs_a_full_sync_behind_a_compaction(spark):
    df = log(spark, ("a", 1, "x"), ("b", 2, "y"))
    assert op.records_since(df, 1, 1).count() == 1
    with pytest.raises(NeedFullSync):
        op.records_since(df, 0, 1)


def test_checksums(spark):
    df = log(spark, ("k", 1, "the quick brown fox"), ("q", 2, None))
    df = df.withColumn("crc", record_crc(df))
    assert op.verified(df).count() == 2
    assert df.where("key = 'k'").first().crc == zlib.crc32(b"1pk\0the quick brown fox")
    bad = df.withColumn("value", F.concat("value", F.lit("!")))
    assert op.verified(bad, "skip").count() == 0
    with pytest.raises(Exception, match="checksum"):
        op.verified(bad).collect()
    with pytest.raises(CorruptRecord):
        op.verified(df, "perhaps")


def test_sizes_and_space(spark):
    df = log(spark, ("a", 1, "12345"), ("a", 2, "1"), ("b", 3, None))
    assert [r.s for r in df.select(record_size().alias("s")).collect()] == [35, 31, 30]
    assert op.space(df).first().asDict() == {"keys": 1, "tombstones": 1, "live_bytes": 31, "dead_bytes": 65, "total_bytes": 96, "reclaimable": 0.677, "max_seq": 3, "records": 3}
    assert op.space(df.limit(0)).first().asDict() == {"keys": 0, "tombstones": 0, "live_bytes": 0, "dead_bytes": 0, "total_bytes": 0, "reclaimable": 0.0, "max_seq": 0, "records": 0}
    assert op.should_compact(df, 2).first()[0] and not op.should_compact(df, 1).first()[0] and not op.should_compact(df.limit(0), 2).first()[0]


def test_binary_keys_in_byte_order(spark):
    rows = [(bytearray(k), 1, 0, False, False, False, None, bytearray(b"v")) for k in (b"\xff", b"\x00\x01\x0a\xff\x6b", b"\x01", b"\x7f", b"\x01\x00")]
    df = spark.createDataFrame(rows, log_schema())
    assert [bytes(r.key) for r in op.scan_range(df).collect()] == [b"\x00\x01\x0a\xff\x6b", b"\x01", b"\x01\x00", b"\x7f", b"\xff"]
    assert op.get(df, bytearray(b"\x7f")).count() == 1


def test_last_of_equal_keys_in_a_batch_wins(spark):
    rows = spark.createDataFrame([("k", "first", 1), ("k", "last", 2), ("j", "x", 0)], "key string, value string, ord int")
    out = op.puts(rows, 10, "ord", batch_id=3)
    assert sorted((r.key, r.seq, r.value, r.batch, r.batch_end) for r in out.collect()) == [("j", 11, "x", True, False), ("k", 12, "first", True, False), ("k", 13, "last", True, True)]
    assert state(out) == {"j": "x", "k": "last"}


def test_election(spark):
    votes = spark.createDataFrame([("n3", 7), ("n1", 9), ("n2", 9)], "id string, seq long")
    assert tuple(op.elect(votes, 5).first()) == ("n1", 9)
    assert op.elect(votes, 6).isEmpty()


def test_tables_in_the_shared_folder_are_released(spark):
    from seqlake.functions.tables import materialize, release

    df = materialize(spark.range(10))
    assert df.count() == 10 and release(spark) >= 1 and release(spark) == 0


def test_election_is_one_aggregate(spark):
    votes = spark.createDataFrame([(3, 10), (1, 12), (2, 12)], "id int, seq long")
    out = op.elect(votes, 5)
    assert [tuple(r) for r in out.collect()] == [(1, 12)] and op.elect(votes, 6).collect() == []
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_folder_for_tables_must_be_shared(spark, monkeypatch):
    from seqlake.functions import StoreError, tables

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(StoreError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_tables_are_released(spark):
    from seqlake.functions.tables import made, materialize, release

    before = made()
    a, b = materialize(spark.range(3)), materialize(spark.range(5))
    assert made() == before + 2 and release(spark, before, keep=b) == 1 and b.count() == 5 and made() == before + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(a.inputFiles()[0]).count()
    assert release(spark, before) == 1
