"""The store: commits, races, recovery, compaction, feeds, followers, record files."""

import os
import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions import BatchMismatch, CommitConflict, CorruptRecord, EmptyKey, KeyNotFound, KeyTooLarge, NeedFullSync, StoreClosed, log_schema
from seqlake.sources import Store
from seqlake.sources.manifest import Version
from seqlake.sources.recordfiles import parse_hints, parse_records, read_hint_files, read_record_files, record_bytes
from seqlake.streaming import catch_up, follow


def text_store(spark, path):
    return Store(spark, str(path), T.StringType())


def state(store):
    return {r.key: r.value for r in store.state().collect()}


def test_put_get_delete_overwrite(spark, tmp_path):
    s = text_store(spark, tmp_path)
    assert s.ping() and s.put("a", "1") == 1 and s.put("b", "2") == 2 and s.put("a", "1-updated") == 3 and s.put("empty", "") == 4
    assert s.get("a") == "1-updated" and s.get("empty") == ""
    s.delete("b")
    for f in (lambda: s.get("b"), lambda: s.delete("b"), lambda: s.delete("absent"), lambda: s.get("absent")):
        with pytest.raises(KeyNotFound):
            f()
    assert s.seq() == 5  # failed deletes leave no record
    for f in (lambda: s.put("", "x"), lambda: s.get(""), lambda: s.delete("")):
        with pytest.raises(EmptyKey):
            f()
    with pytest.raises(KeyTooLarge):
        s.put("k" * 65_537, "x")
    assert len(s) == 2 and s.stats()["tombstones"] == 1 and s.counters["puts"] == 4 and s.info()["keys"] == 2
    s.close()
    with pytest.raises(StoreClosed):
        s.put("a", "x")


def test_batches_are_whole_or_nothing(spark, tmp_path):
    s = text_store(spark, tmp_path)
    with pytest.raises(BatchMismatch):
        s.batch_put(["a", "b"], ["1"])
    with pytest.raises(EmptyKey):
        s.batch_put(["a", ""], ["1", "2"])
    assert s.batch_put([], []) == 0 and s.version().version == 0
    s.batch_put([f"k{i:04d}" for i in range(200)], [f"v{i:04d}" for i in range(200)])
    assert len(s) == 200 and s.log().where("batch_end").count() == 1
    s.batch_put(["x", "x"], ["1", "2"])
    assert s.get("x") == "2"


def test_a_transaction_is_done_once(spark, tmp_path):
    s = text_store(spark, tmp_path)
    assert s.put("a", "1", txn="t1") == 1
    s.put("a", "2")
    assert s.put("a", "1", txn="t1") == 2 and s.get("a") == "2"


def test_reopening_keeps_state_and_numbers(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.batch_put([f"k{i:04d}" for i in range(500)], ["value"] * 500)
    s.delete_all(spark.range(500).where("id % 3 = 0").select(F.format_string("k%04d", "id").alias("key")))
    s.batch_put([f"k{i:04d}" for i in range(0, 500, 7)], ["rewritten"] * 72)
    expected = {f"k{i:04d}": "rewritten" if i % 7 == 0 else "value" for i in range(500) if i % 3 or i % 7 == 0}
    again = text_store(spark, tmp_path)
    assert state(again) == expected and again.seq() == 500 + 167 + 72
    assert again.put("new", "x") == 740
    assert again.delete_all(spark.createDataFrame([("k0001",), ("absent",)], "key string")).collect()[0].key == "absent"


def test_files_that_no_version_names_do_not_exist(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.put("a", "1")
    stray = s.log().withColumns({"key": F.lit("stray"), "seq": F.lit(99).cast("long")})
    stray.write.parquet(f"{tmp_path}/data/c0000000009-stray")
    (tmp_path / "_manifest" / ".tmp-left").write_text("{")
    assert state(text_store(spark, tmp_path)) == {"a": "1"}
    assert s.vacuum() == 0 and s.vacuum(older_than_s=-10) == 1 and state(s) == {"a": "1"}


def test_one_writer_wins_a_version(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.manifest.publish(Version(1))
    with pytest.raises(CommitConflict):
        s.manifest.publish(Version(1))
    stores, errors = [text_store(spark, tmp_path) for _ in range(3)], []

    def work(k):
        try:
            for i in range(2):
                stores[k].put(f"k{k}-{i}", "v")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and len(s) == 6 and s.seq() == 6 and sorted(r.seq for r in s.log().collect()) == [1, 2, 3, 4, 5, 6]


def test_compaction(spark, tmp_path):
    s = text_store(spark, tmp_path)
    for r in range(4):
        s.batch_put([f"k{i:02d}" for i in range(20)], [f"round-{r}-value-{i:02d}" for i in range(20)])
    s.delete_all(spark.createDataFrame([(f"k{i:02d}",) for i in range(5)], "key string"))
    before = s.log().collect()
    assert s.stats()["tombstones"] == 5 and s.should_compact()
    seqs = {r.key: r.seq for r in s.state().collect()}
    s.compact()
    assert len(s) == 15 and s.stats()["tombstones"] == 0 and s.stats()["dead_bytes"] == 0 and not s.should_compact()
    assert {r.key: r.seq for r in s.state().collect()} == seqs and not s.log().where("batch").count()
    assert s.merge_seq() == 85 and s.checked().count() == 15
    assert text_store(spark, tmp_path).put("next", "x") == 86  # numbers of dropped tombstones are not used again
    with pytest.raises(NeedFullSync):
        s.records_since(80)
    assert s.records_since(85).count() == 1 and len(before) == 85


def test_compacting_everything_away(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.put("a", "1")
    s.delete("a")
    s.compact()
    assert len(s) == 0 and s.seq() == 2 and s.put("a", "2") == 3


def test_commits_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    s, other = text_store(spark, tmp_path), text_store(spark, tmp_path)
    s.batch_put(["a", "b"], ["1", "2"])
    write = s._write

    def slow(*a, **b):
        out = write(*a, **b)
        other.put("a", "newer")
        other.delete("b")
        return out

    monkeypatch.setattr(s, "_write", slow)
    s.compact()
    assert state(s) == {"a": "newer"}
    monkeypatch.setattr(s, "_write", lambda *a, **b: (other.compact(), write(*a, **b))[1])
    with pytest.raises(CommitConflict):
        s.compact()
    assert state(s) == {"a": "newer"}
    monkeypatch.undo()
    assert s.start_compaction() and not s.close()


def test_apply(spark, tmp_path):
    a, b = text_store(spark, tmp_path / "a"), text_store(spark, tmp_path / "b")
    a.batch_put(["a", "b"], ["1", "2"])
    a.put("a", "3")
    a.delete("b")
    for part in ("seq >= 3", "seq < 3", "seq > 0"):
        b.apply(a.log().where(part))
    assert state(b) == state(a) == {"a": "3"} and b.seq() == 4
    bad = a.log().withColumn("key", F.when(F.col("seq") == 2, "").otherwise(F.col("key")))
    for records in (bad, a.log().withColumn("crc", F.lit(1)), a.log().withColumn("seq", -F.col("seq"))):
        with pytest.raises(CorruptRecord):
            b.apply(records)
    assert b.version().version == 3 and state(b) == {"a": "3"}


def test_damaged_rows_are_never_read_as_right(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.batch_put(["k", "q"], ["the quick brown fox", "x"])
    folder = f"{tmp_path}/{s.version().commits[0]['path']}"
    rows = spark.read.parquet(folder).withColumn("value", F.when(F.col("key") == "k", "the quick brown fux").otherwise(F.col("value"))).collect()
    schema = spark.read.parquet(folder).schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(folder)
    assert [r.key for r in s.checked(mode="skip").collect()] == ["q"]
    with pytest.raises(Exception, match="checksum"):
        s.checked().collect()


def damage(spark, store, key):
    """Alter a key's value on disk, and leave its checksum."""
    for commit in store.version().commits:
        folder = f"{store.path}/{commit['path']}"
        df = spark.read.parquet(folder)
        rows, schema = df.withColumn("value", F.when(F.col("key") == key, F.concat("value", F.lit("!"))).otherwise(F.col("value"))).collect(), df.schema
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(folder)


def test_every_read_and_a_compaction_refuse_damaged_records(spark, tmp_path):
    s = text_store(spark, tmp_path)
    s.batch_put([f"k{i}" for i in range(9)], [f"v{i}" for i in range(9)])
    damage(spark, s, "k3")
    assert s.get("k4") == "v4" and [r.key for r in s.scan("k4", "k6").collect()] == ["k4", "k5", "k6"]  # others can be read
    with pytest.raises(CorruptRecord):
        s.get("k3")
    with pytest.raises(CorruptRecord):
        s.read_key_range("k2", "k5")
    for read in (lambda: s.scan("k3", "k3"), s.state, s.snapshot, lambda: s.records_since(2), lambda: s.feed(0)[1], lambda: s.feed(2)[1], s.log):
        with pytest.raises(Exception, match="checksum"):
            read().collect()
    at = s.version().version
    for write in (s.compact, lambda: text_store(spark, tmp_path / "b").apply(s.log()), lambda: s.delete("k3")):
        with pytest.raises(CorruptRecord):
            write()
    assert s.version().version == at and not any((tmp_path / "b" / "_manifest").glob("v*")) and len(s) == 9
    assert s.start_compaction()
    with pytest.raises(CorruptRecord):  # what went wrong in the background is not lost
        s.close()


def test_transactions_are_remembered_for_good(spark, tmp_path, monkeypatch):
    from seqlake.sources import manifest

    monkeypatch.setattr(manifest, "REMEMBERED", 2)
    s = text_store(spark, tmp_path)
    for i in range(5):
        s.put("a", str(i), txn=f"t{i}")
    assert len(s.version().txn_ids) == 2
    for i in range(5):
        assert s.put("a", "again", txn=f"t{i}") == 5
    assert s.get("a") == "4" and s.put("a", "5", txn="t5") == 6


def test_replace_is_one_version(spark, tmp_path):
    a, b = text_store(spark, tmp_path / "a"), text_store(spark, tmp_path / "b")
    a.batch_put(["x", "y"], ["1", "2"])
    b.batch_put(["old"] * 9, ["0"] * 9)
    before = b.version().version
    assert b.replace(a.snapshot(), txn="full") == 2 and b.version().version == before + 1 and state(b) == {"x": "1", "y": "2"}
    assert b.replace(a.snapshot(), txn="full") == 2 and b.version().version == before + 1
    b.replace(a.snapshot().limit(0))
    assert len(b) == 0 and b.seq() == 0


def test_first_of_equal_sequence_numbers_stays(spark, tmp_path):
    a, b = text_store(spark, tmp_path / "a"), text_store(spark, tmp_path / "b")
    a.put("k", "first")
    b.put("k", "second")
    a.apply(b.log())
    assert a.get("k") == "first" and state(a) == {"k": "first"}
    a.compact()
    assert a.get("k") == "first"


def test_files_have_a_size_in_bytes(spark, tmp_path):
    s = Store(spark, str(tmp_path), T.StringType(), file_bytes=100_000)
    s.batch_put(spark.range(0, 400, 1, 1).select(F.format_string("k%03d", "id").alias("key"), F.repeat(F.lit("v"), 1000).alias("value"), F.col("id").alias("ord")))
    files = s.log().inputFiles()
    assert len(files) >= 4 and len(s) == 400
    s.compact()
    assert len(s.log().inputFiles()) >= 4 and s.version().commits[0]["bytes"] == 400 * (29 + 4 + 1000)


def test_a_bad_row_of_a_large_batch_rejects_all(spark, tmp_path):
    s = text_store(spark, tmp_path)
    rows = spark.range(100).select(F.when(F.col("id") == 77, "").otherwise(F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"), F.col("id").alias("ord"))
    with pytest.raises(EmptyKey):
        s.batch_put(rows)
    with pytest.raises(KeyTooLarge):
        s.batch_put(rows.withColumn("key", F.when(F.col("ord") == 5, F.repeat(F.lit("k"), 70_000)).otherwise("x")))
    assert s.version().version == 0 and s.batch_put(rows.limit(0)) == 0


def test_ranges_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), T.StringType(), max_range=10)
    s.batch_put([f"k{i:03d}" for i in range(50)], ["v"] * 50)
    rows, more = s.read_key_range()
    assert [r.key for r in rows] == [f"k{i:03d}" for i in range(10)] and more
    assert s.read_key_range("k045")[1] is False
    it = s.scan_key_range()
    assert next(it).key == "k000" and next(it).key == "k001"
    assert s.scan("k010", "k019", 3).count() == 3


def test_binary_values(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    key, value = bytes([0, 1, 10, 255, 107]), bytes(i % 256 for i in range(300_000))
    s.put(bytearray(key), bytearray(value))
    assert s.get(bytearray(key)) == value


def test_follower_catches_up_restarts_and_never_brings_keys_back(spark, tmp_path):
    a, b = text_store(spark, tmp_path / "a"), text_store(spark, tmp_path / "b")
    a.batch_put([f"k{i:03d}" for i in range(100)], ["original"] * 100)
    run = lambda: follow(a, b, f"{tmp_path}/checkpoint").awaitTermination()
    run()
    assert len(b) == 100
    a.batch_put([f"k{i:03d}" for i in range(100)], ["rewritten"] * 100)
    a.delete_all(spark.range(20).select(F.format_string("k%03d", "id").alias("key")))
    a.compact()
    run()
    assert state(b) == state(a) and len(b) == 80
    a.put("k200", "late")
    run()
    assert state(b) == state(a) and len(b) == 81
    at = a.seq()
    assert catch_up(a, b, at) == at


def test_feed_modes_and_observers(spark, tmp_path):
    s, seen = text_store(spark, tmp_path), []
    s.add_observer(lambda seq, records: seen.append((seq, records.count())))
    s.batch_put(["a", "b"], ["1", "2"])
    s.put("c", "3")
    assert seen == [(2, 2), (3, 1)]
    assert s.feed(0)[0] == "full" and s.feed(2)[0] == "incremental" and s.feed(2)[1].count() == 1 and s.feed(99)[0] == "full"
    s.compact()
    assert s.feed(2)[0] == "full" and s.feed(3)[0] == "incremental"
    s.reset()
    assert len(s) == 0 and s.seq() == 0


def _record(seq, key, value, flags=0):
    body = struct.pack("<qQBII", 5, seq, flags, len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def test_record_files(spark, tmp_path):
    good = _record(1, b"a", b"1") + _record(2, b"b", b"", 1) + _record(3, b"c", b"x", 2) + _record(4, b"d", b"y", 6)
    (tmp_path / "0000000001.data").write_bytes(good + _record(5, b"e", b"z")[:-1])  # cut short
    (tmp_path / "0000000002.data").write_bytes(_record(6, b"f", b"q", 2) + os.urandom(37))  # an unfinished batch, then junk
    df = read_record_files(spark, str(tmp_path))
    assert sorted((r.file_id, bytes(r.key), r.seq, r.tomb, r.batch, r.batch_end) for r in df.collect()) == [
        (1, b"a", 1, False, False, False), (1, b"b", 2, True, False, False), (1, b"c", 3, False, True, False), (1, b"d", 4, False, True, True), (2, b"f", 6, False, True, False),
    ]
    from seqlake import operators as op

    gated = op.batch_gate(df.select(*log_schema().names))
    assert sorted(bytes(r.key) for r in op.live(gated).collect()) == [b"a", b"c", b"d"]
    flipped = bytearray(good)
    flipped[40] ^= 0xFF
    assert len(list(parse_records(bytes(flipped)))) < 4 and list(parse_records(b"")) == []


def _hint(seq, pos, key, size=40, flags=0):
    return struct.pack("<QBQII", seq, flags, pos, size, len(key)) + key


def test_hint_files(spark, tmp_path):
    magic = b"ABCDEFG1"
    for i, hint in ((1, magic + _hint(1, 0, b"a") + _hint(2, 40, b"b", 31, 1)), (2, magic + _hint(3, 0, b"c")[:-1]), (3, b"garbage")):
        (tmp_path / f"{i:010d}.data").write_bytes(_record(10 * i, b"d%d" % i, b"value"))
        (tmp_path / f"{i:010d}.hint").write_bytes(hint)
    (tmp_path / "0000000004.data").write_bytes(_record(40, b"d4", b"", 1))  # no hint
    (tmp_path / "0000000005.hint").write_bytes(magic + _hint(9, 0, b"orphan"))
    got = sorted((r.file_id, r.pos, bytes(r.key), r.seq, r.tomb, r.size) for r in read_hint_files(spark, str(tmp_path), magic).collect())
    assert got == [(1, 0, b"a", 1, False, 40), (1, 40, b"b", 2, True, 31), (2, 0, b"d2", 20, False, 36), (3, 0, b"d3", 30, False, 36), (4, 0, b"d4", 40, True, 31)]
    assert parse_hints(magic, magic) == [] and parse_hints(b"", magic) is None


def test_written_records_are_read_again(spark):
    rows = [(b"k", 1, 7, False, False, False, None, b"v"), (b"\x00\xff", 1 << 40, -1, True, True, True, 3, None), (b"e", 3, 0, False, True, False, 3, b"")]
    df = spark.createDataFrame(rows, log_schema()).select(record_bytes().alias("b"))
    got = [list(parse_records(bytes(r.b)))[0][1:] for r in df.collect()]
    assert got == [(1, 7, 0, b"k", b"v"), (1 << 40, -1, 7, b"\x00\xff", b""), (3, 0, 2, b"e", b"")]
