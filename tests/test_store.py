import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineStateError
from tidemark.operators import reconcile
from tidemark.operators.store import MemoryMetrics, Store, SystemClock
from tidemark.schema import MUTATIONS, Durability, checked

SYNC = Durability.SYNC


def rows(df):
    return [(bytes(r.user_key), bytes(r.value)) for r in df.collect()]


def expected(model, start=None, end=None):
    return [(k, v) for k, v in sorted(model.items()) if (start is None or k >= start) and (end is None or k < end)]


def test_basics(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.put(b"b", b"2", SYNC), s.put(b"a", b"1", Durability.GROUP), s.put(b"c", b"3", Durability.NONE), s.put(b"a", b"9", SYNC)
        s.delete(b"c", SYNC), s.delete(b"never", SYNC), s.put(b"", b"", SYNC)
        assert (s.get(b"a"), s.get(b"c"), s.get(b"x"), s.get(b"")) == (b"9", None, None, b"")
        assert rows(s.scan()) == [(b"", b""), (b"a", b"9"), (b"b", b"2")]
        assert list(s.cursor(b"a", b"b")) == [(b"a", b"9")]
        assert rows(s.snapshot(3)) and len(rows(s.snapshot(3))) == 3
        for bad in (lambda: s.put(None, b"", SYNC), lambda: s.put(b"", None, SYNC), lambda: s.put(b"", b"", None), lambda: s.get(None)):
            with pytest.raises(ValueError):
                bad()
    with pytest.raises(EngineStateError):
        s.put(b"a", b"", SYNC)
    (tmp_path / "s" / "999999.tmp").write_bytes(b"\1\2\3")
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert rows(s.scan()) == [(b"", b""), (b"a", b"9"), (b"b", b"2")] and s.last_sequence == 7
        assert not list((tmp_path / "s").glob("*.tmp")) and not list((tmp_path / "s").glob("*.wal"))
    with pytest.raises(ValueError):
        Store.open(spark, str(tmp_path / "t"), write_buffer_bytes=0)


def test_buffer_switch_and_metrics(spark, tmp_path):
    m = MemoryMetrics()
    with Store.open(spark, str(tmp_path / "s"), write_buffer_bytes=1024, metrics=m) as s:
        for i in range(100):
            s.put(b"k%05d" % i, b"value-of-%d" % i, Durability.NONE)
        s.delete(b"k00000", SYNC)
        assert m.counters["flush.count"] >= 2 and m.counters["wal.append.count"] == 101 and m.counters["wal.sync.count"] == 1
        assert s.get(b"k00000") is None and s.get(b"k00099") == b"value-of-99"
        assert s.scan().count() == 99
        s.compact()
        assert len(s.manifest["runs"]) == 1 and s.scan().count() == 99 and s.mutations().count() == 99


def test_torn_log(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        for i in range(5):
            s.put(b"k%d" % i, b"v", SYNC)
    (log,) = (tmp_path / "s").glob("*.wal")
    log.write_bytes(log.read_bytes()[:-3])
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert rows(s.scan()) == [(b"k%d" % i, b"v") for i in range(4)]


def test_random_operations_equal_a_dict(spark, tmp_path):
    rnd, model = random.Random(1), {}
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    for step in range(5):
        ops = []
        for _ in range(200):
            key = bytes([0, rnd.randrange(32)])
            if rnd.random() < 0.7:
                value = rnd.randbytes(rnd.randint(1, 8))
                ops.append((len(ops), bytearray(key), 1, bytearray(value)))
                model[key] = value
            else:
                ops.append((len(ops), bytearray(key), 0, bytearray()))
                model.pop(key, None)
        s.write_batch(spark.createDataFrame(ops, "n int, user_key binary, value_type int, value binary").repartition(3), ["n"], batch_id=str(step))
        s.write_batch(spark.createDataFrame(ops[:1], "n int, user_key binary, value_type int, value binary"), ["n"], batch_id=str(step))
        key = bytes([0, 40])
        s.put(key, bytes([step]), SYNC)
        model[key] = bytes([step])
        assert rows(s.scan()) == expected(model)
        for start, end in ((b"\0\5", b"\0\x14"), (None, b"\0\7"), (b"\0\x09", None), (b"\0\3", b"\0\3"), (b"\0\x20", b"\0\1")):
            assert rows(s.scan(start, end)) == expected(model, start, end)
        if step % 2:
            s.close()
            s = Store.open(spark, path)
    assert s.last_sequence == 1005
    s.close()


def test_hiding_deletions_first_would_be_noticed(spark):
    log = spark.createDataFrame([(bytearray(b"\1"), 1, 1, bytearray(b"\x09")), (bytearray(b"\1"), 2, 0, bytearray())], MUTATIONS)
    assert rows(reconcile.live_view(log)) == []
    wrong = reconcile.newest_per_key(log.where("value_type = 1"))
    assert wrong.count() == 1


def test_order_of_bytes_and_ceiling(spark):
    ks = [b"\xff", b"\1", b"", b"\1\0", b"\x7f", b"\x80"]
    log = spark.createDataFrame([(bytearray(k), i, 1, bytearray(k)) for i, k in enumerate(ks)], MUTATIONS)
    assert [k for k, _ in rows(reconcile.scan(log))] == sorted(ks)
    probes = spark.createDataFrame([(bytearray(b"\1\1"),), (bytearray(b""),), (bytearray(b"\xff\0"),)], "user_key binary")
    got = {bytes(r.probe): r.ceiling and bytes(r.ceiling) for r in reconcile.ceiling(log, probes).collect()}
    assert got == {b"\1\1": b"\x7f", b"": b"", b"\xff\0": None}
    assert reconcile.scan(log.limit(0)).count() == 0
    ranges = spark.createDataFrame([(bytearray(b"\1"), bytearray(b"\x80"), 4)], "start_key binary, end_key binary, sequence long")
    assert [k for k, _ in rows(reconcile.scan(reconcile.delete_ranges(log, ranges)))] == [b"", b"\x7f", b"\x80", b"\xff"]


def test_invalid_mutations_are_refused(spark):
    bad = spark.createDataFrame([(bytearray(b"k"), 1, 7, bytearray())], MUTATIONS)
    with pytest.raises(Exception, match="invalid mutation"):
        checked(bad).collect()


def test_file_formats_round_trip(spark, tmp_path):
    from tidemark.sources.datasource import write_sst, write_wal

    log = spark.range(1, 2001).select(F.encode((F.col("id") * 7 % 331).cast("string"), "UTF-8").alias("user_key"), F.col("id").alias("sequence"), (F.col("id") % 3 > 0).cast("byte").alias("value_type"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"))
    write_wal(log, str(tmp_path / "w"))
    write_sst(log, str(tmp_path / "t"))
    want = sorted((bytes(r[0]), r[1], r[2], bytes(r[3])) for r in log.collect())
    for kind, where in (("tidemark_wal", "w"), ("tidemark_sst", "t")):
        back = spark.read.format(kind).load(str(tmp_path / where))
        assert sorted((bytes(r[0]), r[1], r[2], bytes(r[3])) for r in back.collect()) == want
    part = spark.read.format("tidemark_sst").load(str(tmp_path / "t")).where((F.col("user_key") >= F.lit(bytearray(b"2"))) & (F.col("user_key") < F.lit(bytearray(b"3"))))
    assert part.count() == sum(k[0:1] == b"2" for k, *_ in want)


def test_streaming_latest(spark, tmp_path):
    from tidemark import streaming
    from tidemark.schema import from_events
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet").repartition(4)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.live(from_events(stream)).writeStream.outputMode("complete").format("memory").queryName("live_keys").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("live_keys"))) == sorted(rows(reconcile.live_view(from_events(events))))


def test_generations_for_any_chunking(spark):
    from tidemark.operators.stats import flush_generations

    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 5, 40, 200]) for _ in range(500)]
    log = spark.createDataFrame([(bytearray(b"k"), i + 1, 1, bytearray(n)) for i, n in enumerate(sizes)], MUTATIONS)
    want, gen, held = [], 0, 0
    for n in sizes:
        want.append(gen)
        held += 9 + n
        if held >= 128:
            gen, held = gen + 1, 0
    for chunk in (1, 7, 64, 10_000):
        got = flush_generations(log, 128, rows_per_chunk=chunk).orderBy("sequence").collect()
        assert [r.generation for r in got] == want


def test_numbers_are_dense_when_written_and_read_again(spark, tmp_path):
    from tidemark.operators.sequence import stamp
    from tidemark.operators.stats import prefix_share
    from tidemark.schema import from_events

    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").repartition(7)
    log = from_events(events)
    for n in (4, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            stamp(log.select("user_key", "value_type", "value", F.col("sequence").alias("at")), ["at"], 10).write.mode("overwrite").parquet(str(tmp_path / "n"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        got = spark.read.parquet(str(tmp_path / "n")).agg(F.count("*"), F.countDistinct("sequence"), F.min("sequence"), F.max("sequence")).first()
        assert tuple(got) == (100_000, 100_000, 11, 100_010)
    assert prefix_share(log).count() == 99_999


def test_a_crash_after_a_run_is_written_reuses_no_sequence(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([(i, bytearray(b"k%d" % i), 1, bytearray(b"v")) for i in range(4)], "n int, user_key binary, value_type int, value binary")
    s = Store.open(spark, str(tmp_path / "s"))
    s.write_batch(batch, ["n"])
    commit = Store._commit

    def dies(self, **changes):
        commit(self, **changes)
        raise OSError("lost")

    monkeypatch.setattr(Store, "_commit", dies)
    with pytest.raises(OSError):
        s.write_batch(batch, ["n"])
    monkeypatch.undo()
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.last_sequence == 8
        s.write_batch(batch, ["n"])
        assert sorted(r.sequence for r in s.mutations().collect()) == [*range(1, 13)]
    # The runs count even if the manifest says less.
    manifest = tmp_path / "s" / "MANIFEST"
    manifest.write_text(manifest.read_text().replace('"last_sequence": 12', '"last_sequence": 3'))
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert s.last_sequence == 12


def test_views_outlive_compactions_until_they_are_old(spark, tmp_path):
    class Clock(SystemClock):
        now = 1_000_000

        def epoch_millis(self):
            return self.now * 1000

    clock = Clock()
    with Store.open(spark, str(tmp_path / "s"), clock=clock) as s:
        for k in range(3):
            s.put(b"a", b"%d" % k, SYNC)
            s.flush()
        view = s.scan()
        s.compact()
        s.put(b"a", b"new", SYNC)
        assert rows(view) == [(b"a", b"2")] and rows(s.scan()) == [(b"a", b"new")]
    runs = lambda: len(list((tmp_path / "s").glob("run-*")))
    with Store.open(spark, str(tmp_path / "s"), clock=clock) as s:
        assert runs() == 5 and rows(view) == [(b"a", b"2")]
    clock.now += 90_000
    with Store.open(spark, str(tmp_path / "s"), clock=clock) as s:
        assert runs() == 2 and rows(s.scan()) == [(b"a", b"new")] and s.manifest["retired"] == []


def test_one_writer_at_a_time(spark, tmp_path):
    first = Store.open(spark, str(tmp_path / "s"))
    first.put(b"a", b"1", SYNC)
    with Store.open(spark, str(tmp_path / "s"), read_only=True) as reader:
        assert rows(reader.scan()) == [(b"a", b"1")]
        with pytest.raises(EngineStateError):
            reader.put(b"a", b"2", SYNC)
    first.put(b"b", b"1", SYNC)
    second = Store.open(spark, str(tmp_path / "s"))
    for write in (lambda: first.put(b"c", b"1", SYNC), first.flush):
        with pytest.raises(EngineStateError):
            write()
    second.put(b"d", b"1", SYNC)
    assert [k for k, _ in rows(second.scan())] == [b"a", b"b", b"d"]
    second.close()


def test_batches_are_validated(spark, tmp_path):
    schema = "n int, user_key binary, value_type int, value binary"
    with Store.open(spark, str(tmp_path / "s")) as s:
        for bad in ((1, None, 1, bytearray()), (1, bytearray(), 1, None), (1, bytearray(), 7, bytearray())):
            with pytest.raises(Exception, match="invalid mutation"):
                s.write_batch(spark.createDataFrame([bad], schema), ["n"])
        s.write_batch(spark.createDataFrame([], schema), ["n"])
        assert s.scan().count() == 0 and s.last_sequence == 0


def test_streams_into_one_store(spark, tmp_path):
    from tidemark import streaming

    with Store.open(spark, str(tmp_path / "s")) as s:
        for name in ("one", "two"):
            rows_in = spark.createDataFrame([(i, bytearray(f"{name}{i}".encode()), 1, bytearray(b"v")) for i in range(5)], "n int, user_key binary, value_type int, value binary")
            rows_in.write.parquet(str(tmp_path / name))
            for _ in range(2):  # the second start has a checkpoint of its own and repeats the batch
                q = spark.readStream.schema(rows_in.schema).parquet(str(tmp_path / name)).writeStream.foreachBatch(streaming.append_to(s, ["n"], name)).start()
                q.processAllAvailable()
                q.stop()
        assert s.scan().count() == 10 and s.last_sequence == 10
