"""Operators on small inputs with expectations worked out by hand."""

import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickflow.functions import records, ticks
from tickflow.operators import calibrate, filters, lookups, monitor, ordering, ranges, sweep, windows
from tickflow.schemas import DAY, EOS, HOUR, SECOND
from tickflow.sources import records as binary
from tickflow.sources import ring, spool, spool_files
from tickflow.streaming import bins, calibration
from tickflow.streaming import queries as streams


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bins_are_aligned_and_zero_filled(spark):
    events = spark.createDataFrame([(m, i) for i in range(10, 50, 5) for m in (1, 2)] + [(2, 12)], "mbid long, utc long")
    doms = spark.createDataFrame([(1,), (2,), (3,)], "mbid long")
    found = values(monitor.binned_counter(events, doms, 10), "mbid", "first_utc", "last_utc", "n")
    assert [r for r in found if r[0] == 1] == [(1, 10, 19, 2), (1, 20, 29, 2), (1, 30, 39, 2), (1, 40, 45, 2)]
    assert [r[3] for r in found if r[0] == 2] == [3, 2, 2, 2]
    assert [r[3] for r in found if r[0] == 3] == [0, 0, 0, 0]


def test_good_time_ignores_stragglers(spark):
    minute, t0 = 60 * SECOND, 1000 * SECOND
    rows = [(1, t0 + k) for k in range(5)] + [(1, t0 + 5 * minute)]
    rows += [(2, t0)] + [(2, t0 + 5 * minute + k) for k in range(5)]
    rows += [(3, t0), (3, t0 + 7)] + [(4, -1), (4, t0)]
    df = spark.createDataFrame(rows, "hub_id int, t long")
    assert dict(values(windows.good_times(df, "first"), "hub_id", "good")) == {1: t0 + 4, 2: t0 + 5 * minute + 4, 3: t0 + 7, 4: 0}
    assert dict(values(windows.good_times(df, "last"), "hub_id", "good")) == {1: t0, 2: t0 + 5 * minute, 3: t0, 4: 0}


def test_order_enforcement_drops_beyond_epsilon(spark):
    rows = [(1, 1, 10, 100), (1, 2, 11, 200), (1, 3, 12, 150), (1, 4, 13, 195), (1, 5, 5, 100), (1, 6, 14, 200)]
    df = spark.createDataFrame(rows, "mbid long, seq long, domclk long, utc long")
    got = {r.seq: (r.kept, r.cause) for r in ordering.enforced(df, 10).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "translation"), 4: (True, "translation"), 5: (False, "clock"), 6: (True, None)}
    with pytest.raises(Exception, match="too many"):
        ordering.enforced(df, 10, max_drops=1).collect()


def test_blocks_do_not_change_results(spark):
    rows = [(1 + k % 2, k, (k * 7919) % 101 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "hub_id int, seq long, utc long")
    for f in (lambda b: filters.order_violations(df, block=b), lambda b: ordering.without_steps_back(df, block=b), lambda b: ordering.prescaled(df, 7, block=b), lambda b: monitor.replay_totals(df, 5, block=b)):
        small, large = f(16), f(10**6)
        assert values(small, *small.columns) == values(large, *small.columns)


def test_trigger_filter_and_modes(spark):
    words = {0: 0, 1: 4, 2: 3, 3: 0x10, 4: 0x1000}
    df = spark.createDataFrame([(m, lc, (lc << 16) | (b << 18)) for m, b in words.items() for lc in range(4)], "mode int, lc int, word1 int")
    assert all(tuple(r) == (r.mode, r.lc) + (r.mode, r.lc) for r in df.select("mode", "lc", records.trigger_mode("word1").alias("m"), records.lc_mode("word1").alias("l")).collect())
    hits = df.select(F.col("lc").alias("lc_mode"), F.col("mode").alias("trigger_mode"))
    assert filters.forwarded(hits).count() == 5 * 3 + 1
    assert filters.forwarded(hits, isolated=True).count() == 20


def test_isochron_by_hand():
    a, b = (1000, 2000, 3000, 4000), (11000, 12000, 13000, 14000)
    lower, upper, dor_mid, dom_mid, epsilon, cable = calibrate.isochron(a, b)
    assert (lower, upper, dor_mid, dom_mid, epsilon) == (3000, 13000, 12500, 12500, 0.0)
    assert cable == pytest.approx(1e-7)
    assert calibrate.isochron(b, a) is None
    assert calibrate.half(-3) == -1 and calibrate.half(3) == 1


def test_average_restarts_only_before_it_is_settled():
    step = lambda s, x: calibrate.average_step(s, x, 1.0, 0.1, 3)
    state, _ = step((None, 0), 100.0)
    state, ok = step(state, 5.0)
    assert ok and state == (5.0, 1)
    for x in (5.1, 5.2):
        state, ok = step(state, x)
        assert ok
    assert step(state, 50.0) == (state, False)


def test_chain_skips_wild_and_bad_records(spark):
    def tcal(seq, n, late=0, bad=False):
        return (1, seq, n * 10000, n * 10000 + 3000, n * 10000 + 4000, n * 10000 + 7000 + late, bad, 0)

    rows = [tcal(k, k) for k in range(5)] + [tcal(5, 5, late=2000), tcal(6, 6), tcal(7, 7, bad=True), tcal(8, 8)]
    df = spark.createDataFrame(rows, "mbid long, seq long, t0 long, t1 long, t2 long, t3 long, bad boolean, gps_offset long")
    out = {r.seq: (r.outcome, r.lower) for r in calibrate.calibrated(df).collect()}
    assert [out[k][0] for k in range(9)] == ["first"] + ["accepted"] * 4 + ["wild", "accepted", "error", "accepted"]
    assert out[6][1] == out[4][1] + 10000 and out[8][1] == 64000  # pairs start at the last accepted end


def test_translation_uses_the_holder_the_newest_or_the_oldest(spark):
    iso = spark.createDataFrame([(1, 2500, 5000, 10**6, 5000, 0.0, 7), (1, 5000, 7500, 2 * 10**6, 7500, 0.0, 7)], "mbid long, lower long, upper long, dor_mid long, dom_mid long, epsilon double, gps_offset long")
    hits = spark.createDataFrame([(1, 1, 20), (1, 2, 21), (1, 3, 40), (1, 4, 4), (2, 5, 4)], "mbid long, seq long, domclk long")
    assert dict(values(calibrate.translated(hits, iso).where("utc is not null"), "seq", "utc")) == {1: 10**6 + 7, 2: 2 * 10**6 + 5250 - 7500 + 7, 3: 2 * 10**6 + 2500 + 7, 4: 10**6 + 1000 - 5000 + 7}
    assert calibrate.translated(hits, iso).where("seq = 5 and utc is null").count() == 1


def test_streaks_throttle_and_gaps(spark):
    df = spark.createDataFrame([(k, k not in (3, 9)) for k in range(12)], "seq long, hot boolean")
    for block in (2, 3, 100):
        assert values(windows.streaks(df, "hot", 4, block=block), "seq", "streak") == [(7, 4), (8, 5)]
    alerts = spark.createDataFrame([(k, "a", t) for k, t in enumerate([0, 10, 60, 61, 100, 122])], "seq long, kind string, ns long")
    assert values(windows.throttled(alerts, 60), "ns") == [(0,), (61,), (122,)]
    rows = [(1, k, k * SECOND + (20 * SECOND if k > 11 else 0) + (50 * SECOND if k > 4 else 0)) for k in range(15)]
    gaps = windows.replay_gaps(spark.createDataFrame(rows, "hub_id int, seq long, utc long"), block=4)
    assert values(gaps, "seq", "gap", "n_huge") == [(12, 21 * SECOND, 1)]


def test_sane_times_end_at_the_first_jump(spark):
    rows = [(1, -5), (1, 10), (1, HOUR), (1, HOUR + 2 * DAY), (1, HOUR + 2 * DAY + 1), (2, 5), (2, DAY)]
    df = spark.createDataFrame(rows, "hub_id int, utc long")
    assert values(filters.sane_times(df), "hub_id", "utc") == [(1, 10), (1, HOUR), (2, 5), (2, DAY)]


def test_request_selection_matrix(spark):
    hits = spark.createDataFrame([(s, 1 if s < 4 else 201, 10 + s % 2, t) for s, t in enumerate([9, 10, 20, 21, 9, 10, 20, 21])], "seq long, hub_id int, mbid long, utc long")
    modules = hits.select("mbid", "hub_id").distinct()

    def found(kind, source=0, dom=0):
        e = spark.createDataFrame([(1, 0, kind, source, 10, 20, dom)], "uid int, elem int, readout_type int, source_id int, first_utc long, last_utc long, dom_id long")
        return [r.seq for r in ranges.readout(hits, e, modules).orderBy("seq").collect()]

    assert found(ranges.GLOBAL) == [1, 2, 5, 6]
    assert found(ranges.INICE) == [1, 2] and found(ranges.SURFACE) == [5, 6]
    assert found(ranges.STRING, source=12001) == [1, 2]
    assert found(ranges.INICE_MODULE, dom=11) == [1] and found(ranges.SURFACE_MODULE, dom=10) == [6]
    two = spark.createDataFrame([(1, 0, ranges.SURFACE, 0, 0, 20, 0), (1, 1, ranges.GLOBAL, 0, 9, 30, 0), (2, 1, ranges.GLOBAL, 0, 9, 10, 0)], "uid int, elem int, readout_type int, source_id int, first_utc long, last_utc long, dom_id long")
    assert values(ranges.readout(hits, two, modules, 7), "uid", "seq") == [(1, k) for k in range(8)] + [(2, 0), (2, 1), (2, 4), (2, 5)]
    with pytest.raises(ValueError):
        ranges.in_range(hits, 5, 4)


def test_catalog_overlap_and_retention(spark):
    names = ["one", "two", "three", "four", "five"]
    cat = spark.createDataFrame([(1, k, n, 11111 * (k + 1)) for k, n in enumerate(names)], "hub_id int, slice long, name string, start_utc long")
    cat = spool.open_slices(cat, 10000)
    assert [r.name for r in spool.overlapping(cat, 22222, 44444).collect()] == ["two", "three", "four"]
    assert [r[0] for r in values(spool.retained(cat, 2), "slice")] == [3, 4]


def test_spool_files_and_raw_messages(spark, tmp_path):
    def record(fmt, mbid, utc, body=b"abc"):
        return struct.pack(">iiqqq", 32 + len(body), fmt, mbid, 0, utc) + body

    (tmp_path / "HitSpool-0.dat").write_bytes(record(3, 7, 100) + record(2, 8, 200, b""))
    (tmp_path / "HitSpool-1.dat").write_bytes(record(3, 9, EOS))
    assert values(spool_files.read_spool(spark, str(tmp_path)), "rec_len", "fmt", "mbid", "utc", "payload") == [(32, 2, 8, 200, bytearray(b"")), (35, 3, 7, 100, bytearray(b"abc")), (35, 3, 9, EOS, bytearray(b"abc"))]
    assert values(spool_files.read_spool(spark, str(tmp_path), 150, 250), "mbid") == [(8,)]
    engineering = struct.pack(">HHBB", 20, 2, 1, 0) + bytes(4) + (123456789012).to_bytes(6, "big") + bytes(4)
    skipped = struct.pack(">HH", 8, 0x55) + bytes(4)
    hit = lambda clk, chip: struct.pack("<iIi", 14 | chip << 11, clk, 9) + b"xy"
    compressed = struct.pack(">HHHH", 8 + 28, 0x90, 0xFFFF, 0) + hit(5, 0) + hit(2**32 - 1, 1)
    messages = spark.createDataFrame([(7, 1, engineering + skipped + compressed), (8, 2, b""), (9, 3, None), (9, 4, compressed), (9, 5, engineering)], "mbid long, message long, content binary").coalesce(1)
    both = [(3, 0, (0xFFFF << 32) + 5, 14, 14, 9), (3, 1, 2**48 - 1, 14, 14 | 1 << 11, 9)]
    one = (2, 1, 123456789012, 20, None, None)
    found = binary.split_messages(messages).select("mbid", "message", "number", "fmt", "atwd_chip", "domclk", "size", "word1", "word3").collect()
    assert [tuple(r) for r in found] == [(7, 1, 0, *one), (7, 1, 1, *both[0]), (7, 1, 2, *both[1]), (9, 4, 0, *both[0]), (9, 4, 1, *both[1]), (9, 5, 0, *one)]
    with pytest.raises(Exception, match="hit of 3 bytes"):
        binary.split_messages(spark.createDataFrame([(1, 1, struct.pack(">HHHH", 24, 0x90, 0, 0) + struct.pack("<iIi", 3, 0, 0) + bytes(4))], messages.schema)).collect()


def record_file(path, sizes, index=False):
    """A file of records of these body sizes; returns (offset, utc) of each."""
    out, places = [], []
    for k, n in enumerate(sizes):
        places.append((sum(map(len, out)), 10 * k))
        out.append(struct.pack(">iiqqq", 32 + n, 3, k % 5, 0, 10 * k) + bytes(n))
    path.write_bytes(b"".join(out))
    if index:
        spool_files.indexed(str(path), 3)
    return places


@pytest.mark.parametrize("index", [False, True])
def test_any_cut_of_a_record_file_gives_the_same_records(tmp_path, index):
    rng = random.Random(4)
    path = tmp_path / "a.dat"
    places = record_file(path, [rng.choice([0, 1, 7, 60, 300, 5000]) for _ in range(150)], index)
    size = path.stat().st_size
    for step in (size + 1, 1000, 333, 97):
        file, got = spool_files.RecordFile(str(path)), []
        for a in range(0, size, step):
            for batch in file.records(a, min(a + step, size)):
                got += zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True)
        assert got == places
    file = spool_files.RecordFile(str(path))
    assert all(file.sync(at) == min((p for p, _ in places if p >= at), default=size) for at in range(0, size, 41))


def test_broken_record_files_are_errors(tmp_path):
    path = tmp_path / "a.dat"
    record_file(path, [5] * 40)
    whole = path.read_bytes()
    for broken in (whole[:-1], whole + b"xy", whole[:370] + b"\0" * 8 + whole[378:]):
        path.write_bytes(broken)
        with pytest.raises(ValueError):
            list(spool_files.RecordFile(str(path)).records(0, len(broken)))
    # a body that looks like records: the chain begins in it, and the range before says so
    fake = b"".join(struct.pack(">iiqqq", 32, 3, 1, 0, 0) for _ in range(40))
    path.write_bytes(struct.pack(">iiqqq", 32 + len(fake), 3, 1, 0, 0) + fake + whole)
    with pytest.raises(ValueError, match="write an index"):
        list(spool_files.RecordFile(str(path)).records(0, 64))
    spool_files.indexed(str(path))
    file = spool_files.RecordFile(str(path))
    assert sum(len(b) for a in range(0, file.size, 64) for b in file.records(a, min(a + 64, file.size))) == 41


def test_large_file_is_read_by_several_tasks(spark, tmp_path):
    """A file of 200 MB that has holes on disk only where bodies are: many ranges, each read by itself."""
    path, n, body = tmp_path / "big.dat", 2000, 100_000
    with path.open("wb") as f:
        for k in range(n):
            f.write(struct.pack(">iiqqq", 32 + body, 3, 1, 0, k))
            f.seek(body, 1)
        f.truncate(n * (32 + body))
    df = spool_files.read_spool(spark, str(tmp_path), with_payload=False, range_bytes=16 << 20)
    found = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("utc").alias("top")).collect()
    assert len(found) > 10 and sum(r.n for r in found) == n and max(r.top for r in found) == n - 1
    path.unlink()


def test_written_spool_prunes_by_its_index_and_leaves_the_same_files_again(spark, tmp_path):
    hits = spark.range(3000).selectExpr("id as seq", "cast(id % 2 as int) as hub_id", "id as mbid", "id * 10 as utc", "3 as fmt", "cast(54 + id % 9 as int) as rec_len", "7 as word1")
    written = [values(spool_files.write_spool(hits, f"{tmp_path}/s", 10_000, stride=50), "file", "n", "bytes") for _ in range(2)]
    assert written[0] == written[1] and len(written[0]) == 6 and sum(n for _, n, _ in written[0]) == 3000
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith((".idx", ".crc"))) == [f for f, *_ in written[0]]
    found = spool_files.read_spool(spark, f"{tmp_path}/s", 4990, 15_010)
    assert values(found, "utc") == [(t,) for t in range(4990, 15_011, 10)]
    assert len({r.path for r in found.collect()}) == 4
    reader = spool_files.SpoolReader({"path": f"{tmp_path}/s", "first": "4990", "last": "5500"})
    assert sum(p.value[2] - p.value[1] for p in reader.partitions()) < sum(b for *_, b in written[0]) / 4


def test_ring_keeps_the_newest_slices_and_its_catalog_in_step(spark, tmp_path):
    path, schema = f"{tmp_path}/ring", "seq long, hub_id int, mbid long, utc long"
    sink = ring.ring_sink(path, 10, 3)
    batches = [[(0, 1, 1, 5), (1, 1, 1, 12), (2, 2, 1, 3)], [(3, 1, 1, 14), (4, 1, 1, 25)], [(5, 1, 1, 31), (6, 1, 1, 8), (7, 1, 1, 47), (8, 1, 1, 77)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again
            sink(spark.createDataFrame(rows, schema), number)
        if number == 1:
            before = values(ring.catalog(spark, path, 10), "hub_id", "slice", "start_utc", "stop_utc")
            assert before == [(1, 0, 5, 5), (1, 1, 12, 14), (1, 2, 25, 34), (2, 0, 3, 12)]  # the newest of a hub is open
            ring.compact(spark, path)
            assert values(ring.catalog(spark, path, 10), "hub_id", "slice", "start_utc", "stop_utc") == before
    # 31 takes slot 0 from 5, and 8 is too late; 47 displaces 12 and 14 and is itself displaced by 77 in its batch
    assert values(ring.catalog(spark, path, 10), "hub_id", "slice", "start_utc", "stop_utc") == [(1, 2, 25, 25), (1, 3, 31, 31), (1, 7, 77, 86), (2, 0, 3, 12)]
    assert values(spark.read.parquet(f"{path}/data"), "seq") == [(2,), (4,), (5,), (8,)]
    assert values(ring.late(spark, path), "hub_id", "slice", "n") == [(1, 0, 1), (1, 4, 1)]
    assert values(ring.read_ring(spark, path, 20, 80, 10), "seq", "utc") == [(4, 25), (5, 31), (8, 77)]
    ring.compact(spark, path)
    assert values(ring.read_ring(spark, path, 0, 80, 10), "seq") == [(2,), (4,), (5,), (8,)]


def test_replay_files_skip_and_time_fields(spark, tmp_path):
    hit = struct.pack(">iiqqq", 32, 3, 7, 0, 100)
    moni = struct.pack(">iiqqq", 32, 3, 55, 0, 0)
    for n in range(3):
        (tmp_path / f"hub0001_hit_{n}.dat").write_bytes(hit * (n + 1))
    (tmp_path / "hub0001_moni_0.dat").write_bytes(moni)
    (tmp_path / "hub0001_hit_1.dat.idx").write_bytes(b"")
    stream = spool_files.replay_stream(spark, str(tmp_path), "hub0001_*.dat", skip=1, files_per_trigger=1, range_bytes=40)
    stop = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    while not stop.recentProgress:
        stop.processAllAvailable() if stop.exception() else time.sleep(0.1)
    stop.stop()  # in the middle: the next query goes on from the checkpoint
    streams.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    assert values(out.groupBy("stream").agg(F.count("*").alias("n"), F.min("utc").alias("first")), "stream", "n", "first") == [("hit", 5, 100), ("moni", 1, 55)]


def test_leap_seconds_and_gps(spark):
    days = spark.createDataFrame([(1,), (10,), (11,), (200,)], "day int")
    table = spark.createDataFrame([(10, 1), (180, 2)], "from_day int, offset int")
    assert values(lookups.leap_seconds(days, table), "day", "leap") == [(1, 0), (10, 1), (11, 1), (200, 2)]
    gps = spark.createDataFrame([(2, 0, 0, 1, 0, 20)], "day int, hour int, minute int, second int, leap int, dorclk long")
    assert gps.select(ticks.gps_offset()).first()[0] == 86401 * 10**10 - 10000
    assert gps.select(ticks.gps_millis(2024)).first()[0] == 1704067200000 + 86401000


@pytest.mark.parametrize("method", records.METHODS)
def test_flat_waveforms_have_no_edge(spark, method):
    df = spark.createDataFrame([([500.0] * 66,)], "w array<double>")
    assert df.select(records.fine_correction("w", method)).first()[0] is None


def test_waiting_hits_go_in_order_by_the_oldest_isochron_that_reaches_them():
    channel = calibration.Channel()
    iso = lambda upper: (upper, upper, upper, 0)  # noqa: E731  (translates a clock to itself)
    clock, place = np.array([12000, 11000, 30000, 100]), np.array([-1, -1, 1, 3])
    utc, kept = calibration.released(channel, [(2, iso(14000), 0.0)], clock, place, 5000, 1)
    assert (utc.tolist(), kept.tolist(), channel.top) == ([12000, 11000], [True, False], 12000)
    # the third hit holds up the fourth until an isochron reaches it
    utc, kept = calibration.released(channel, [(0, iso(40000), 0.0)], clock[2:], np.array([-1, -1]), 5000, 1)
    assert (utc.tolist(), kept.tolist(), channel.isochrons) == ([30000, 100], [True, False], [iso(14000), iso(40000)])
    with pytest.raises(ValueError, match="waits for calibration with 3 hits"):
        calibration.released(channel, [], np.full(3, 50000), np.arange(3), 2, 1)
    assert calibration._unpacked(calibration._packed({7: channel}))[7].isochrons == channel.isochrons


def streamed(spark, tmp_path, make, schema, *batches):
    """Rows that come out of a stream of these batches, and its state rows after each."""
    rows, left = f"{tmp_path}/in", []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(rows)
        with streams.rocksdb(spark):
            stream = make(spark.readStream.schema(schema).parquet(rows))
            running = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        running.awaitTermination()
        left.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"), left


def test_ended_runs_leave_no_state_and_reject_late_events(spark, tmp_path):
    hour = 36 * 10**12
    schema = "run_number int, mbid long, utc long, ends boolean"
    make = lambda s: streams.run_bins(streams.with_event_time(s, 2024, "1 hour"), hour, 1, 3 * 3600 * 1000)
    batches = (
        [(1, 7, 0, False), (1, 7, hour // 2, False), (1, 7, hour, False), (1, 8, hour, False)],
        [(1, 7, 2 * hour, True), (2, 7, 2 * hour, False)],
        [(1, 7, hour * 3 // 2, False), (1, 7, hour * 7 // 4, False), (1, 8, 2 * hour, False), (2, 7, 9 * hour, False)],  # late for module 7, not for 8
        [(1, 7, hour, False)],  # later than the watermark
    )
    found, left = streamed(spark, tmp_path, make, schema, *batches)
    got = values(found, "run_number", "bin", "mbid", "n", "late")
    # module 8 never ended: what it has left comes out when the watermark passes the run
    assert got == [(1, 0, 7, 2, False), (1, hour, 7, 1, False), (1, hour, 7, 2, True), (1, hour, 8, 1, False), (1, 2 * hour, 8, 1, False), (2, 2 * hour, 7, 1, False)]
    assert left[1] > left[2] == left[3] > 0


@pytest.mark.parametrize(("lag", "rejected"), [(2, 0), (3, 0), (6, 3)])
def test_hub_bins_close_by_the_progress_of_all_channels(lag, rejected):
    """Three channels, the third behind by less than a bin, by one and by two; then one that skips and one that is silent."""
    ahead = [1, 3, 5, 10, 11, 18, 21, 23, 28, 30, 31, 37]
    behind = ahead[:3] + [None] * lag + ahead[3:]
    sent = [(m, t) for k in range(len(behind)) for m, times in ((1, ahead), (2, ahead), (3, behind)) if k < len(times) and (t := times[k])]
    hub, reports, late = bins.HubBins(10), [], []
    for cut in (sent[:7], sent[7:8], sent[8:]):
        out, refused = hub.add(*np.array(cut).T)
        reports, late = reports + out, late + refused
        hub = bins.HubBins.unpacked(10, hub.packed())
    third = [] if rejected else [(10, 19, 3, 3)]
    assert reports == [(1, 9, m, 3) for m in (1, 2, 3)] + [(10, 19, m, 3) for m in (1, 2)] + third
    assert sum(n for *_, n in late) == rejected and {(end, m) for end, m, _ in late} <= {(19, 3)}
    assert hub.end() == [(20, 29, m, 3) for m in (1, 2, 3)] + [(30, 37, m, 3) for m in (1, 2, 3)]
    skips = [(m, t) for t in range(10, 50, 5) for m in (1, 2, 3) if m != 2 or t in (10, 15, 45)]
    hub = bins.HubBins(10)
    reports, late = hub.add(*np.array(skips).T)
    assert reports == [(10, 19, m, 2) for m in (1, 2, 3)] + [(20, 29, 1, 2), (20, 29, 3, 2)] and not late
    assert hub.end() == [(30, 39, 1, 2), (30, 39, 3, 2), (40, 45, 1, 2), (40, 45, 2, 1), (40, 45, 3, 2)]


def test_silent_channels_and_hubs_lose_their_state(spark, tmp_path):
    hour = 36 * 10**12
    schema = "seq long, kind string, mbid long, domclk long, t0 long, t1 long, t2 long, t3 long, bad boolean, gps_offset long, utc long"
    hit = lambda seq, mbid, utc: (seq, "hit", mbid, 50, 0, 0, 0, 0, False, 0, utc)
    make = lambda s: streams.calibrated_hits(streams.with_event_time(s, 2024, "1 hour"), lanes=1, silent_ms=2 * 3600 * 1000)
    found, left = streamed(spark, tmp_path / "a", make, schema, [hit(1, 1, 0), hit(2, 2, 0)], [hit(3, 2, 9 * hour)], [hit(4, 2, 20 * hour)])
    assert [(r.mbid, r.seq, r.utc, r.kept) for r in found.orderBy("seq").collect()][0] == (1, 1, None, False)
    schema = "hub_id int, seq long, mbid long, utc long, ends boolean"
    make = lambda s: streams.hub_bins(streams.with_event_time(s, 2024, "1 hour"), hour, silent_ms=3 * 3600 * 1000)
    found, left = streamed(spark, tmp_path / "b", make, schema, [(1, 1, 7, 5, False), (2, 2, 8, 0, False)], [(2, 3, 8, 9 * hour, False)])
    assert values(found, "hub_id", "first_utc", "last_utc", "mbid", "n") == [(1, 5, 5, 7, 1)] and left[0] > left[1]


def test_continuous_readout_of_long_elements(spark, tmp_path):
    """A ten-hour element finds its hits of all hours; a second element of the request leaves them to it."""
    hour = 36 * 10**12
    hits = spark.createDataFrame([(h, 1, 7, h * hour + hour // 2) for h in range(12)], "seq long, hub_id int, mbid long, utc long")
    element = "struct<elem:int,readout_type:int,source_id:int,first_utc:bigint,last_utc:bigint,dom_id:bigint>"
    requests = spark.createDataFrame([(5, [(0, ranges.GLOBAL, 0, 0, 10 * hour, 0), (1, ranges.GLOBAL, 0, 9 * hour, 11 * hour, 0)])], f"uid int, elements array<{element}>")
    for name, rows in (("hits", hits), ("requests", requests)):
        rows.write.parquet(f"{tmp_path}/{name}")
    joined = streams.continuous_readout(*(spark.readStream.schema(r.schema).parquet(f"{tmp_path}/{n}") for n, r in (("hits", hits), ("requests", requests))), 2024)
    streams.run_to_end(joined, f"{tmp_path}/out", f"{tmp_path}/state")
    assert values(spark.read.parquet(f"{tmp_path}/out"), "uid", "elem", "seq") == [(5, 0, h) for h in range(10)] + [(5, 1, 10)]
    flat = spark.createDataFrame([(5, *e) for e in requests.first().elements], "uid int, elem int, readout_type int, source_id int, first_utc long, last_utc long, dom_id long")
    assert values(ranges.readout(hits, flat, hits.select("mbid", "hub_id").distinct(), hour), "uid", "seq") == [(5, h) for h in range(11)]


def test_gate_opens_by_message_or_limit(spark):
    rows = [(1, k, "Starting run 5" if k == 3 else "x") for k in range(6)] + [(2, k, "x") for k in range(6)] + [(3, 0, "x")]
    moni = spark.createDataFrame(rows, "mbid long, seq long, text string")
    found = {(r.mbid, r.seq): (r.release_seq, r.opened_by) for r in calibrate.gated(moni, 6).collect()}
    assert [found[1, k] for k in range(6)] == [(max(k, 3), "message") for k in range(6)]
    assert [found[2, k] for k in range(6)] == [(max(k, 3), "limit") for k in range(6)]
    assert found[3, 0] == (None, "end")


def test_failed_cards(spark):
    rows = [(1, k, True, False) for k in range(4)] + [(2, k, k != 2, False) for k in range(5)] + [(3, k, k % 2 == 0, k % 2 == 1) for k in range(8)]
    reads = spark.createDataFrame(rows, "card int, seq long, miss boolean, error boolean")
    assert values(windows.failed_cards(reads, 3, 2), "card", "reason") == [(1, "misses"), (3, "errors"), (3, "misses")]


def test_readout_sweep_equals_brute_force(spark):
    """Random hits and elements: null times, times before zero, ties, repeated rows, long and empty elements, many batches."""
    rng = random.Random(5)
    hits = [(k, rng.choice([1, 2, 201]), rng.choice([10, 11, None]), rng.choice([None, rng.randrange(-300, 3000), 500])) for k in range(3000)]
    elements = [(u, e, rng.randrange(-1, 7), rng.choice([12001, 12002, 12201]), first, first + rng.choice([-1, 0, 3, 50, 2500]), rng.choice([10, 11, None])) for u in range(60) for e in range(1 + u % 3) for first in [rng.randrange(-300, 3000)]]
    h = spark.createDataFrame(hits, "seq long, hub_id int, mbid long, utc long").repartition(3)
    e = spark.createDataFrame(elements, "uid int, elem int, readout_type int, source_id int, first_utc long, last_utc long, dom_id long")
    modules = spark.createDataFrame([(m, hub) for hub in (1, 2, 201) for m in (10, 11)], "mbid long, hub_id int")

    def wants(kind, source, dom, hub, mbid):
        surface = hub % 1000 >= 200
        return [True, not surface, surface, source == hub + 12000, not surface and dom == mbid, surface and dom == mbid][kind] if 0 <= kind < 6 else False

    want = sorted({(u, s) for s, hub, m, t in hits for u, _, kind, source, a, b, dom in elements if t is not None and a <= t <= b and (m is not None or kind < 4) and wants(kind, source, dom, hub, m)})
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, ticks, pairs in ((10000, 100, 1 << 16), (7, 1000, 5), (64, 5000, 100)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            sweep.PAIRS = pairs
            assert values(ranges.readout(h, e, modules, ticks), "uid", "seq") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        sweep.PAIRS = 1 << 16
    assert ranges.readout(h, e.where("false"), modules).count() == ranges.readout(h.where("false"), e, modules).count() == 0


def test_windows_by_blocks_equal_whole_windows(spark):
    """Averages, rates, streaks and readings over small blocks are those over the whole history; one hot key, ties, null times."""
    rng = random.Random(8)
    rows = [(k, 1 if k % 3 else 2, rng.choice([k * 7, k * 7 // 20 * 20]) - 300, rng.randrange(3), rng.random() < 0.8 or 200 < k < 420) for k in range(600)]
    df = spark.createDataFrame(rows, "seq long, mbid long, utc long, lc_mode int, hot boolean").withColumn("x", F.col("utc") * 1.0)
    whole = Window.partitionBy("mbid")
    for n, block in ((1, 4), (5, 8), (9, 16)):
        want = df.withColumn("sma", F.avg("x").over(whole.orderBy("seq").rowsBetween(-(n - 1), 0)))
        assert values(windows.moving_average(df, "mbid", "seq", "x", n, block), "seq", "sma") == values(want, "seq", "sma")
    for span, block in ((30, 31), (50, 7), (100, 1000)):
        near = whole.orderBy("utc").rangeBetween(-span + 1, 0)
        want = df.withColumn("rate", F.count(F.lit(1)).over(near) / (span / SECOND)).withColumn("lc_rate", F.sum((F.col("lc_mode") > 0).cast("long")).over(near) / (span / SECOND))
        assert values(windows.event_rate(df, span, block=block), "seq", "rate", "lc_rate") == values(want, "seq", "rate", "lc_rate")
    for key in (None, "mbid"):
        streak, want = {}, []
        for seq, mbid, *_, hot in rows:
            at = mbid if key else 0
            streak[at] = streak.get(at, 0) + 1 if hot else 0
            want += [(seq, streak[at])] if streak[at] >= 6 else []
        for block in (1, 5, 64, 1 << 20):
            assert values(windows.streaks(df, "hot", 6, key, block), "seq", "streak") == want
    tcal, gps = df.selectExpr("seq", "mbid as card", "mbid"), df.where("seq % 37 = 5").selectExpr("seq", "mbid as card", "if(seq % 2 = 0, seq, null) as gps_offset")
    want = tcal.join(gps.withColumnRenamed("seq", "at"), "card", "left").where("at is null or at <= seq").groupBy("seq").agg(F.max_by("gps_offset", F.when(F.col("gps_offset").isNotNull(), F.col("at"))).alias("gps_offset"))
    want = tcal.join(want, "seq", "left")
    for block in (10, 100, 1 << 20):
        assert values(lookups.with_gps(tcal, gps, block), "seq", "gps_offset") == values(want, "seq", "gps_offset")


def test_one_streak_over_all_rows_is_many_tasks(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("id as seq", "true as hot", "1 as card")
    found = windows.streaks(df, "hot", 1, "card", block=100)
    assert found.agg(F.max("streak"), F.count("*")).first() == (4000, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        rows = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 1 and max(rows) < 4000


def test_latency_samples_step_from_pick_to_pick(spark):
    rng = random.Random(6)
    rows = [(m, k, 10 * k + rng.choice([0, 5, -80, 90])) for m in (1, 2, 3) for k in range(400)]
    want = []
    for m in (1, 2, 3):
        last = None
        for _, k, clock in (r for r in rows if r[0] == m):
            if last is None or clock - last > 37:
                last = clock
                want.append((m, k, clock))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (10000, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert values(windows.latency_samples(spark.createDataFrame(rows, "mbid long, seq long, domclk long"), 37), "mbid", "seq", "domclk") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
