"""Steps that must not grow with the square of their input: same results as plain Python, and few rows on the way."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tickflow.operators import clocks, monitor, ranges
from tickflow.plans import queries
from tickflow.sources import ring


def most_rows(df) -> int:
    """Collect ``df``; the most rows that any node of its plan put out."""

    def nodes(plan):
        yield plan
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName())
        below = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
        for p in below:
            yield from nodes(p)

    df._jdf.collectToPython()
    found = [n.metrics().get(m) for n in nodes(df._jdf.queryExecution().executedPlan()) for m in ("numOutputRows", "pythonNumRowsReceived")]
    return max(m.get().value() for m in found if m.isDefined())


def events_of(spark, path, n, seconds):
    """A folder with ``n`` events of 90 channels in ``seconds`` seconds."""
    kind = "element_at(array('error', 'click', 'purchase', 'signup', 'view'), cast(1 + id % 5 as int))"
    rows = spark.range(n).selectExpr("id as event_id", f"cast(timestamp_micros(1704070800000000 + id * {seconds} * 1000000 div {n}) as timestamp_ntz) as ts", "id * 7 % 90 as user_id", f"{kind} as event_type", "1D as value", "concat('{\"k\": ', id * 13 % 100, '}') as props")
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_offsets_do_not_pair_readings_with_modules(spark):
    rng = random.Random(3)
    seqs = list(range(900))
    rng.shuffle(seqs)
    gps = [(k % 2, s, 1000 * s, rng.choice([None] + [20_000 * s] * 9)) for k, s in enumerate(seqs[:300])]
    ntp = [(s, 1000 * s + 7, s * 10**6, rng.choice([1, 10**9])) for s in seqs[300:400]]
    points = [(k % 2, rng.randrange(40), s, 20_000 * s + rng.randrange(500), s * 10**6 if k % 11 else None, rng.choice([1, 1, 10**9])) for k, s in enumerate(seqs[400:])]
    tables = spark.createDataFrame(gps, "card int, seq long, gps_ms long, dorclk long"), spark.createDataFrame(ntp, "seq long, ntp_system_ms long, point_ns long, exec_ns long"), spark.createDataFrame(points, "card int, cwd long, seq long, point_dor long, point_ns long, exec_ns long")
    want, last = {}, {}
    for card, seq, ms, clock in sorted(gps, key=lambda r: r[1]):
        server = max((n for n in ntp if n[0] <= seq and n[3] == 1), default=None)
        if server is None:
            continue
        latest = {p[1]: p for p in sorted(points, key=lambda p: p[2]) if p[0] == card and p[2] <= seq and p[5] == 1}
        each = [] if clock is None else [Fraction(p[4] + (clock - p[3]) * 50 - server[2], 10**6) for p in latest.values() if p[4] is not None]
        last[card] = server[1] + sum(each) / len(each) - ms if each else last.get(card, 0)
        want[card, seq] = float(last[card])
    for block in (16, 1 << 16):
        df = clocks.master_offsets(*tables, block=block)
        found = {(r.card, r.seq): r.offset for r in df.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)
    assert most_rows(clocks.master_offsets(*tables)) < 3 * 900


def test_summary_is_that_of_the_readout(spark):
    """Requests with many elements, alike and overlapping, of all kinds; hubs inside and on the surface; hits without time, hub or module."""
    rng = random.Random(5)
    hubs = [1, 2, 201]
    modules = spark.createDataFrame([(10 * h + k, h) for h in hubs for k in range(3)], "mbid long, hub_id int")
    mbid = lambda h: rng.choice([None] + [10 * (h or 1) + k for k in range(4)])
    rows = [(s, h, mbid(h), rng.choice([None] + [rng.randrange(-40, 200)] * 20)) for s, h in enumerate(rng.choices([*hubs, None], k=400))]
    hits = spark.createDataFrame(rows, "seq long, hub_id int, mbid long, utc long")
    elements = []
    for uid in range(60):
        for elem in range(rng.choice([1, 1, 2, 6])):
            hub, first = rng.choice(hubs), rng.randrange(-60, 220)
            elements.append((uid, elem, rng.choice([0, 1, 2, 3, 4, 4, 4, 5, 6]), 12000 + hub, first, rng.choice([first + rng.randrange(-3, 60), 2**63 - 1]) if uid % 9 == 0 else first + rng.randrange(-3, 40), 10 * hub + rng.randrange(3)))
    e = spark.createDataFrame(elements, "uid int, elem int, readout_type int, source_id int, first_utc long, last_utc long, dom_id long")
    near = e.withColumn("last_utc", F.least("last_utc", F.lit(500)))
    of_pairs = F.struct("utc", "source_id", "mbid", "seq")
    want = ranges.readout(hits, near, modules, 7).groupBy("uid").agg(F.count("*").alias("n"), F.min(of_pairs).alias("first_hit"), F.max(of_pairs).alias("last_hit"))
    want = sorted(want.collect())
    assert len(want) > 30
    for ticks in (7, 50, 10**6):
        assert sorted(ranges.readout_summary(hits, e, modules, ticks).collect()) == want
    assert ranges.readout_summary(hits, e.where("false"), modules).count() == ranges.readout_summary(hits.where("false"), e, modules).count() == 0


@pytest.mark.parametrize("name", ["a14_readout_assembly", "a15_sender_counters"])
def test_summaries_of_readouts_list_no_hits(spark, tmp_path, name):
    """600 requests take some 300 000 of 3000 hits, all in an hour."""
    assert most_rows(queries.QUERIES[name](spark, events_of(spark, tmp_path, 3000, 3600))) < 5 * 3000


def test_replay_totals_beyond_a_bigint(spark):
    """4000 steps back of 5 days of ticks, and as many ahead."""
    far = 120 * 36 * 10**12
    hits = spark.range(8001).selectExpr("1 as hub_id", "id as seq", f"(1 - id % 2) * {far}L as utc")
    assert [tuple(map(int, r)) for r in monitor.replay_totals(hits, 5, block=100).collect()] == [(1, 8001, 4000 * far, 4000 * far)]
    assert monitor.replay_totals(hits.where("false"), 5).count() == 0


def test_replay_totals_query_beyond_a_bigint(spark, tmp_path):
    """In 29 days a tenth of the hits arrive five days back; the sums of 70 000 hits are over 2^63."""
    path = events_of(spark, tmp_path, 70_000, 29 * 86400)
    last, want = {}, {}
    for r in sorted(queries.Views(spark, path).hits_disordered.select("seq", "hub_id", "utc").collect()):
        total = want.setdefault(r.hub_id, [0, 0, 0])
        step = r.utc - last.get(r.hub_id, r.utc)
        total[0], total[1], total[2], last[r.hub_id] = total[0] + 1, total[1] + step * (step > 36 * 10**12), total[2] - step * (step < 0), r.utc
    found = queries.QUERIES["a20_replay_totals"](spark, path)
    assert {r[0]: [int(x) for x in r[1:]] for r in found.collect()} == want and max(map(max, want.values())) > 2**63


def test_ring_catalog_is_not_written_by_a_task_that_holds_all_partitions(spark, tmp_path):
    """A task that reads every partition of a shuffle one after the other keeps a page of memory for each."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        spark.sparkContext.setJobGroup("ring", "ring")
        sink = ring.ring_sink(f"{tmp_path}/ring", 10, 3)
        for k in range(2):
            sink(spark.range(1000).selectExpr("id as seq", "cast(id % 3 as int) as hub_id", "id as mbid", f"id div 20 + {k} as utc"), k)
        ring.compact(spark, f"{tmp_path}/ring")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = [i for j in tracker.getJobIdsForGroup("ring") for i in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(i)]
    done = [store.lastStageAttempt(i) for i in stages]
    assert len(done) > 10 and max(s.peakExecutionMemory() for s in done if s.numTasks() == 1) < 300 << 20
    assert [tuple(r) for r in ring.catalog(spark, f"{tmp_path}/ring", 10).select("hub_id", "slice").sort("hub_id", "slice").collect()] == [(h, s) for h in range(3) for s in range(3, 6)]
