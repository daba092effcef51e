"""Queries that run streams over the event table, and those that write and read files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions.ticks import event_time
from ..operators import filters

from ..schemas import DAY, HOUR
from ..scratch import scratch_path
from ..sources import records as binary
from ..sources import spool, spool_files
from ..sources.views import Views
from ..streaming import queries as streams
from .queries import ACCEPTS, CHAIN, FINE_SQL, SLICE, WAVE, WIDE, query, stamps

#: Micro-batches that a table is cut into.
BATCHES = 4


def replayed_stream(v: Views, rows: DataFrame, name: str, order: str = "seq", part: Column | None = None) -> DataFrame:
    """``rows`` as a stream of BATCHES micro-batches in ``order`` (or by number ``part``); a batch is several files, written in parallel."""
    whole, path = scratch_path(v.spark, f"{name}-whole"), scratch_path(v.spark, name)
    (rows if part is None else rows.withColumn("__part", part)).write.parquet(whole)
    rows = v.spark.read.parquet(whole)
    files = max(2, v.spark.sparkContext.defaultParallelism // 2)
    if part is None:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        step = ((high or 0) - (low or 0)) // BATCHES + 1
        rows = rows.withColumn("__part", F.expr(f"cast(({order} - {low or 0}) div {step} as int)"))
    for k in range(BATCHES):
        rows.where(F.col("__part") == k).drop("__part").repartition(files).write.parquet(f"{path}/part={k}")
    return v.spark.readStream.schema(rows.drop("__part").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def finished(v: Views, stream: DataFrame, name: str) -> DataFrame:
    path = scratch_path(v.spark, name)
    streams.run_to_end(stream, path, scratch_path(v.spark, f"{name}-state"))
    return v.spark.read.schema(stream.schema).parquet(path)


# --- files --------------------------------------------------------------------------------------------------


@query("s05_dom_configs", "SELECT mbid, name, position FROM doms", ("doms",))
def _(v):
    path = scratch_path(v.spark, "xml")
    doms = v.doms.select(F.lower(F.hex("mbid")).alias("_mbid"), "name", "position")
    doms.write.format("xml").option("rowTag", "domConfig").option("rootTag", "domConfigList").save(path)
    return binary.read_dom_configs(v.spark, path).select("mbid", "name", F.col("position").cast("int").alias("position"))


@query("s06_stream_sink", "SELECT 'hits' AS stream, count(*) AS n FROM hits UNION ALL SELECT 'moni', count(*) FROM moni UNION ALL SELECT 'tcal', count(*) FROM tcal UNION ALL SELECT 'supernova', count(*) FROM supernova", ("hits", "moni", "tcal", "supernova"))
def _(v):
    path = scratch_path(v.spark, "streams")
    spool.write_streams({"hits": v.hits.select("seq"), "moni": v.moni.select("seq"), "tcal": v.tcal.select("seq"), "supernova": v.supernova.select("seq")}, path)
    return v.spark.read.parquet(path).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("s07_tee", "SELECT hub_id, count(*) AS n, count(*) FILTER (lc_mode <> 0 OR trigger_mode = 4) AS n_thin FROM hits GROUP BY hub_id", ("hits",))
def _(v):
    full, thin = scratch_path(v.spark, "full"), scratch_path(v.spark, "thin")
    spool.tee(v.hits.select("seq", "hub_id", "lc_mode", "trigger_mode"), lambda df: df.write.parquet(full), lambda df: filters.forwarded(df).write.parquet(thin))
    every = v.spark.read.parquet(full).groupBy("hub_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(v.spark.read.parquet(thin).groupBy("hub_id").agg(F.count(F.lit(1)).alias("n_thin")), "hub_id")


@query("s10_replay", f"SELECT CASE WHEN utc // {SLICE} % 2 = 0 THEN 'hit' ELSE 'moni' END AS stream, count(*) AS n, min(CASE WHEN utc // {SLICE} % 2 = 0 THEN utc ELSE mbid END) AS first_utc FROM hits WHERE utc // {SLICE} % 2 = 1 OR utc // {SLICE} >= 6 GROUP BY ALL", ("hits",))
def _(v):
    """Replay files of hits and of another stream, written and then read as a stream of files."""
    path, out = scratch_path(v.spark, "replay"), scratch_path(v.spark, "replayed")
    name = "concat('hub', lpad(hub_id, 4, '0'), if(slice % 2 = 0, '_hit_', '_moni_'), slice, '.dat')"
    spool_files.write_spool(v.hits, path, SLICE, name).agg(F.sum("n")).collect()
    stream = spool_files.replay_stream(v.spark, path, skip=6, files_per_trigger=40)
    streams.run_to_end(stream, out, scratch_path(v.spark, "state"))
    return v.spark.read.schema(stream.schema).parquet(out).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("utc").alias("first_utc"))


@query("s11_spool_round_trip", f"SELECT hub_id, count(*) AS n, min(utc) AS lo, max(utc) AS hi FROM hits WHERE utc BETWEEN {4 * SLICE} AND {11 * SLICE} GROUP BY hub_id", ("hits",))
def _(v):
    path = scratch_path(v.spark, "spool")
    spool.write_spool(v.hits.select("seq", "hub_id", "mbid", "utc"), path, SLICE)
    return spool.read_range(v.spark, path, 4 * SLICE, 11 * SLICE, SLICE).groupBy("hub_id").agg(F.count(F.lit(1)).alias("n"), F.min("utc").alias("lo"), F.max("utc").alias("hi"))


# --- streams ------------------------------------------------------------------------------------------------

BINS = """SELECT mbid, start_us, count(*) AS n FROM (SELECT mbid, utc // 10000 // 43200000000 * 43200000000 AS start_us FROM hits) WHERE start_us + 43200000000 <= (SELECT max(utc) // 10000 FROM hits) - 3600000000 GROUP BY ALL"""


PARTS = "parts AS (SELECT h.*, (seq - lo) // step AS part FROM hits h, (SELECT min(seq) AS lo, (max(seq) - min(seq)) // 4 + 1 AS step FROM hits))"
LATE = PARTS + """, sent AS (SELECT mbid, utc // 10000 // 43200000000 * 43200000000 AS start_us, CASE WHEN k % 10 = 0 THEN 3 ELSE part END AS part FROM parts),
    marks AS (SELECT max(utc) FILTER (part < 2 AND k % 10 <> 0) // 10000000 * 1000 - 3600000000 AS before_last, max(utc) // 10000000 * 1000 - 3600000000 AS at_end FROM parts),
    closed AS (SELECT mbid, start_us, count(*) FILTER (part < 3 OR start_us + 43200000000 > before_last) AS n, count(*) AS arrived FROM sent, marks WHERE start_us + 43200000000 <= at_end GROUP BY ALL)"""


@query("t01_late_data", "SELECT count(*) FILTER (n > 0) AS n_bins, sum(n)::bigint AS n_counted, sum(arrived - n)::bigint AS n_late FROM closed", ("hits",), LATE)
def _(v):
    """A tenth of the hits arrive in the last batch: those of bins that came out before it are late and rejected.

    A bin comes out in the batch after the one that moved the watermark past it, so the last batch still takes
    what belongs to bins that only the third one passed.
    """
    low, high = v.hits.agg(F.min("seq"), F.max("seq")).first()
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    part = F.when(F.col("k") % 10 == 0, BATCHES - 1).otherwise(F.expr(f"cast((seq - {low or 0}) div {step} as int)"))
    rows = v.hits.select("seq", "mbid", "utc", "k")
    done = windowed(v, rows, part)
    bins = done.agg(F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_counted"), F.max("start_us").alias("last_us"))
    arrived = rows.withColumn("start_us", F.expr("utc div 10000 div 43200000000 * 43200000000")).crossJoin(F.broadcast(bins)).where("start_us <= last_us")
    late = arrived.groupBy("n_bins", "n_counted").agg(F.count(F.lit(1)).alias("n"))
    return late.select("n_bins", "n_counted", (F.col("n") - F.col("n_counted")).alias("n_late"))


@query("t02_tumbling", BINS, ("hits",))
def _(v):
    return windowed(v)


def windowed(v: Views, rows: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    rows = v.hits.select("seq", "mbid", "utc") if rows is None else rows
    hits = streams.with_event_time(replayed_stream(v, rows, "hits", part=part), 2024, "1 hour")
    done = finished(v, streams.binned_counts(hits, "12 hours"), "bins")
    return done.select("mbid", (F.unix_micros("start") - 1704067200000000).alias("start_us"), "n")


LAGGING = PARTS + f""", sent AS (SELECT *, utc // {2 * DAY} * {2 * DAY} AS bin, k % 10 = 0 AS lags FROM parts),
    fronts AS (SELECT hub_id, max(bin) FILTER (part < 3 AND NOT lags) AS front, max(bin) AS newest, max(utc) AS latest FROM sent GROUP BY hub_id),
    judged AS (SELECT s.*, newest, latest, front - {2 * DAY} AS open_from, lags AND part < 3 AND utc < front - {2 * DAY} AS rejected FROM sent s JOIN fronts USING (hub_id)),
    starts AS (SELECT hub_id, min(utc) FILTER (NOT rejected) AS first_seen FROM judged GROUP BY hub_id)"""


@query(
    "t02_all_channels",
    f"""SELECT hub_id, CASE WHEN bin = min(bin) OVER (PARTITION BY hub_id) THEN first_seen ELSE bin END AS first_utc, CASE WHEN bin = newest THEN latest ELSE bin + {2 * DAY} - 1 END AS last_utc, mbid, count(*) AS n, false AS rejected
      FROM judged JOIN starts USING (hub_id) WHERE NOT rejected GROUP BY hub_id, bin, first_seen, newest, latest, mbid
      UNION ALL SELECT hub_id, NULL, open_from - 1, mbid, count(*), true FROM judged WHERE rejected GROUP BY hub_id, open_from, mbid""",
    ("hits",), LAGGING,
)
def _(v):
    """Bins that close when all channels of a hub have gone on; a tenth of the hits lag until the last batch."""
    hits = v.hits.select("hub_id", "seq", "mbid", "utc", "k", F.lit(False).alias("ends"))
    top = hits.groupBy("hub_id").agg(F.max("seq").alias("seq"), F.max("utc").alias("utc"))
    ends = top.selectExpr("hub_id", "seq + 1 as seq", "0L as mbid", "utc", "1 as k", "true as ends")
    low, high = v.hits.agg(F.min("seq"), F.max("seq")).first()
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    part = F.when(F.expr("ends or k % 10 = 0"), BATCHES - 1).otherwise(F.expr(f"cast((seq - {low or 0}) div {step} as int)"))
    events = streams.with_event_time(replayed_stream(v, hits.union(ends), "events", part=part), 2024, "60 days")
    return finished(v, streams.hub_bins(events, 2 * DAY), "hub-bins")


def run_events(v: Views) -> DataFrame:
    """Hits of runs, and after the last one of a run an event for each of its modules that ends it; a stream with a watermark.

    One event past all runs moves the watermark and is taken out behind it.
    """
    events = filters.in_runs(v.hits, v.runs).select("run_number", F.expr("2 * seq as seq"), "mbid", "utc", F.lit(False).alias("ends"))
    last = events.groupBy("run_number").agg(F.max("seq").alias("top"))
    modules = events.select("run_number", "mbid").distinct().join(v.runs, "run_number").join(last, "run_number")
    ends = modules.selectExpr("run_number", "top + 1 as seq", "mbid", "stop_utc + 1 as utc", "true as ends")
    beyond = v.runs.agg(F.max("stop_utc").alias("stop"), F.max("run_number").alias("run")).crossJoin(last.agg(F.max("top").alias("top")))
    beyond = beyond.selectExpr("run + 1 as run_number", "top + 2 as seq", "0L as mbid", f"stop + {DAY} as utc", "false as ends")
    stream = streams.with_event_time(replayed_stream(v, events.unionByName(ends).unionByName(beyond), "events"), 2024, "1 hour")
    stop = v.runs.agg(F.max("stop_utc")).first()[0]
    return stream.where(F.col("event_ts") < event_time(f"{stop + DAY}L", 2024))


@query("t03_run_flush", f"SELECT run_number, utc // {WIDE} * {WIDE} AS bin, mbid, count(*) AS n, false AS late FROM hits JOIN runs ON utc BETWEEN start_utc AND stop_utc GROUP BY ALL", ("hits", "runs"))
def _(v):
    return finished(v, streams.run_bins(run_events(v), WIDE), "run-bins")


@query("t03_state_left", "SELECT 0 AS state_rows, 0 AS rejected, count(*) AS counted FROM hits JOIN runs ON utc BETWEEN start_utc AND stop_utc", ("hits", "runs"))
def _(v):
    """State rows that are left when the watermark has passed the last run, rejected events and counted ones."""
    path = scratch_path(v.spark, "run-bins")
    with streams.rocksdb(v.spark):
        running = streams.run_bins(run_events(v), WIDE).writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(v.spark, "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    found = v.spark.read.parquet(path).agg(F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("rejected"), F.sum(F.when(~F.col("late"), F.col("n"))).alias("counted"))
    return found.select(F.lit(running.lastProgress["stateOperators"][0]["numRowsTotal"]).alias("state_rows"), "rejected", "counted")


ASKED = "asked AS (SELECT mbid, seq, (dom_rx + (k - 60) * 400000) AS domclk FROM tcal)"


@query(
    "t04_calibrated_hits",
    """SELECT mbid, seq, utc FROM (SELECT h.mbid, h.seq, (SELECT arg_min(i.dor_mid + (h.domclk * 250 - i.dom_mid) + trunc(i.epsilon * (h.domclk * 250 - i.dom_mid)::double)::bigint, i.upper)
      FROM chain i WHERE i.mbid = h.mbid AND outcome = 'accepted' AND i.upper >= h.domclk * 250) AS utc FROM asked h) WHERE utc IS NOT NULL""",
    ("tcal",), CHAIN + ", " + ASKED, True,
)
def _(v):
    return calibrated(v, 400_000).select("mbid", "seq", "utc")


def calibrated(v: Views, spread: int) -> DataFrame:
    """A calibration and a hit for each row, the hit's clock up to 60 times ``spread`` before or after; through the stream."""
    none = F.lit(0).cast("long")
    t = stamps(v).withColumn("t3", F.coalesce("t3", none)).select("mbid", "seq", F.lit("tcal").alias("kind"), none.alias("domclk"), "t0", "t1", "t2", "t3", "bad", "gps_offset")
    h = v.tcal.select("mbid", "seq", F.lit("hit").alias("kind"), F.expr(f"dom_rx + (k - 60) * {spread}L").alias("domclk"), none, none, none, none, F.lit(False), none)
    return finished(v, streams.calibrated_hits(replayed_stream(v, t.union(h), "records")), "calibrated")


@query("t05_order_after_calibration")
def _(v):
    """Kept hits of the calibrated stream by channel; steps back are judged in order of release, which SQL does not see."""
    return calibrated(v, 1_000_000).groupBy("mbid").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"))


def asked(v: Views) -> DataFrame:
    """Readout requests as they come: one row with all elements."""
    return v.request_elements.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("elem", "readout_type", "source_id", "first_utc", "last_utc", "dom_id"))).alias("elements"))


@query("t06_continuous_readout", f"SELECT uid, min(elem) AS elem, seq, hub_id, mbid, utc FROM hits JOIN request_elements ON utc BETWEEN first_utc AND last_utc WHERE {ACCEPTS} GROUP BY ALL", ("hits", "request_elements"))
def _(v):
    hits = replayed_stream(v, v.hits.select("seq", "hub_id", "mbid", "utc"), "hits")
    found = streams.continuous_readout(hits, replayed_stream(v, asked(v), "requests", "uid"), 2024, "4 hours")
    with streams.dealt_by_cores(v.spark):
        return finished(v, found, "readout")


#: Time in microseconds of 2024 up to which both sides of the readout have been seen, less the delay of an hour.
KEPT = f"""pieces AS (SELECT uid, elem, s, least(last_utc, (s + 1) * {HOUR} - 1) // 10000 AS last_us FROM request_elements, LATERAL unnest(range(first_utc // {HOUR}, last_utc // {HOUR} + 1)) AS r(s)),
    marks AS (SELECT least((SELECT max(utc) FROM hits) // 10000000, (SELECT max(last_us) FROM pieces) // 1000) * 1000 - 3600000000 AS mark)"""


@query("t07_state_eviction", "SELECT (SELECT count(*) FROM hits) + (SELECT count(*) FROM pieces) AS arrived, (SELECT count(*) FROM hits, marks WHERE utc // 10000 > mark - 3600000000) + (SELECT count(*) FROM pieces, marks WHERE last_us > mark) AS kept", ("hits", "request_elements"), KEPT)
def _(v):
    """Rows that the continuous readout took into its state, and those that are still there at the end."""
    hits, requests = v.hits.select("seq", "hub_id", "mbid", "utc"), asked(v)
    joined = streams.continuous_readout(replayed_stream(v, hits, "hits"), replayed_stream(v, requests, "requests", "uid"), 2024, "1 hour")
    with streams.dealt_by_cores(v.spark):
        running = joined.writeStream.format("noop").option("checkpointLocation", scratch_path(v.spark, "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    seen = [o for p in running.recentProgress for o in p["stateOperators"]]
    kept, taken = sum(o["numRowsTotal"] for o in running.lastProgress["stateOperators"]), sum(o["numRowsUpdated"] for o in seen)
    return v.spark.createDataFrame([(taken, kept)], "arrived bigint, kept bigint")


@query("t08_run_switching", "SELECT run_number, mbid, count(*) AS n FROM hits JOIN runs ON utc BETWEEN start_utc AND stop_utc GROUP BY ALL", ("hits", "runs"))
def _(v):
    return finished(v, streams.counts_by_run(run_events(v)), "by-run")


@query("t09_batch_sink", "SELECT count(*) AS n, count(*) FILTER (lc_mode <> 0 OR trigger_mode = 4) AS n_thin FROM hits", ("hits",))
def _(v):
    store, thin = scratch_path(v.spark, "store"), scratch_path(v.spark, "thin")
    hits = replayed_stream(v, v.hits.select("seq", "lc_mode", "trigger_mode"), "hits")
    hits.writeStream.foreachBatch(streams.batch_sink(store, thin)).option("checkpointLocation", scratch_path(v.spark, "state")).trigger(availableNow=True).start().awaitTermination()
    n = v.spark.read.parquet(f"{store}/batch=*").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(v.spark.read.parquet(f"{thin}/batch=*").agg(F.count(F.lit(1)).alias("n_thin")))


# --- choices by name ----------------------------------------------------------------------------------------


@query("x03_method_by_name", """SELECT w.seq, unknown FROM waves w
    LEFT JOIN (SELECT seq, round(arg_max(i + (0 - a) / (b - a) - 48, i), 6) AS unknown FROM samples WHERE i BETWEEN 31 AND 46 AND a > 0 AND b <= 0 GROUP BY seq) USING (seq)""", ("tcal",), FINE_SQL)
def _(v):
    """An unknown method is zero crossing."""
    w = v.tcal.select("seq", F.expr(WAVE).alias("w"))
    return w.select("seq", F.round(records.fine_correction("w", "no such method") / 50e-9, 6).alias("unknown"))


CONVERTERS = {"simple": lambda hits, doms: records.thin_hit(hits), "simpler": records.thinner_hit}


@query("x04_converter_by_name", "SELECT 'simple' AS kind, count(*) AS n, sum(source_id)::bigint AS ids FROM (SELECT hub_id + 12000 AS source_id FROM hits) UNION ALL SELECT 'simpler', count(*), sum(channel_id)::bigint FROM hits JOIN doms USING (mbid)", ("hits", "doms"))
def _(v):
    out = [CONVERTERS[k](v.hits, v.doms).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(c).alias("ids")) for k, c in (("simple", "source_id"), ("simpler", "channel_id"))]
    return out[0].union(out[1]).select("kind", "n", "ids")
