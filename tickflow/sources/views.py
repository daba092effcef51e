"""Detector tables derived from the general ``events`` and ``conversations`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-01 in microseconds: ticks count from here.
YEAR_US = 1704067200000000


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        e = self.table("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - YEAR_US)
        return e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("utc", F.col("us") * 10000)

    @property
    def numbered(self) -> DataFrame:
        """Events with ``rn``, their number in their channel."""
        return self.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))

    @property
    def doms(self) -> DataFrame:
        """One row for each channel with events, and five that never send any."""
        seen = self.table("events").select(F.col("user_id").alias("mbid")).distinct()
        top = self.table("events").agg(F.max("user_id").alias("top"))
        unseen = top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + 5)).alias("mbid"))
        return seen.union(unseen).selectExpr(
            "mbid", "cast(1 + mbid % 3 as int) as hub_id", "cast(1 + mbid % 3 as int) as string", "cast(mbid % 60 as int) as position", "mbid as channel_id",
            "concat('D', mbid) as name", "cast(mbid % 8 as int) as card", "cast(mbid % 4 as int) as pair", "if(mbid % 2 = 0, 'A', 'B') as dom",
        )

    @property
    def hits(self) -> DataFrame:
        return (
            self.events.withColumn("lc_mode", F.expr("case event_type when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 else 0 end"))
            .withColumn("trigger_mode", F.expr("k % 5"))
            .withColumn("trigger_bits", F.expr("case trigger_mode when 1 then 4 when 2 then 3 when 3 then 16 when 4 then 4096 else 0 end"))
            .selectExpr(
                "event_id as seq", "user_id as mbid", "cast(1 + user_id % 3 as int) as hub_id", "utc", "utc div 250 as domclk", "3 as fmt", "lc_mode",
                "trigger_mode", "k % 2 as atwd_chip", "54 + k as rec_len", "shiftleft(lc_mode, 16) | shiftleft(trigger_bits, 18) as word1", "k",
            )
        )

    @property
    def hits_disordered(self) -> DataFrame:
        return self.hits.withColumn("utc", F.expr("if(k % 10 = 0, utc - 120L * 36000000000000L, utc)"))

    @property
    def hits_edge(self) -> DataFrame:
        """Hits with end markers, negative times, unknown channels and short records."""
        return self.hits.selectExpr(
            "seq", "if(k = 2, mbid + 100000, mbid) as mbid", "hub_id", "case k when 0 then 9223372036854775807L when 1 then -1L else utc end as utc",
            "domclk", "fmt", "lc_mode", "trigger_mode", "atwd_chip", "if(k = 3, 20, rec_len) as rec_len", "word1", "k",
        )

    @property
    def request_elements(self) -> DataFrame:
        hour = "36000000000000L"
        e = self.events.where("event_type = 'error'")
        common = ["cast(event_id as int) as uid"]
        tail = ["12000 + cast(1 + user_id % 3 as int) as source_id", "user_id as dom_id"]
        first = e.selectExpr(*common, "0 as elem", f"utc - {hour} as first_utc", f"utc + {hour} as last_utc", "k % 6 as readout_type", *tail)
        second = e.where("k % 4 = 0").selectExpr(*common, "1 as elem", f"utc + 2 * {hour} as first_utc", f"utc + 3 * {hour} as last_utc", "0 as readout_type", *tail)
        return first.union(second)

    @property
    def runs(self) -> DataFrame:
        hour = "36000000000000L"
        return self.spark.range(6).selectExpr("cast(100 + id as int) as run_number", f"id * 120 * {hour} as start_utc", f"id * 120 * {hour} + 110 * {hour} as stop_utc")

    @property
    def tcal(self) -> DataFrame:
        return self.numbered.selectExpr(
            "event_id as seq", "user_id as mbid", "cast(user_id % 8 as int) as card", "rn * 20000000 as dor_tx", "rn * 20000000 + 100000 + if(k >= 95, 4000, 0) as dor_rx",
            "rn * 40000000 + 98000 as dom_rx", "rn * 40000000 + 98000 + 4000 as dom_tx", "k % 50 as fine_ticks", "k = 50 as bad", "0L as gps_offset", "k", "utc",
        )

    @property
    def supernova(self) -> DataFrame:
        return self.numbered.selectExpr(
            "event_id as seq", "user_id as mbid", "cast(1 + user_id % 3 as int) as hub_id", "rn * 524288 + if(k = 0, 65536, 0) as domclk",
            "transform(sequence(0, 7), i -> (k + i) % 16) as scalers",
        )

    @property
    def moni(self) -> DataFrame:
        return self.events.where("event_type = 'click'").selectExpr(
            "event_id as seq", "user_id as mbid", "cast(1 + user_id % 3 as int) as hub_id", "utc", "utc div 250 as domclk", "if(k % 3 = 0, 200, if(k % 3 = 1, 203, 7)) as rec_type",
            "case k % 10 when 0 then concat('LBM OVERFLOW ', k) when 1 then 'Starting run' else 'ok' end as text",
            "array(1000 + k, 0, 600 + k, k, 2 * k, 3 * k, 4 * k, 5 * k) as adc", "transform(sequence(0, 15), i -> k + 10 * i) as dac", "1500 + k as hv_set", "1490 + k as hv_read", "1 + k % 2 as version", "5000 + k as temp_adc", "k as spe", "k div 2 as mpe",
        )

    @property
    def gps(self) -> DataFrame:
        return self.events.where("event_type = 'signup'").selectExpr(
            "event_id as seq", "cast(user_id % 8 as int) as card", "dayofyear(ts) as day", "hour(ts) as hour", "minute(ts) as minute", "cast(second(ts) as int) as second",
            "if(k < 80, 32, 46) as quality", "(us div 1000000) * 20000000 + 12345 + if(k = 99, 1, 0) as dorclk", "0 as leap", "k",
        )

    @property
    def ntp(self) -> DataFrame:
        return self.events.where("event_type = 'click'").selectExpr(
            "event_id as seq", "unix_millis(cast(ts as timestamp)) as ntp_system_ms", "value - 150 as local_offset_ms", "utc div 10 as point_ns", "cast(k * 400000 as bigint) as exec_ns"
        )

    @property
    def tcal_points(self) -> DataFrame:
        return self.events.where("event_type = 'purchase'").selectExpr(
            "event_id as seq", "cast(user_id % 8 as int) as card", "user_id as cwd", "utc div 500 as point_dor", "utc div 10 as point_ns", "cast(k * 600000 as bigint) as exec_ns"
        )

    @property
    def cycles(self) -> DataFrame:
        return self.table("conversations").selectExpr("conv_id as id", "turn as cycle", "char_length(text) as size")

    @property
    def samples(self) -> DataFrame:
        return self.table("events").selectExpr("user_id as key", "event_id as seq", "value as x")


#: The same views for DuckDB, by name; each may use those before it.
SQL = {
    "ev": """SELECT *, epoch_us(ts) - 1704067200000000 AS us, json_extract(props, '$.k')::int AS k, (epoch_us(ts) - 1704067200000000) * 10000 AS utc FROM events""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev",
    "doms": """SELECT mbid, 1 + mbid % 3 AS hub_id, 1 + mbid % 3 AS string, mbid % 60 AS position, mbid AS channel_id, 'D' || mbid AS name, mbid % 8 AS card, mbid % 4 AS pair,
        CASE WHEN mbid % 2 = 0 THEN 'A' ELSE 'B' END AS dom
        FROM (SELECT DISTINCT user_id AS mbid FROM events UNION ALL SELECT (SELECT max(user_id) FROM events) + i FROM range(1, 6) AS r(i))""",
    "hits": """SELECT event_id AS seq, user_id AS mbid, 1 + user_id % 3 AS hub_id, utc, utc // 250 AS domclk, 3 AS fmt, lc_mode, k % 5 AS trigger_mode, k % 2 AS atwd_chip,
        54 + k AS rec_len, (lc_mode << 16) | ((CASE k % 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 16 WHEN 4 THEN 4096 ELSE 0 END) << 18) AS word1, k
        FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS lc_mode FROM ev)""",
    "hits_disordered": "SELECT * REPLACE (CASE WHEN k % 10 = 0 THEN utc - 120 * 36000000000000 ELSE utc END AS utc) FROM hits",
    "hits_edge": """SELECT * REPLACE (CASE k WHEN 0 THEN 9223372036854775807 WHEN 1 THEN -1 ELSE utc END AS utc, CASE WHEN k = 2 THEN mbid + 100000 ELSE mbid END AS mbid,
        CASE WHEN k = 3 THEN 20 ELSE rec_len END AS rec_len) FROM hits""",
    "request_elements": """SELECT event_id AS uid, 0 AS elem, utc - 36000000000000 AS first_utc, utc + 36000000000000 AS last_utc, k % 6 AS readout_type, 12001 + user_id % 3 AS source_id, user_id AS dom_id
        FROM ev WHERE event_type = 'error'
        UNION ALL SELECT event_id, 1, utc + 72000000000000, utc + 108000000000000, 0, 12001 + user_id % 3, user_id FROM ev WHERE event_type = 'error' AND k % 4 = 0""",
    "runs": "SELECT 100 + i AS run_number, i * 120 * 36000000000000 AS start_utc, i * 120 * 36000000000000 + 110 * 36000000000000 AS stop_utc FROM range(6) AS r(i)",
    "tcal": """SELECT event_id AS seq, user_id AS mbid, user_id % 8 AS card, rn * 20000000 AS dor_tx, rn * 20000000 + 100000 + CASE WHEN k >= 95 THEN 4000 ELSE 0 END AS dor_rx,
        rn * 40000000 + 98000 AS dom_rx, rn * 40000000 + 102000 AS dom_tx, k % 50 AS fine_ticks, k = 50 AS bad, 0 AS gps_offset, k, utc FROM numbered""",
    "supernova": """SELECT event_id AS seq, user_id AS mbid, 1 + user_id % 3 AS hub_id, rn * 524288 + CASE WHEN k = 0 THEN 65536 ELSE 0 END AS domclk,
        [(k + i) % 16 FOR i IN range(8)] AS scalers FROM numbered""",
    "moni": """SELECT event_id AS seq, user_id AS mbid, 1 + user_id % 3 AS hub_id, utc, utc // 250 AS domclk, CASE k % 3 WHEN 0 THEN 200 WHEN 1 THEN 203 ELSE 7 END AS rec_type,
        CASE k % 10 WHEN 0 THEN 'LBM OVERFLOW ' || k WHEN 1 THEN 'Starting run' ELSE 'ok' END AS text, [1000 + k, 0, 600 + k, k, 2 * k, 3 * k, 4 * k, 5 * k] AS adc, [k + 10 * i FOR i IN range(16)] AS dac, 1500 + k AS hv_set, 1490 + k AS hv_read, 1 + k % 2 AS version, 5000 + k AS temp_adc, k AS spe, k // 2 AS mpe
        FROM ev WHERE event_type = 'click'""",
    "gps": """SELECT event_id AS seq, user_id % 8 AS card, dayofyear(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, CASE WHEN k < 80 THEN 32 ELSE 46 END AS quality,
        (us // 1000000) * 20000000 + 12345 + CASE WHEN k = 99 THEN 1 ELSE 0 END AS dorclk, 0 AS leap, k FROM ev WHERE event_type = 'signup'""",
    "ntp": """SELECT event_id AS seq, epoch_us(ts) // 1000 AS ntp_system_ms, value - 150 AS local_offset_ms, utc // 10 AS point_ns, k * 400000 AS exec_ns FROM ev WHERE event_type = 'click'""",
    "tcal_points": """SELECT event_id AS seq, user_id % 8 AS card, user_id AS cwd, utc // 500 AS point_dor, utc // 10 AS point_ns, k * 600000 AS exec_ns FROM ev WHERE event_type = 'purchase'""",
    "cycles": "SELECT conv_id AS id, turn AS cycle, length(text) AS size FROM conversations",
    "samples": "SELECT user_id AS key, event_id AS seq, value AS x FROM events",
}


def with_views(*names: str, recursive: bool = False, extra: str = "") -> str:
    """A WITH clause that defines the named DuckDB views and those that they need."""
    need, queue = set(), list(names)
    while queue:
        name = queue.pop()
        if name not in need:
            need.add(name)
            queue += [v for v in SQL if v != name and f"FROM {v}" in SQL[name]]
    parts = [f"{v} AS ({SQL[v]})" for v in SQL if v in need]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts + ([extra] if extra else [])) + " "
