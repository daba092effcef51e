"""Column functions on the fields of detector records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ticks import dom_ticks, dor_ticks

#: Record types with a hit: engineering (2), and compressed (3 and its trigger-side forms).
ENGINEERING, COMPRESSED = 2, 3
# Format codes of secondary records by those of the incoming ones.
SECONDARY = {102: 5, 202: 4, 302: 16}


def trigger_mode(word1: str) -> Column:
    """Trigger mode of a compressed hit; the first rule that holds counts."""
    bits = f"shiftright({word1}, 18)"
    return F.expr(f"case when {bits} & 4096 <> 0 then 4 when {bits} & 16 <> 0 then 3 when {bits} & 3 <> 0 then 2 when {bits} & 4 <> 0 then 1 else 0 end")


def lc_mode(word1: str) -> Column:
    return F.expr(f"shiftright({word1}, 16) & 3")


def engineering_modes(flag: str) -> dict[str, Column]:
    """Local coincidence, trigger and flasher modes of an engineering hit's trigger flag."""
    return {"lc_mode": F.expr(f"shiftright({flag}, 5) & 3"), "trigger_mode": F.expr(f"{flag} & 3"), "flasher": F.expr(f"shiftright({flag}, 2) & 1")}


def dispatched(records: DataFrame, fmt: str = "fmt") -> tuple[DataFrame, DataFrame]:
    """(records with ``reader``, rejects): which reader a hit record needs; other types are rejects."""
    reader = F.when(F.col(fmt) == ENGINEERING, "engineering").when(F.col(fmt) == COMPRESSED, "compressed")
    typed = records.withColumn("reader", reader)
    return typed.where("reader is not null"), typed.where("reader is null").drop("reader")


def thin_hit(hits: DataFrame) -> DataFrame:
    """What the trigger needs of a hit."""
    return hits.select("utc", "trigger_mode", F.lit(0).alias("config_id"), (F.col("hub_id") + 12000).alias("source_id"), F.col("mbid").alias("dom_id"))


def thinner_hit(hits: DataFrame, doms: DataFrame) -> DataFrame:
    """Thin hit with the channel number of the module; ``doms`` is a dimension of modules."""
    return hits.join(doms.select("mbid", "channel_id"), "mbid").select("utc", "trigger_mode", "channel_id")


def secondary_header(records: DataFrame, fmt: str = "fmt", rec_len: str = "rec_len") -> DataFrame:
    """Format codes of secondary records (-1 for unknown ones) and lengths without 8 bytes of padding."""
    codes = F.create_map(*[F.lit(x) for pair in SECONDARY.items() for x in pair])
    return records.withColumn("out_fmt", F.coalesce(F.try_element_at(codes, F.col(fmt)), F.lit(-1))).withColumn("out_len", F.col(rec_len) - 8)


def hardware(moni: DataFrame) -> DataFrame:
    """Readings of hardware monitor records: version, temperature, pressure, high voltage set and read back,
    the discriminator settings (DAC channels 9 and 8), all 8 ADC and 16 DAC channels, and the counters."""
    return moni.where("rec_type = 200").select(
        "seq", "mbid", "version", (F.col("temp_adc") / 256.0).alias("temperature"),
        ((F.col("adc")[2].cast("double") / F.col("adc")[0] + 0.095) / 0.009).alias("pressure"), "hv_set", "hv_read",
        F.col("dac")[9].alias("spe_level"), F.col("dac")[8].alias("mpe_level"), *[F.col("adc")[k].alias(f"adc{k}") for k in range(8)],
        *[F.col("dac")[k].alias(f"dac{k}") for k in range(16)], "spe", "mpe",
    )


def moni_kind(rec_type: str) -> Column:
    return F.expr(f"case {rec_type} when 203 then 'ascii' when 200 then 'hardware' else 'unknown' end")


def scaler_bins(packets: DataFrame, width: int = 1 << 16) -> DataFrame:
    """One row for each scaler of a supernova packet; bin i starts i times ``width`` counts after the packet."""
    return packets.select("hub_id", "mbid", "seq", "domclk", F.posexplode("scalers").alias("bin", "scaler")).select(
        "hub_id", "mbid", "seq", "bin", (F.col("domclk") + F.col("bin").cast("long") * width).alias("binclk"), "scaler"
    )


# --- fine time of calibration waveforms -----------------------------------------------------------------

METHODS = ("zero_crossing", "leading_edge", "quadratic", "constant_fraction")


def fine_correction(wf: str, method: str = "zero_crossing", threshold: float | None = None) -> Column:
    """Seconds from the fixed sample to the edge of a 64-sample waveform; null if no edge is found.

    The baseline is the mean of the first 20 samples.  Unknown methods are taken as zero crossing.
    """
    at = lambda i: f"({wf}[{i}] - base)"
    if method == "leading_edge":
        t = 100.0 if threshold is None else threshold
        pick, where = f"filter(sequence(10, 46), i -> {at('i')} < {t} and {at('i + 1')} >= {t})", f"i + ({t} - {at('i')}) / ({at('i + 1')} - {at('i')}) - 48D"
    elif method == "quadratic":
        t = 100.0 if threshold is None else threshold
        pick = f"filter(sequence(20, 46), i -> {at('i')} < {t} and {at('i + 1')} >= {t})"
        a, b, c = at("i"), at("i + 1"), at("i + 2")
        qa, qb = f"(0.5D * ({c} + {a} - 2 * {b}))", f"({b} - {a} - 0.5D * ({c} + {a} - 2 * {b}))"
        root = f"sqrt({qb} * {qb} - 4 * {qa} * ({a} - {t}))"
        low, high = f"(-({qb} + {root}) / (2 * {qa}))", f"(-({qb} - {root}) / (2 * {qa}))"
        where = f"i + case when {qa} = 0 then ({t} - {a}) / {qb} when {low} between 0 and 1 then {low} else {high} end - 48D"
    elif method == "constant_fraction":
        f = 0.5 if threshold is None else threshold
        top = f"array_max(transform(slice({wf}, 21, 20), x -> greatest(x - base, 0D)))"
        level = lambda i: f"try_divide({at(i)}, {top})"
        pick = f"filter(sequence(21, 39), i -> {level('i - 1')} <= {f} and {level('i')} > {f})"
        where = f"i - 48D + ({f} - {level('i - 1')}) / ({level('i')} - {level('i - 1')})"
    else:
        t = 0.0 if threshold is None else threshold
        pick, where = f"filter(sequence(46, 31, -1), i -> {at('i')} > {t} and {at('i + 1')} <= {t})", f"i + ({t} - {at('i')}) / ({at('i + 1')} - {at('i')}) - 48D"
    base = f"aggregate(slice({wf}, 1, 20), 0D, (s, x) -> s + x) / 20D"
    body = f"transform(array({base}), base -> transform(transform(array({pick}), f -> try_element_at(f, 1)), i -> case when i is not null then 50e-9D * ({where}) end)[0])[0]"
    return F.expr(body)


def corrected_stamps(tcal: DataFrame, dor_seconds: str, dom_seconds: str) -> DataFrame:
    """Ticks of the four stamps of a calibration: t0 sent, t1 received and t2 sent by the module, t3 received.

    Only stamps of receiving get a fine correction, cut to whole ticks; without one the record is bad.
    """
    fine = lambda c: F.expr(f"cast(1e10D * {c} as bigint)")
    return (
        tcal.withColumn("t0", dor_ticks("dor_tx"))
        .withColumn("t1", dom_ticks("dom_rx") + fine(dom_seconds))
        .withColumn("t2", dom_ticks("dom_tx"))
        .withColumn("t3", dor_ticks("dor_rx") + fine(dor_seconds))
        .withColumn("bad", F.expr(f"{dor_seconds} is null or {dom_seconds} is null"))
    )
