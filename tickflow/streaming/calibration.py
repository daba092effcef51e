"""Hits that wait for calibration, as a stateful processor: chains in value state, waiting hits in list state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ticks import DOM_TICKS
from ..operators.calibrate import SETTLED, WEIGHT, WILD, chain_step

#: Isochrons that are kept, records of a channel that may wait, hits of a block of list state.
HISTORY, DEFERRED, BLOCK = 20, 5000, 4096
#: Lanes that channels are spread over.
LANES = 64

OUT = "mbid bigint, seq bigint, utc bigint, kept boolean"
_CHAINS = (
    "mbid array<bigint>, seen array<bigint>, phase array<bigint>, last array<bigint>, has_last array<boolean>, end array<bigint>, has_end array<boolean>, "
    "average array<double>, stable array<bigint>, top array<bigint>, n array<bigint>, isochrons array<bigint>, epsilon array<double>"
)
_WAITING = "mbid array<bigint>, seq array<bigint>, clock array<bigint>"
_NEVER = -(1 << 63)


class Calibration(NamedTuple):
    """A calibration record, as ``chain_step`` reads it."""

    mbid: int
    seq: int
    t0: int
    t1: int
    t2: int
    t3: int
    bad: bool
    gps_offset: int


class Channel:
    """What is known of a channel: the chain's state, upper ends and offsets of isochrons, the greatest time put out."""

    __slots__ = ("chain", "epsilon", "isochrons", "seen", "top")

    def __init__(self, chain=(0, None, None, (None, 0)), isochrons=(), epsilon=(), top=_NEVER, seen=0):
        self.chain, self.isochrons, self.epsilon, self.top, self.seen = chain, list(isochrons), list(epsilon), top, seen


def _packed(channels: dict[int, Channel]) -> tuple:
    """A row of columns, one value or group of values for each channel."""
    blank, every = (0, 0, 0, 0), list(channels.values())
    last, end, average = ([c.chain[1] for c in every], [c.chain[2] for c in every], [c.chain[3] for c in every])
    flat = lambda rows: [x for r in rows for x in r]
    return (
        list(channels), [c.seen for c in every], [c.chain[0] for c in every], flat(x or blank for x in last), [x is not None for x in last], flat(x or blank for x in end), [x is not None for x in end],
        [float("nan") if a is None else a for a, _ in average], [s for _, s in average], [c.top for c in every], [len(c.epsilon) for c in every], flat(flat(c.isochrons) for c in every), flat(c.epsilon for c in every),
    )


def _unpacked(row: tuple) -> dict[int, Channel]:
    mbid, seen, phase, last, has_last, end, has_end, average, stable, top, n, isochrons, epsilon = row
    out, at = {}, 0
    for k, m in enumerate(mbid):
        four = slice(4 * k, 4 * k + 4)
        chain = phase[k], tuple(last[four]) if has_last[k] else None, tuple(end[four]) if has_end[k] else None, (None if average[k] != average[k] else average[k], stable[k])
        out[m] = Channel(chain, [tuple(isochrons[4 * j : 4 * j + 4]) for j in range(at, at + n[k])], epsilon[at : at + n[k]], top[k], seen[k])
        at += n[k]
    return out


def released(channel: Channel, new: list[tuple[int, tuple, float]], clock: np.ndarray, place: np.ndarray, limit: int, name: object) -> tuple[np.ndarray, np.ndarray]:
    """(utc, kept) of the waiting hits that can go; the others stay, in order.

    ``new`` has (place, isochron, epsilon) of the isochrons that this batch accepted; ``place`` is where in the
    batch a hit arrived, -1 if it waited before.  Hits go in order of arrival, each as soon as an isochron
    reaches its clock, by the oldest of the last HISTORY that do; steps back in time are not kept.
    """
    iso = np.array(channel.isochrons + [i for _, i, _ in new], np.int64).reshape(-1, 4)
    epsilon = np.array(channel.epsilon + [e for *_, e in new])
    accepted = np.array([-1] * len(channel.isochrons) + [p for p, *_ in new], np.int64)
    holder = np.searchsorted(iso[:, 0], clock)
    short = np.flatnonzero(holder == len(iso))
    n = int(short[0]) if len(short) else len(clock)
    going = np.maximum.accumulate(np.maximum(place[:n], accepted[holder[:n]])) if n else place[:0]
    arrived = np.flatnonzero(place >= 0)
    waiting = arrived + 1 - np.searchsorted(going, place[arrived], "right")
    if len(waiting) and waiting.max() > limit:
        raise ValueError(f"channel {name} waits for calibration with {waiting.max()} hits")
    by = np.maximum(holder[:n], np.searchsorted(accepted, going, "right") - HISTORY)
    dt = clock[:n] - iso[by, 2]
    utc = iso[by, 1] + dt + (epsilon[by] * dt).astype(np.int64) + iso[by, 3]
    before = np.maximum.accumulate(np.r_[channel.top, utc])[:-1]
    channel.isochrons, channel.epsilon = [tuple(r) for r in iso[-HISTORY:].tolist()], epsilon[-HISTORY:].tolist()
    channel.top = int(max(channel.top, utc.max())) if n else channel.top
    return utc, utc >= before


class Calibrator(StatefulProcessor):
    """Calibrates the channels of a lane.  State: one row of columns for their chains, blocks of waiting hits.

    With ``silent_ms``, a timer lets a channel go that the watermark has left behind by so much, with its waiting
    hits, which come out without a time.
    """

    def __init__(self, threshold: float, weight: float, settled: int, limit: int, silent_ms: int | None):
        self.rule, self.limit, self.silent_ms = (threshold, weight, settled), limit, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chains = handle.getValueState("chains", _CHAINS)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        channels, blocks = self._state()
        new = pd.concat(rows)
        c = {name: new[name].to_numpy() for name in ("mbid", "seq", "domclk", "t0", "t1", "t2", "t3", "gps_offset")}
        is_tcal, bad = (new.kind == "tcal").to_numpy(), new.bad.to_numpy(bool)
        order = np.lexsort((is_tcal, c["seq"], c["mbid"]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        accepted = self._chained(channels, c, bad, order[is_tcal[order]], place)
        hits = order[~is_tcal[order]]
        mbid = np.concatenate([*(b[0] for b in blocks), c["mbid"][hits]])
        seq = np.concatenate([*(b[1] for b in blocks), c["seq"][hits]])
        clock = np.concatenate([*(b[2] for b in blocks), c["domclk"][hits] * DOM_TICKS])
        place = np.concatenate([np.full(len(mbid) - len(hits), -1), place[hits]])
        by = np.argsort(mbid, kind="stable")
        mbid, seq, clock, place = mbid[by], seq[by], clock[by], place[by]
        cuts = np.flatnonzero(np.r_[True, mbid[1:] != mbid[:-1], True]) if len(mbid) else np.zeros(1, int)
        utc, kept, gone = np.zeros(len(mbid), np.int64), np.zeros(len(mbid), bool), np.zeros(len(mbid), bool)
        seen = (new.event_ts.astype("datetime64[ms]").astype("int64") if self.silent_ms else pd.Series(0, new.index)).groupby(new.mbid).max()
        for m, t in seen.items():
            channel = channels.setdefault(int(m), Channel())
            channel.seen = max(channel.seen, int(t))
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = int(mbid[start])
            times, ok = released(channels[m], accepted.pop(m, []), clock[start:end], place[start:end], self.limit, m)
            utc[start : start + len(times)], kept[start : start + len(times)] = times, ok
            gone[start : start + len(times)] = True
        for m, made in accepted.items():  # no hits wait
            released(channels[m], made, clock[:0], place[:0], self.limit, m)
        self._keep(channels, mbid, seq, clock, ~gone)
        yield pd.DataFrame({"mbid": mbid[gone], "seq": seq[gone], "utc": utc[gone], "kept": kept[gone]})

    def _state(self) -> tuple[dict[int, Channel], list[tuple]]:
        channels = _unpacked(self.chains.get()) if self.chains.exists() else {}
        return channels, [tuple(np.array(c, np.int64) for c in b) for b in self.waiting.get()]

    def _chained(self, channels: dict[int, Channel], c: dict, bad: np.ndarray, at: np.ndarray, place: np.ndarray) -> dict[int, list]:
        """The calibrations ``at`` these rows through the chains of their channels; what is accepted, by channel."""
        accepted: dict[int, list] = {}
        columns = (c["mbid"][at].tolist(), c["seq"][at].tolist(), *(c[t][at].tolist() for t in ("t0", "t1", "t2", "t3")), bad[at].tolist(), c["gps_offset"][at].tolist())
        for p, row in zip(place[at].tolist(), map(Calibration._make, zip(*columns, strict=True)), strict=True):
            channel = channels.setdefault(row.mbid, Channel())
            channel.chain, made = chain_step(channel.chain, row, *self.rule)
            if made[2] == "accepted":
                _, _, _, _, upper, dor_mid, dom_mid, epsilon, _, offset = made
                accepted.setdefault(row.mbid, []).append((p, (upper, dor_mid, dom_mid, offset), epsilon))
        return accepted

    def _keep(self, channels: dict[int, Channel], mbid: np.ndarray, seq: np.ndarray, clock: np.ndarray, left: np.ndarray) -> None:
        self.chains.update(_packed(channels)) if channels else self.chains.clear()
        stay = np.flatnonzero(left)
        blocks = [tuple(x[part].tolist() for x in (mbid, seq, clock)) for part in (stay[k : k + BLOCK] for k in range(0, len(stay), BLOCK))]
        self.waiting.put(blocks) if blocks else self.waiting.clear()
        if self.silent_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if channels:  # for the channel that is silent first
                self.handle.registerTimer(min(ch.seen for ch in channels.values()) + self.silent_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        channels, blocks = self._state()
        mbid, seq, clock = (np.concatenate([np.zeros(0, np.int64), *(b[k] for b in blocks)]) for k in range(3))
        silent = [m for m, ch in channels.items() if ch.seen + self.silent_ms <= now]
        for m in silent:
            del channels[m]
        given_up = np.isin(mbid, silent)
        self._keep(channels, mbid, seq, clock, ~given_up)
        yield pd.DataFrame({"mbid": mbid[given_up], "seq": seq[given_up], "utc": pd.array([None] * int(given_up.sum()), "Int64"), "kept": False})

    def close(self) -> None:
        pass


def calibrated_hits(
    records: DataFrame, threshold: float = WILD, weight: float = WEIGHT, settled: int = SETTLED, limit: int = DEFERRED, lanes: int = LANES, silent_ms: int | None = None
) -> DataFrame:
    """Hits in translated time: each waits until a calibration reaches its clock, then order is enforced.

    ``records`` is the union of hits (kind ``hit``, domclk) and calibrations (kind ``tcal``, t0..t3, bad,
    gps_offset) of all channels with mbid and seq.  A channel with more than ``limit`` waiting hits fails.
    Channels are spread over ``lanes``, the units of state: a batch reads and writes the state of a lane once,
    and releases the hits of a channel with array operations.  A cluster wants some lanes for each core.
    With ``silent_ms`` the records have ``event_ts`` with a watermark, and channels that it has left behind by that
    many milliseconds lose their state.  Needs the RocksDB state store (``rocksdb``).
    """
    lane = F.pmod(F.xxhash64("mbid"), F.lit(lanes)).alias("lane")
    return records.withColumn("lane", lane).groupBy("lane").transformWithStateInPandas(Calibrator(threshold, weight, settled, limit, silent_ms), OUT, "Append", "EventTime" if silent_ms else "None")
