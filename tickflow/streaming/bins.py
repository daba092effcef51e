"""Counts by bin that close by rules of their own: when a run ends, or when every channel of a hub has gone on."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import EOS

#: Lanes that the modules of a run are spread over.
LANES = 64
_NEVER = -(1 << 63)


def _added(counts: dict[tuple[int, int], int], mbid: np.ndarray, bins: np.ndarray) -> None:
    if len(mbid):
        pairs, n = np.unique(np.c_[mbid, bins], axis=0, return_counts=True)
        for (m, b), k in zip(pairs.tolist(), n.tolist(), strict=True):
            counts[m, b] = counts.get((m, b), 0) + k


# --- runs ---------------------------------------------------------------------------------------------------


class RunBins(StatefulProcessor):
    """Bins of the modules of a run and lane.  State: one row of columns, gone when the watermark has passed the run."""

    def __init__(self, width: int, silent_ms: int):
        self.width, self.silent_ms = width, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bins", "module array<bigint>, done array<bigint>, mbid array<bigint>, bin array<bigint>, n array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        module, done, *open_ = self.state.get() if self.state.exists() else ([], [], [], [], [])
        done = dict(zip(module, done, strict=True))
        counts = {(m, b): n for m, b, n in zip(*open_, strict=True)}
        new = pd.concat(rows)
        ends = new.ends.to_numpy(bool)
        mbid, bins = new.mbid.to_numpy(), new.utc.to_numpy() // self.width * self.width
        passed = np.array([done.get(m, _NEVER) for m in mbid.tolist()], np.int64)
        late = ~ends & (bins <= passed)
        taken = ~ends & ~late
        _added(counts, mbid[taken], bins[taken])
        out = []
        rejected: dict[tuple[int, int], int] = {}
        _added(rejected, mbid[late], bins[late])
        out += [(key[0], b, m, n, True) for (m, b), n in sorted(rejected.items())]
        newest: dict[int, int] = {}
        for m, b in counts:
            newest[m] = max(b, newest.get(m, b))
        over = set(mbid[ends].tolist())
        for m, b in sorted(counts):
            if m in over or b < newest[m]:
                out.append((key[0], b, m, counts.pop((m, b)), False))
                done[m] = max(b, done.get(m, _NEVER))
        done |= dict.fromkeys(over, EOS)
        self.state.update((list(done), list(done.values()), [m for m, _ in counts], [b for _, b in counts], list(counts.values())))
        # what is late until the timer is rejected by the state, later than that by the watermark
        whole = not counts and all(d == EOS for d in done.values())
        before = list(self.handle.listTimers())
        for t in before:
            self.handle.deleteTimer(t)
        last = int(new.event_ts.max().timestamp() * 1000)
        self.handle.registerTimer(last + 1 if whole else max([last + self.silent_ms, *before]))
        yield pd.DataFrame(out, columns=["run_number", "bin", "mbid", "n", "late"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        *_, mbid, bins, n = self.state.get() if self.state.exists() else ([], [], [])
        self.state.clear()
        # modules whose end never came
        yield pd.DataFrame([(key[0], b, m, k, False) for m, b, k in zip(mbid, bins, n, strict=True)], columns=["run_number", "bin", "mbid", "n", "late"])

    def close(self) -> None:
        pass


def run_bins(events: DataFrame, width: int, lanes: int = LANES, silent_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Counts by bin of each run and module: a bin comes out when a later one of the module begins, the rest when the run ends.

    ``events`` has run_number, mbid, utc, ``event_ts`` with a watermark, and ``ends``, true for the event that
    ends the run for the module.  Rows are (run_number, bin, mbid, n, late): events of bins that came out before
    are rejected and come out as ``late``.  When the watermark passes the end of a run nothing of it is left in
    state; still later events are dropped by the watermark.  Modules whose end never comes are put out when the
    watermark has left them behind by ``silent_ms``.  Needs the RocksDB state store.
    """
    lane = F.pmod(F.xxhash64("mbid"), F.lit(lanes)).cast("int").alias("lane")
    keyed = events.withColumn("lane", lane).groupBy("run_number", "lane")
    return keyed.transformWithStateInPandas(RunBins(width, silent_ms), "run_number int, bin bigint, mbid bigint, n bigint, late boolean", "Append", "EventTime")


# --- hubs ---------------------------------------------------------------------------------------------------


class HubBins:
    """Open bins of a hub's channels: ``add`` and ``end`` give reports (first, last, mbid, n)."""

    def __init__(self, width: int):
        self.width, self.closed = width, _NEVER
        self.counts: dict[tuple[int, int], int] = {}
        self.start: dict[tuple[int, int], int] = {}  # first bins of channels begin with their first event
        self.newest: dict[int, int] = {}
        self.latest: dict[int, int] = {}

    def add(self, mbid: np.ndarray, utc: np.ndarray) -> tuple[list[tuple], list[tuple]]:
        """(reports, rejected) of events in order of arrival."""
        bins, reports, rejected = utc // self.width * self.width, [], []
        front = max(self.newest.values(), default=_NEVER)
        top = np.maximum.accumulate(np.r_[front, bins])
        steps = np.flatnonzero(top[1:] > top[:-1])
        cuts = np.unique(np.r_[0, steps, len(utc)])
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if top[begin + 1] > top[begin]:
                # no channel has reached this bin: what lies behind the channels' newest bins is whole
                reports += self._report([(m, b) for m, b in self.counts if b < self.newest[m]])
            m, t, b = mbid[begin:end], utc[begin:end], bins[begin:end]
            ok = t > self.closed
            if not ok.all():
                late, n = np.unique(m[~ok], return_counts=True)
                rejected += [(self.closed, x, k) for x, k in zip(late.tolist(), n.tolist(), strict=True)]
                m, t, b = m[ok], t[ok], b[ok]
            for x, at in zip(*(a.tolist() for a in np.unique(m, return_index=True)), strict=True):
                if x not in self.newest:
                    self.start[x, int(b[at])] = int(t[at])
            _added(self.counts, m, b)
            for x, at in zip(*(a.tolist() for a in np.unique(m[::-1], return_index=True)), strict=True):
                self.latest[x] = int(t[len(m) - 1 - at])
            for x, y in set(zip(m.tolist(), b.tolist(), strict=True)):
                self.newest[x] = max(y, self.newest.get(x, y))
        return reports, rejected

    def _report(self, behind: list[tuple[int, int]], last: int | None = None) -> list[tuple]:
        if not behind:
            return []
        first = min(self.start.get(k, k[1]) for k in behind)
        last = max(b for _, b in behind) + self.width - 1 if last is None else last
        out = [(first, last, m, self.counts.pop((m, b))) for m, b in sorted(self.counts) if b <= last and b + self.width > first]
        self.start = {k: v for k, v in self.start.items() if k in self.counts}
        self.closed = last
        return out

    def end(self) -> list[tuple]:
        """The bins behind the newest ones, then what is left, up to the last event."""
        out = self._report([(m, b) for m, b in self.counts if b < self.newest[m]])
        return out + self._report(list(self.counts), max((self.latest[m] for m, _ in self.counts), default=None))

    def packed(self) -> tuple:
        m = list(self.newest)
        k = list(self.counts)
        return (self.closed, m, [self.newest[x] for x in m], [self.latest[x] for x in m], [x for x, _ in k], [b for _, b in k], list(self.counts.values()), [self.start.get(x, x[1]) for x in k])

    @classmethod
    def unpacked(cls, width: int, row: tuple) -> HubBins:
        hub = cls(width)
        hub.closed, m, newest, latest, mbid, bins, n, start = row
        hub.newest, hub.latest = dict(zip(m, newest, strict=True)), dict(zip(m, latest, strict=True))
        keys = list(zip(mbid, bins, strict=True))
        hub.counts = dict(zip(keys, n, strict=True))
        hub.start = {k: s for k, s in zip(keys, start, strict=True) if s != k[1]}
        return hub


class HubClosing(StatefulProcessor):
    """Bins of one hub; a timer ends a hub that the watermark has left behind by ``silent_ms``."""

    def __init__(self, width: int, silent_ms: int):
        self.width, self.silent_ms = width, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hub", "closed bigint, channel array<bigint>, newest array<bigint>, latest array<bigint>, mbid array<bigint>, bin array<bigint>, n array<bigint>, start array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        hub = HubBins.unpacked(self.width, self.state.get()) if self.state.exists() else HubBins(self.width)
        new = pd.concat(rows).sort_values("seq", kind="stable")
        mbid, utc, ends = new.mbid.to_numpy(), new.utc.to_numpy(), np.flatnonzero(new.ends.to_numpy(bool))
        out, begin = [], 0
        for end in [*ends.tolist(), len(new)]:
            reports, rejected = hub.add(mbid[begin:end], utc[begin:end])
            out += [(key[0], *r, False) for r in reports] + [(key[0], None, *r, True) for r in rejected]
            if end < len(new):
                out += [(key[0], *r, False) for r in hub.end()]
                hub = HubBins(self.width)
            begin = end + 1
        timers_ = list(self.handle.listTimers())
        for t in timers_:
            self.handle.deleteTimer(t)
        if hub.counts or hub.closed != _NEVER:
            self.state.update(hub.packed())
            self.handle.registerTimer(max([int(new.event_ts.max().timestamp() * 1000) + self.silent_ms, *timers_]))
        else:
            self.state.clear()
        yield _reports(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = HubBins.unpacked(self.width, self.state.get()).end() if self.state.exists() else []
        self.state.clear()
        yield _reports([(key[0], *r, False) for r in out])

    def close(self) -> None:
        pass


def _reports(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["hub_id", "first_utc", "last_utc", "mbid", "n", "rejected"])
    return found.astype({"first_utc": "Int64", "last_utc": "Int64"})


def hub_bins(events: DataFrame, width: int, silent_ms: int = 3600 * 1000) -> DataFrame:
    """Counts of each hub and channel by bin of ``utc``, closed by the progress of the hub's own channels.

    ``events`` has hub_id, mbid, seq, utc, ``event_ts`` with a watermark and ``ends``, true for an event that ends the hub's run.  When an event
    comes that lies in a bin which no channel of the hub has reached, the bins behind the channels' newest ones
    go out together: rows (hub_id, first_utc, last_utc, mbid, n, rejected), last_utc included.  So neither a
    silent nor a lagging channel holds a bin back by more than that, and other hubs don't matter.  Events up to
    the end of the last report are rejected: they come out as counts with ``rejected`` and first_utc null.  The
    end of a run lets out all that is left, up to the last event, as does a timer for a hub that is silent.
    The first bin of a channel begins with its first event.  Needs the RocksDB state store.
    """
    out = "hub_id int, first_utc bigint, last_utc bigint, mbid bigint, n bigint, rejected boolean"
    return events.groupBy("hub_id").transformWithStateInPandas(HubClosing(width, silent_ms), out, "Append", "EventTime")
