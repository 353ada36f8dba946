"""Debouncing with per-path state and timers: a path is reported when its timer runs out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed
from .debounce import KEY

_PERIOD = "first_us long, last_us long, last_id long, event_type string, events long"
_FIELDS = [f.split()[0] for f in _PERIOD.split(", ")]
_OUT = f"repo string, path string, {_PERIOD}"


def joined_periods(periods: list[tuple], gap_us: int) -> list[tuple]:
    """Periods (first_us, last_us, last_id, event_type, events) of one path in order, those less
    than the gap apart joined. The type is that of the last event."""
    out: list[tuple] = []
    for p in sorted(periods):
        if out and p[0] - out[-1][1] < gap_us:
            q = out[-1]
            last = max(q[1:4], p[1:4], key=lambda x: x[:2])
            out[-1] = (q[0], *last, q[4] + p[4])
        else:
            out.append(tuple(p))
    return out


class _Quiet(StatefulProcessor):
    """Open periods of one path. On event time a period is closed by the watermark, so results
    do not depend on how events fall into micro-batches; its timer stands at its last event
    plus the gap. On processing time all that is pending is one period, and every arrival
    sets the timer anew."""

    def __init__(self, gap_us: int, by_event_time: bool):
        self.gap_us, self.by_event_time = gap_us, by_event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("periods", _PERIOD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [tuple(p) for p in self.open.get()]
        news = [tuple(r[c] for c in _FIELDS) for r in rows]
        if self.by_event_time:
            yield from self._close(key, joined_periods(known + news, self.gap_us), timerValues.getCurrentWatermarkInMs())
        else:
            pending = joined_periods(known + news, 1 << 62)
            self.open.put(pending)
            self._set(timerValues.getCurrentProcessingTimeInMs() + -(-self.gap_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = [tuple(p) for p in self.open.get()]
        yield from self._close(key, known, timerValues.getCurrentWatermarkInMs() if self.by_event_time else None)

    def _close(self, key, periods: list[tuple], watermark_ms: int | None) -> Iterator[Row]:
        """Report the periods that no event can join any more, and keep the others."""
        done = [p for p in periods if watermark_ms is None or p[1] + self.gap_us <= 1000 * watermark_ms]
        left = periods[len(done) :]  # in order of time, so these are the later ones
        if left:
            self.open.put(left)
            self._set(-(-(left[0][1] + self.gap_us) // 1000))
        else:
            self.open.clear()
        for p in done:
            yield Row(repo=key[0], path=key[1], **dict(zip(_FIELDS, p)))

    def _set(self, at_ms: int) -> None:
        for other in list(self.handle.listTimers()):
            if other != at_ms:
                self.handle.deleteTimer(other)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


def folded(events: DataFrame, gap_us: int) -> DataFrame:
    """(repo, path, ts, first_us, last_us, last_id, event_type, events): events of a path that
    lie less than the gap apart in one Arrow batch as one period, ``ts`` its last event. So
    what a hot path sends through the shuffle follows its periods, not its events."""
    ident = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    rows = events.select(*KEY, F.unix_micros("ts").alias("us"), ident.cast("long").alias("id"), "event_type")
    names = [*KEY, "first_us", "last_us", "last_id", "event_type", "events"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("repo", "ascending"), ("path", "ascending"), ("us", "ascending"), ("id", "ascending")])
            if not table.num_rows:
                continue
            codes = [table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in KEY]
            us = table.column("us").to_numpy()
            new = np.ones(len(us), bool)
            new[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]) | (us[1:] - us[:-1] >= gap_us)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(us)) - 1
            pick = table.take(pa.array(last))
            columns = [*(pick.column(c) for c in KEY), pa.array(us[first]), pa.array(us[last]), pick.column("id"), pick.column("event_type"), pa.array(last - first + 1)]
            yield from pa.table(dict(zip(names, columns))).combine_chunks().to_batches()

    out = rows.mapInArrow(fold, f"repo string, path string, {_PERIOD}")
    return out.withColumn("ts", F.timestamp_micros("last_us"))


def debounce_timers(
    events: DataFrame, gap_seconds: float = fixed.DEBOUNCE_SECONDS, *, watermark: str = "1 minute", time: str = "event"
) -> DataFrame:
    """One row per quiet period of a path on a stream: (repo, path, event_type, events,
    first_ts, last_ts), reported when the path has been quiet for the gap. Events exactly the
    gap apart are two periods, as a timer that has run out has fired.

    ``time="event"`` goes by the events' own time: periods close as the watermark passes
    them, in whatever order and micro-batches events come. ``time="processing"`` goes by the
    clock: everything that arrives for a path before its timer runs out is one period. State
    is a path's open periods, of which the watermark's delay bounds the number, and goes with
    the last of them; it lies in RocksDB and in the checkpoint, so pending paths outlive a
    restart. In a session without ``session.SETTINGS`` start the stream inside
    ``session.state_on_disk``. Events later than the watermark are dropped, see
    :func:`debounce.record_late`.
    """
    if time not in ("event", "processing"):
        raise ValueError(f"unknown time {time!r}")
    gap_us, by_event = round(gap_seconds * 1_000_000), time == "event"
    rows = folded(events, gap_us)
    if by_event:
        rows = rows.withWatermark("ts", watermark)
    quiet = rows.groupBy(*KEY).transformWithState(
        _Quiet(gap_us, by_event), _OUT, "Append", "EventTime" if by_event else "ProcessingTime"
    )
    stamped = [F.timestamp_micros(f"{end}_us").alias(f"{end}_ts") for end in ("first", "last")]
    return quiet.select(*KEY, "event_type", "events", *stamped)
