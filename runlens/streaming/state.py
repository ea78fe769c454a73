"""State carried per run or per (run, rule) between micro-batches.

Rows of a key arrive in any order, within a micro-batch and between them. They wait in state until the watermark has passed
them, when none can come before them any more (Spark drops those that try), and are then handled by their time. So a stream
says what its batch twin says, for all rows within the allowed lateness.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.incidents import LiveLimits


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


_L, _D, _S, _I, _B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()

ALERT = _schema(run_id=_S, ts_us=_L, rule_id=_S, severity=_S, title=_S)
INCIDENT_UPDATE = _schema(incident_id=_S, run_id=_S, rule_id=_S, severity=_S, title=_S, first_us=_L, last_us=_L, count=_L, is_new=_B)
HOT_UPDATE = _schema(**{f.name: f.dataType for f in INCIDENT_UPDATE}, hot=_S)
RING_ROW = _schema(run_id=_S, ts_us=_L, cpu_pct=_D, rss_mb=_D, open_fds=_I)
ENDED = _schema(run_id=_S, ended_us=_L)

#: A key without a row for this long, in event time, has ended and its state goes.
KEEP_US = 24 * 3_600_000_000


def _missing(v) -> bool:
    return v is None or v != v


def _plain(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as the plain values that state takes."""
    kinds = {_L: int, _D: float, _I: int, _S: str}
    cols = [[None if _missing(v) else kinds[f.dataType](v) for v in rows[f.name]] for f in schema]
    return list(zip(*cols))


def _timer_ms(us: int) -> int:
    return us // 1000 + 1


class InOrder(StatefulProcessor):
    """Hands a key's rows to `step` by time, once the watermark has passed them.

    What waits of a key is what came within the allowed lateness. A key has one timer: for its earliest waiting row or, if none
    waits, for the end of `keep_us` of silence, when all of its state is cleared.
    """

    ROW: T.StructType
    STATE: T.StructType
    OUT: T.StructType
    START: tuple

    def __init__(self, keep_us: int = KEEP_US):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getListState("waiting", self.ROW)
        self.clock = handle.getValueState("clock", _schema(timer_ms=_L, waits=_B, last_us=_L))

    def step(self, key: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """(new state, output rows) of rows in the order of their time."""
        raise TypeError("a subclass says what a row does")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, waits, last = self.clock.get() or (None, False, None)
        first = None
        for batch in rows:
            batch = batch[batch["ts_us"].notna()]
            if len(batch):
                self.waiting.appendList(_plain(batch, self.ROW))
                low, high = int(batch["ts_us"].min()), int(batch["ts_us"].max())
                first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        if first is not None:
            at = min(timer, _timer_ms(first)) if waits else _timer_ms(first)
            if at != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
            self.clock.update((at, True, last))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.clock.get()[2]
        rows = sorted(self.waiting.get(), key=lambda r: r[0])
        due = [tuple(r) for r in rows if r[0] <= mark]
        rest = [tuple(r) for r in rows[len(due):]]
        out: list[tuple] = []
        if due:
            new, out = self.step(key, self.state.get() or self.START, due)
            self.state.update(new)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if rest or last + self.keep_us > mark:
            at = _timer_ms(rest[0][0] if rest else last + self.keep_us)
            self.handle.registerTimer(at)
            self.clock.update((at, bool(rest), last))
        else:
            self.state.clear()
            self.clock.clear()
        if out:
            yield pd.DataFrame(out, columns=self.OUT.names)

    def close(self) -> None:
        pass


class Latch:
    """Fires once, then stays silent until `rearm` quiet samples came in a row."""

    def __init__(self, fired: bool, quiet: int, rearm: int):
        self.fired, self.quiet, self.rearm = fired, quiet, rearm

    def fire(self) -> bool:
        first, self.fired = not self.fired, True
        return first

    def see(self, active: bool) -> None:
        self.quiet = 0 if active else self.quiet + 1
        if self.quiet >= self.rearm:
            self.fired, self.quiet = False, 0


class LiveAlerts(InOrder):
    """Descriptor, memory and CPU thresholds with hysteresis, per run."""

    ROW = _schema(ts_us=_L, cpu_pct=_D, rss_mb=_D, open_fds=_D)
    STATE = _schema(last_rss=_D, streak=_I, fd_fired=_B, fd_quiet=_I, cpu_fired=_B, cpu_quiet=_I)
    OUT, START = ALERT, (None, 0, False, 0, False, 0)

    def __init__(self, limits: LiveLimits = LiveLimits(), keep_us: int = KEEP_US):
        super().__init__(keep_us)
        self.limits = limits

    def step(self, key: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        lim, out = self.limits, []
        last, streak, ff, fq, cf, cq = state
        fd, cpu = Latch(ff, fq, lim.rearm), Latch(cf, cq, lim.rearm)
        for ts, cpu_pct, rss_mb, open_fds in rows:
            if not _missing(open_fds):
                over = open_fds > lim.fds
                if over and fd.fire():
                    out.append((key[0], ts, "fd_leak_live", "high", "Too many open descriptors"))
                fd.see(over)
            if not _missing(rss_mb):
                if not _missing(last) and rss_mb - last > lim.rss_step_mb:
                    out.append((key[0], ts, "mem_spike", "medium", "Memory jumped"))
                last = rss_mb
            if not _missing(cpu_pct):
                hot = cpu_pct > lim.cpu_pct
                streak = streak + 1 if hot else 0
                if streak == lim.cpu_streak and cpu.fire():
                    out.append((key[0], ts, "cpu_hot_live", "medium", "CPU pegged"))
                cpu.see(hot)
        return (last, streak, fd.fired, fd.quiet, cpu.fired, cpu.quiet), out


class IncidentCollapse(InOrder):
    """T4: one incident per run and rule; repeats count up and are published again at most every ten seconds."""

    ROW = _schema(ts_us=_L, severity=_S, title=_S)
    STATE = _schema(first_us=_L, last_us=_L, count=_L, last_pub=_L, severity=_S, title=_S)
    OUT, START = INCIDENT_UPDATE, ()

    def __init__(self, limits: LiveLimits = LiveLimits(), keep_us: int = KEEP_US):
        super().__init__(keep_us)
        self.limits = limits

    def step(self, key: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        (run, rule), now, out = key, state, []
        for ts, severity, title in rows:
            if not now:
                now = (ts, ts, 1, ts, severity, title)
                out.append((f"{run}:{rule}", run, rule, severity, title, ts, ts, 1, True))
                continue
            first, _, n, pub, sev, title = now
            due = ts - pub >= self.limits.publish_every_us
            now = (first, ts, n + 1, ts if due else pub, sev, title)
            if due:
                out.append((f"{run}:{rule}", run, rule, sev, title, first, ts, n + 1, False))
        return tuple(now), out


class HotIncidents(InOrder):
    """T4 with its back-fill: alerts and profile snapshots of a run in one state. An incident takes the snapshot that stands when
    it begins; one that begins before any waits, and comes out again with the next snapshot. A snapshot goes before an alert of
    the same time. State holds the latest snapshot and one entry for each rule that fired."""

    ROW = _schema(ts_us=_L, rule_id=_S, severity=_S, title=_S, hot=_S)
    STATE = _schema(hot=_S, incidents=_S)
    OUT, START = HOT_UPDATE, (None, "{}")

    def __init__(self, limits: LiveLimits = LiveLimits(), keep_us: int = KEEP_US):
        super().__init__(keep_us)
        self.limits = limits

    def step(self, key: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        run, (hot, known), out = key[0], state, []
        incidents = json.loads(known)

        def tell(rule: str, new: bool, context: str | None) -> None:
            i = incidents[rule]
            out.append((f"{run}:{rule}", run, rule, i["severity"], i["title"], i["first"], i["last"], i["count"], new, context))

        for ts, rule, severity, title, shot in sorted(rows, key=lambda r: (r[0], r[4] is None)):
            if shot is not None:
                hot = shot
                for waiting in [r for r, i in incidents.items() if not i["hot"]]:
                    incidents[waiting]["hot"] = True
                    tell(waiting, False, hot)
            elif rule not in incidents:
                incidents[rule] = {"first": ts, "last": ts, "count": 1, "told": ts, "severity": severity, "title": title, "hot": hot is not None}
                tell(rule, True, hot)
            else:
                i = incidents[rule]
                i["last"], i["count"] = ts, i["count"] + 1
                if ts - i["told"] >= self.limits.publish_every_us:
                    i["told"] = ts
                    tell(rule, False, None)
        return (hot, json.dumps(incidents)), out


class Liveness(InOrder):
    """A run that was alive and then shows no process for `empties` ticks in a row has ended."""

    ROW = _schema(ts_us=_L, rss_mb=_D)
    STATE = _schema(alive=_B, empty=_I, done=_B)
    OUT, START = ENDED, (False, 0, False)

    def __init__(self, empties: int = 12, keep_us: int = KEEP_US):
        super().__init__(keep_us)
        self.empties = empties

    def step(self, key: tuple, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        alive, empty, done = state
        out = []
        for ts, rss_mb in rows:
            if done:
                break
            if not _missing(rss_mb):
                alive, empty = True, 0
            elif alive:
                empty += 1
                if empty == self.empties:
                    done = True
                    out.append((key[0], ts))
        return (alive, empty, done), out


class Ring(StatefulProcessor):
    """The newest samples of each run, emitted after every batch; a run silent for `keep_us` is forgotten."""

    def __init__(self, size: int = 2400, keep_us: int = KEEP_US):
        self.size, self.keep_us = size, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = _schema(ts_us=_L, cpu_pct=_D, rss_mb=_D, open_fds=_I)
        self.ring = handle.getListState("ring", self.rows)
        self.timer = handle.getValueState("timer", _schema(timer_ms=_L))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cols = self.rows.names
        kept = pd.DataFrame(list(self.ring.get()), columns=cols)
        for batch in rows:  # cut after every Arrow batch, so no more than a ring and a batch is held
            kept = pd.concat([kept, batch[cols]] if len(kept) else [batch[cols]]).sort_values("ts_us", kind="stable").tail(self.size)
        self.ring.put(_plain(kept, self.rows))
        old, at = self.timer.get(), _timer_ms(int(kept["ts_us"].max()) + self.keep_us)
        if old is None or old[0] != at:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))
        out = kept.copy()
        out["open_fds"] = out["open_fds"].astype("Int32")
        out.insert(0, "run_id", key[0])
        yield out[RING_ROW.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        self.timer.clear()
        yield from ()

    def close(self) -> None:
        pass
