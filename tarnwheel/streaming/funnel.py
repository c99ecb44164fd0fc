"""Funnels whose attempts expire, with state of their own per key.

What an event means depends on how far its key has come, so no built-in aggregate or join
says it. Events wait in state until the watermark has passed them and are then taken in the
order of their times, whatever batch they came in, so results do not depend on batches.
Timers take up waiting events and end attempts that nothing follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwheel.functions.times import from_micros, to_micros

OUTPUT = "started long, reached int, ended long, completed boolean"


class _Attempts(StatefulProcessor):
    def __init__(self, steps: Sequence[str], within: int, key: str, forget_ms: int | None):
        self.steps, self.within, self.key, self.forget_ms = list(steps), within, key, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, kind string", self.forget_ms)
        self.open = handle.getValueState("open", "reached int, started long, last long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [(row["at"], row["id"], row["kind"]) for row in rows]
        if found:
            self.waiting.appendList(found)
            self._wake(min(found)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # the same event twice counts once
        waiting = sorted({tuple(row) for row in self.waiting.get()}) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] < now], [x for x in waiting if x[0] >= now]
        reached, started, last = tuple(self.open.get()) if self.open.exists() else (0, None, None)
        out = []
        for at, _, kind in due:
            if reached and at > last + self.within:
                out.append((started, reached, last, False))
                reached = 0
            if kind == self.steps[reached]:
                started, reached, last = at if not reached else started, reached + 1, at
            if reached == len(self.steps):
                out.append((started, reached, last, True))
                reached = 0
        if reached and last + self.within < now:
            out.append((started, reached, last, False))
            reached = 0
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        elif self.waiting.exists():
            self.waiting.clear()
        if reached:
            self.open.update((reached, started, last))
            self._wake(last + self.within)
        elif self.open.exists():
            self.open.clear()
        names = (self.key, "started", "reached", "ended", "completed")
        return iter([Row(**dict(zip(names, (key[0], *row)))) for row in out])

    def _wake(self, at: int) -> None:
        """Call again once the watermark has passed ``at``."""
        self.handle.registerTimer(at // 1000 + 1)


def attempts(
    stream: DataFrame, steps: Sequence[str], within: int, delay: str, key: str = "user_id", event_time: str = "ts",
    event_id: str = "event_id", kind: str = "event_type", forget_ms: int | None = None,
) -> DataFrame:
    """Each key's attempts at a funnel: key, started, reached (steps), ended (last step) and completed.

    The first of ``steps`` starts an attempt if none is open. Each further step counts if it
    comes after the one before it, ``within`` microseconds later at most; until then all other
    events are passed over. An attempt comes out once it is completed or, by event time, has
    expired; open ones are not reported. Events of one time are taken by id.

    ``stream`` has ``event_time`` as a timestamp; rows later than ``delay`` are dropped. Rows
    with a null key or time are left out. State of a key is dropped after ``forget_ms`` of
    processing time without change, if that is given; it should be far above ``delay`` and
    ``within``. The events of a key are taken in by one task, as their order demands, so only
    those of the steps are sent there.
    """
    wanted: Column = F.col(kind).isin(*steps) & F.col(key).isNotNull() & F.col(event_time).isNotNull()
    rows = stream.where(wanted).withWatermark(event_time, delay).select(
        key, event_time, to_micros(event_time).alias("at"), F.col(event_id).cast("long").alias("id"), F.col(kind).alias("kind")
    )
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {OUTPUT}"
    found = rows.groupBy(key).transformWithState(_Attempts(steps, within, key, forget_ms), schema, "Append", "EventTime")
    return found.select(key, from_micros("started").alias("started"), "reached", from_micros("ended").alias("ended"), "completed")
