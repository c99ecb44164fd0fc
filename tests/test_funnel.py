"""Funnel attempts over several batches, out of order and across a restart, against the batch answer."""

import datetime as dt
import random

import pytest

from tarnwheel.functions.times import HOUR
from tarnwheel.sources.tables import stream_table
from tarnwheel.streaming.funnel import attempts
from tarnwheel.streaming.runs import append_to

START = dt.datetime(2024, 5, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
STEPS = ("signup", "view", "purchase")


def at(minute):
    return START + dt.timedelta(minutes=minute)


def brute(events, within=dt.timedelta(hours=1), delay=dt.timedelta(minutes=30)):
    """All events at once, in order; what the final watermark has not passed stays open."""
    end = max(e[1] for e in events) - delay
    out, users = [], {e[2] for e in events if e[2] is not None}
    for user in users:
        reached, started, last = 0, None, None
        for _, ts, _, kind in sorted({(e[0], e[1], e[2], e[3]) for e in events if e[2] == user}, key=lambda e: (e[1], e[0])):
            if ts >= end or kind not in STEPS:
                continue
            if reached and ts > last + within:
                out.append((user, started, reached, last, False))
                reached = 0
            if kind == STEPS[reached]:
                started, last, reached = (ts if not reached else started), ts, reached + 1
            if reached == 3:
                out.append((user, started, 3, last, True))
                reached = 0
        if reached and last + within < end:
            out.append((user, started, reached, last, False))
    return sorted(out)


def run(spark, folder, files_per_batch=1):
    events = stream_table(spark, folder, "events", "ts", files_per_batch=files_per_batch)
    found = attempts(events, STEPS, HOUR, "30 minutes")
    append_to(found, f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    return sorted(tuple(r) for r in rows)


def write(spark, folder, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_steps_expire_complete_and_start_again(spark, tmp_path):
    events = [
        (1, at(0), 1, "signup"), (2, at(60), 1, "view"), (3, at(61), 1, "purchase"),  # exactly an hour later still counts
        (4, at(0), 2, "signup"), (5, at(61), 2, "view"), (6, at(62), 2, "signup"), (7, at(63), 2, "view"),  # a minute too late
        (8, at(0), 3, "view"), (9, at(1), 3, "purchase"), (10, at(2), 3, "signup"),  # nothing before the first step counts
        (11, at(5), 4, "signup"), (12, at(5), 4, "view"), (13, at(5), 4, "click"), (14, at(6), 4, "purchase"), (15, at(7), 4, "signup"),
        (16, at(0), None, "signup"), (17, at(1000), 9, "click"), (18, at(1001), 5, "view"),
    ]
    write(spark, tmp_path, events)
    got = run(spark, str(tmp_path))
    assert got == brute(events) == [
        (1, at(0), 3, at(61), True), (2, at(0), 1, at(0), False), (2, at(62), 2, at(63), False),
        (3, at(2), 1, at(2), False), (4, at(5), 3, at(6), True), (4, at(7), 1, at(7), False),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(i, at(3 * i + rng.randrange(20)), rng.randrange(6), rng.choice([*STEPS, "click"])) for i in range(240)]
    events += events[100:110]
    # each batch overlaps the next one in time, within the delay
    parts = [events[:70], events[70:140], events[140:]]
    for part in parts[:2]:
        write(spark, tmp_path, part)
    run(spark, str(tmp_path))
    write(spark, tmp_path, parts[2])
    got = run(spark, str(tmp_path))
    assert got == brute(events) and {r[4] for r in got} == {True, False}


def test_no_events(spark, tmp_path):
    write(spark, tmp_path, [])
    assert run(spark, str(tmp_path)) == []
