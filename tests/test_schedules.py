"""Schedules around changes of the clock, and against the standard library."""

from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from turnwise.functions.schedules import occurrences

DDL = "i int, now string, hour int, minute int, weekday int, zone string"


def ask(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DDL)
    o = occurrences(F.to_timestamp("now"), F.col("hour"), F.col("minute"), F.col("weekday"), F.col("zone"))
    got = df.select("i", o.alias("o")).select("i", F.date_format("o.latest", "yyyy-MM-dd HH:mm").alias("a"), F.date_format("o.next", "yyyy-MM-dd HH:mm").alias("b")).orderBy("i").collect()
    return [(r.a, r.b) for r in got]


@pytest.mark.parametrize(
    ("now", "hour", "minute", "weekday", "zone", "latest", "following"),
    [
        # The clock skips 2:00 to 3:00 on 2024-03-10: 2:30 runs at 3:00, 07:00 in UTC.
        ("2024-03-10 06:59:00", 2, 30, None, "America/New_York", "2024-03-09 07:30", "2024-03-10 07:00"),
        ("2024-03-10 07:00:00", 2, 30, None, "America/New_York", "2024-03-10 07:00", "2024-03-11 06:30"),
        # 1:30 comes twice on 2024-11-03: the first counts, 05:30 in UTC.
        ("2024-11-03 05:30:00", 1, 30, None, "America/New_York", "2024-11-03 05:30", "2024-11-04 06:30"),
        ("2024-11-03 05:29:00", 1, 30, None, "America/New_York", "2024-11-02 05:30", "2024-11-03 05:30"),
        # Half an hour is skipped on 2024-10-06 from 2:00: 2:10 runs at 2:30, 15:30 in UTC the day before.
        ("2024-10-06 00:00:00", 2, 10, None, "Australia/Lord_Howe", "2024-10-05 15:30", "2024-10-06 15:10"),
        # 1:45 comes twice on 2024-04-07: the first is 14:45 in UTC the day before.
        ("2024-04-06 14:44:00", 1, 45, None, "Australia/Lord_Howe", "2024-04-05 14:45", "2024-04-06 14:45"),
        # Weekly, the Sunday of the gap.
        ("2024-03-12 00:00:00", 2, 30, 6, "America/New_York", "2024-03-10 07:00", "2024-03-17 06:30"),
        ("2024-01-01 00:00:00", 0, 0, 0, "UTC", "2024-01-01 00:00", "2024-01-08 00:00"),
    ],
)
def test_changes_of_the_clock(spark, now, hour, minute, weekday, zone, latest, following):
    assert ask(spark, (now, hour, minute, weekday, zone)) == [(latest, following)]


def one(now, hour, minute, weekday, zone):
    tz, utc = ZoneInfo(zone), dt.timezone.utc
    at = dt.datetime.fromisoformat(now).replace(tzinfo=utc)
    found = []
    for back in range(-8, 9):
        day = at.astimezone(tz).date() + dt.timedelta(days=back)
        if weekday is None or day.weekday() == weekday:
            local = dt.datetime(day.year, day.month, day.day, hour, minute)
            while local.replace(tzinfo=tz).astimezone(utc).astimezone(tz).replace(tzinfo=None) != local:
                local += dt.timedelta(minutes=1)
            found.append(local.replace(tzinfo=tz).astimezone(utc))
    return tuple(f"{x:%Y-%m-%d %H:%M}" for x in (max(x for x in found if x <= at), min(x for x in found if x > at)))


def test_against_the_standard_library(spark):
    rng = random.Random(7)
    zones = ["America/New_York", "Europe/Dublin", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo", "Pacific/Apia"]
    rows = [(f"{dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(366 * 1440)):%Y-%m-%d %H:%M:%S}", rng.randrange(24), rng.randrange(60), rng.choice([None, *range(7)]), rng.choice(zones)) for _ in range(150)]
    rows += [(f"2024-{d} {h:02}:00:00", rng.randrange(4), rng.randrange(60), None, z) for d, z in (("03-10", zones[0]), ("11-03", zones[0]), ("10-06", zones[2]), ("04-07", zones[2]), ("03-31", zones[1])) for h in range(0, 24, 3)]
    assert ask(spark, *rows) == [one(*r) for r in rows]
