"""Occurrences of daily and weekly local times, over changes of the clock, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnwise.registry import register
from turnwise.sources.tables import calls

#: Days from today, or from the first day at or after it that has the weekday, whose times can be the last or the next: a day more than the calendar asks for, as clocks are set over midnight.
DAILY, WEEKLY = (-2, -1, 0, 1, 2), (-14, -7, 0, 7)


def instant(local: Column, zone: Column) -> Column:
    """The instant of a local time in a zone: the first of two where the clock is set back, and where it is set forward over the time the first minute after the gap.

    Instants and local times are timestamps of a session in UTC.
    """
    at = F.to_utc_timestamp(local, zone)
    shown = F.from_utc_timestamp(at, zone)
    gap = F.floor((F.unix_seconds(shown) - F.unix_seconds(local)) / 60).cast("int")
    later = lambda m: F.timestamp_seconds(F.unix_seconds(local) + m * 60)
    valid = F.filter(F.sequence(F.lit(1), F.greatest(gap, F.lit(1))), lambda m: F.from_utc_timestamp(F.to_utc_timestamp(later(m), zone), zone) == later(m))
    return F.when(shown == local, at).otherwise(F.to_utc_timestamp(later(F.element_at(valid, 1)), zone))


def occurrences(now: Column, hour: Column, minute: Column, weekday: Column, zone: Column) -> Column:
    """(latest, next): the last occurrence at or before `now` and the first after it. weekday: 0 is Monday, null every day."""
    today = F.unix_date(F.from_utc_timestamp(now, zone).cast("date"))
    first = today + F.pmod(weekday - F.weekday(F.date_from_unix_date(today)), F.lit(7))

    def on(day: Column) -> Column:
        return instant(F.timestamp_seconds(day.cast("bigint") * 86400 + hour * 3600 + minute * 60), zone)

    days = F.when(weekday.isNull(), F.array(*[(today + d).cast("int") for d in DAILY])).otherwise(F.array(*[(first + d).cast("int") for d in WEEKLY]))
    times = F.transform(days, on)
    return F.struct(F.array_max(F.filter(times, lambda t: t <= now)).alias("latest"), F.array_min(F.filter(times, lambda t: t > now)).alias("next"))


@register("ses09_schedule_occurrences")
def ses09_schedule_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs around each call's time, of daily and weekly schedules in zones that change their clocks at different times."""
    k = F.col("call_id")
    zones = F.array(*[F.lit(z) for z in ("America/New_York", "Europe/Dublin", "Australia/Lord_Howe", "Asia/Kolkata")])
    c = calls(spark, sf_dir).select("call_id", F.col("created_at").cast("timestamp").alias("now"))
    o = occurrences(F.col("now"), k % 24, (k * 7) % 60, F.when(k % 2 == 0, (k % 7).cast("int")), F.element_at(zones, (k % 4 + 1).cast("int")))
    return c.select("call_id", o.alias("o")).select("call_id", F.col("o.latest").cast("timestamp_ntz").alias("latest"), F.col("o.next").cast("timestamp_ntz").alias("next"))
