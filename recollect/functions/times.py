"""Time functions; the moment of evaluation is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short names of the weekdays from Monday on.
WEEKDAYS = ("lun", "mar", "mié", "jue", "vie", "sáb", "dom")


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of: Column, n: int) -> Column:
    return as_of - F.expr(f"INTERVAL {n} DAYS")


def bucket(granularity: str, ts: Column) -> Column:
    return F.date_trunc(granularity, ts).cast("timestamp_ntz")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 60_000_000)


def time_ago(ts: Column, as_of: Column, just_now: str = "ahora") -> Column:
    """How long ago, in the fixed words of the domain."""
    m = minutes_between(as_of, ts)
    h = F.floor(m / 60)
    say = lambda n, unit: F.concat(F.lit("hace "), n.cast("string"), F.lit(unit))
    return F.when(ts.isNull(), "nunca").when(m < 1, just_now).when(m < 60, say(m, "m")).when(h < 24, say(h, "h")).otherwise(say(F.floor(h / 24), "d"))


def hour_label(ts: Column) -> Column:
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit("h"))


def day_label(ts: Column) -> Column:
    """Weekday and day of the month, in the fixed words of the domain."""
    return F.concat(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(ts) + 1), F.lit(", "), F.dayofmonth(ts).cast("string"))


def countdown(until: Column, as_of: Column) -> Column:
    """struct<days, hours, minutes, seconds>, zero once over."""
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 1_000_000))
    return F.struct(F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("minutes"), (s % 60).alias("seconds"))
