"""Functions of time. Instants are timestamps in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def parse_instant(text: Column) -> Column:
    """An RFC 822 or ISO 8601 date, UTC where it names no zone; null where it is neither.

    The weekday of an RFC 822 date is left out first: feeds write wrong ones.
    """
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(bare),
    )


def hour_of(instant: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_micros(instant.cast("timestamp")) / (HOUR_MS * 1000)).cast("long")


def day_bounds(date: Column, zone: str) -> Column:
    """struct(start, end) of a calendar day in a zone, as instants; `end` is the day's last second."""
    start = F.to_utc_timestamp(date.cast("timestamp"), zone)
    return F.struct(start.alias("start"), (start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).alias("end"))


def clock_text(instant: Column, zone: str, pattern: str = "dd.MM.yyyy HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), pattern)


def duration_text(start: Column, end: Column) -> Column:
    """`h h m min`, to the nearest minute."""
    minutes = F.greatest(F.lit(0), F.round((F.unix_millis(end) - F.unix_millis(start)) / 60_000).cast("long"))
    hours = F.floor(minutes / 60).cast("string")
    rest = (minutes % 60).cast("string")
    return F.when(minutes >= 60, F.concat(hours, F.lit(" h "), rest, F.lit(" min"))).otherwise(F.concat(rest, F.lit(" min")))


def at_share(start: Column, end: Column, share: Column) -> Column:
    """The instant at a share (held to 0..1) of a range, in milliseconds."""
    a, b = F.unix_millis(start), F.unix_millis(end)
    return F.timestamp_millis((a + (b - a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).cast("long"))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_millis(end) - F.unix_millis(start)) / HOUR_MS


def local_day(instant: Column, hours: int) -> Column:
    """The calendar day at a fixed offset from UTC."""
    return F.to_date(instant + F.expr(f"INTERVAL {hours} HOURS"))


def file_stamp(instant: Column, zone: str) -> Column:
    """An instant in a zone for the name of a file: 20260131_0930."""
    return clock_text(instant, zone, "yyyyMMdd_HHmm")


def playback_grid(start: Column, end: Column, minutes_per_second: float, frame_seconds: float = 0.35) -> Column:
    """The instants that a playback shows: a frame goes on by its share of the speed (a frame counts 0.35 s at most), the last one is the end."""
    step = max(1, round(minutes_per_second * 60_000 * min(0.35, frame_seconds)))
    a, b = F.unix_millis(start), F.unix_millis(end)
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((b - a) / step).cast("long")), lambda i: F.timestamp_millis(a + i * step))
    last = F.timestamp_millis(b)
    return F.when(F.element_at(grid, -1) < last, F.concat(grid, F.array(last))).otherwise(grid)


def ticks(start: Column, end: Column, narrow: bool = False, zone: str = "Europe/Moscow") -> Column:
    """array<struct<share, at, label>>: 9, 8 or 7 evenly spaced marks by the length of a range (5 where it is narrow), clock times up to 1.5 days."""
    a, b = F.unix_millis(start), F.unix_millis(end)
    days = (b - a) / 86_400_000
    n = F.lit(5) if narrow else F.when(days <= 2, 9).when(days <= 7, 8).otherwise(7)
    share = lambda i: i / (n - 1)
    at = lambda i: F.timestamp_millis((a + (b - a) * share(i)).cast("long"))
    label = lambda i: F.when(days <= 1.5, clock_text(at(i), zone, "HH:mm")).otherwise(clock_text(at(i), zone, "MM/dd HH"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(share(i).alias("share"), at(i).alias("at"), label(i).alias("label")))
