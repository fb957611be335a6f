"""Ages, waits and collection slots as shown to readers; what counts as now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import let

#: Readers' offset from UTC.
OFFSET_SECONDS = 7 * 3600
DAY = 86_400
# When collection starts, in minutes of the UTC day, and words.
SLOTS = [60, 420, 780, 1110, 1140]
TODAY, YESTERDAY, JUST_NOW = "hôm nay", "hôm qua", "vừa xong"
MINUTES, HOURS, DAYS, MONTHS, AGO = " phút", " giờ", " ngày", " tháng", " trước"


def _said(n: Column, unit: str) -> Column:
    return F.concat(n.cast("bigint").cast("string"), F.lit(unit))


def short_age(at: Column, now: Column) -> Column:
    """Calendar days of the readers' day between; days from two on, months from thirty days on."""
    day = lambda t: F.floor((F.unix_seconds(t) + OFFSET_SECONDS) / DAY)
    return let(day(now) - day(at), lambda d: F.when(d <= 0, TODAY).when(d == 1, YESTERDAY).when(d < 30, _said(d, DAYS)).when(d >= 30, _said(F.floor(d / 30), MONTHS)))


def time_ago(at: Column, now: Column) -> Column:
    """Time that has passed, in the largest unit that fits."""
    return let(
        F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 60),
        lambda m: F.when(m < 1, JUST_NOW).when(m < 60, _said(m, MINUTES + AGO)).when(m < 1440, _said(F.floor(m / 60), HOURS + AGO)).when(m < 2880, YESTERDAY).when(m < 43_200, _said(F.floor(m / 1440), DAYS + AGO)).when(m >= 43_200, _said(F.floor(m / 43_200), MONTHS + AGO)),
    )


def days_left(until: Column, now: Column) -> Column:
    """Days to an end, begun ones whole; below zero when it is past, null without an end."""
    return F.ceil((F.unix_seconds(until) - F.unix_seconds(now)) / DAY).cast("int")


def next_slot(now: Column) -> Column:
    """The first collection after `now`."""

    def first(s: Column) -> Column:
        today = s - s % DAY
        return F.timestamp_seconds(F.array_min(F.filter(F.array(*[today + 60 * m + DAY * d for d in (0, 1) for m in SLOTS]), lambda t: t > s)))

    return let(F.unix_seconds(now), first)


def wait_text(now: Column, until: Column) -> Column:
    """A wait in minutes, in hours and minutes below three hours, else in hours, rounded."""

    def said(m: Column) -> Column:
        h, rest = F.floor(m / 60), m % 60
        return F.when(m < 60, _said(m, MINUTES)).when((h < 3) & (rest >= 15), F.concat(_said(h, HOURS), F.lit(" "), _said(rest, MINUTES))).otherwise(_said(F.when(rest >= 30, h + 1).otherwise(h), HOURS))

    return let(F.greatest(F.floor((F.unix_seconds(until) - F.unix_seconds(now)) / 60 + 0.5), F.lit(0)), said)


def freshness(last: Column, now: Column) -> Column:
    """good up to six hours after the last collection, warn up to a day, critical later or without one."""
    return let((F.unix_seconds(now) - F.unix_seconds(last)) / 3600, lambda h: F.when(h <= 6, "good").when(h <= 24, "warn").otherwise("critical"))
