"""Times of the service day, day types and service windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAY, SATURDAY, SUNDAY = "평일", "토요일", "일요일"


def minutes_of(s: Column) -> Column:
    """Minutes of HH:MM, HH:MM:SS (hours may pass 24) or yyyymmddHHMMSS; null for what is blank or none of these."""
    s = F.trim(s)
    colon = F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(?::\d{2})?$", 1).try_cast("int") * 60 + F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(?::\d{2})?$", 2).try_cast("int")
    stamp = F.regexp_extract(s, r"^\d{8}(\d{2})(\d{2})\d{2}$", 1).try_cast("int") * 60 + F.regexp_extract(s, r"^\d{8}(\d{2})(\d{2})\d{2}$", 2).try_cast("int")
    return F.coalesce(colon, stamp)


def hhmm(minutes: Column) -> Column:
    """HH:MM of minutes since midnight, past 24 hours on the same service day."""
    return F.when(minutes.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int")))


def day_type(at: Column) -> Column:
    day = F.weekday(at)
    return F.when(day == 5, SATURDAY).when(day == 6, SUNDAY).otherwise(WEEKDAY)


def rail_hour(at: Column) -> Column:
    """The hour of the service day: midnight and one o'clock are 24 and 25; there is none from two to four."""
    h = F.hour(at)
    return F.when(h < 2, h + 24).when(h >= 5, h)


def in_service(first: Column, last: Column, minute: Column) -> Column:
    """Whether a window that may pass midnight holds a minute; unknown ends mean yes."""
    inside = F.when(first <= last, minute.between(first, last)).otherwise((minute >= first) | (minute <= last))
    return F.coalesce(inside, F.lit(True))


def any_window(windows: Column, minute: Column) -> Column:
    """Whether any of an array of (first, last) structs holds a minute; no windows mean yes."""
    return F.when(windows.isNull() | (F.size(windows) == 0), True).otherwise(F.exists(windows, lambda w: in_service(w["first"], w["last"], minute)))


def parse_date(s: Column) -> Column:
    """A date in one of three notations; blank and invalid dates are null."""
    s = F.trim(s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "yyyyMMdd", "yyyy.MM.dd")])


def transfer_window_s(boarded: Column) -> Column:
    """Seconds within which a change counts as one journey: an hour at night, else half an hour."""
    h = F.hour(boarded)
    return F.when((h >= 21) | (h < 7), 3600).otherwise(1800)


def age_s(now: Column, received: Column) -> Column:
    """Seconds since receipt; clocks that run ahead give 0, unreadable times null."""
    return F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(received))
