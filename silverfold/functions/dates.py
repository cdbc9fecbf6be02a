"""Times of pictures: plausibility, fallbacks, and times written in file names."""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First plausible time (a day before 2000), a day's slack, the span of epoch times in names, its years.
FIRST, DAY = 946684800 - 86400, 86400
EPOCH_FROM, EPOCH_TO = 946684800, 1900000000
YEARS = range(1990, 2101)
#: Sources of a time.
EXIF, FILENAME, FILE_TIME, NOW, MANUAL = 0, 1, 2, 3, 4


def plausible(t: Column, now: Column | int) -> Column:
    now = F.lit(now) if isinstance(now, int) else now
    return F.coalesce(t.between(F.lit(FIRST), now + DAY), F.lit(False))


def earlier_plausible(a: Column, b: Column, now: Column | int) -> Column:
    """The earlier of two times that are plausible, or null."""
    return F.least(F.when(plausible(a, now), a), F.when(plausible(b, now), b))


def taken_at(exif: Column, from_name: Column, modified: Column, born: Column, now: int) -> Column:
    """The time of a picture and its source: its EXIF, its name, the earlier plausible file time, or now."""
    file_time = earlier_plausible(modified, born, now)
    ok = F.when(plausible(exif, now), exif)
    named = F.when(plausible(from_name, now), from_name)
    at = F.coalesce(ok, named, file_time, F.lit(now).cast("long"))
    source = F.when(ok.isNotNull(), EXIF).when(named.isNotNull(), FILENAME).when(file_time.isNotNull(), FILE_TIME).otherwise(NOW)
    return F.struct(at.alias("taken_at"), source.alias("source"))


def video_taken_at(clues: list[Column], now: int) -> Column:
    """The earliest plausible clue and its place in the list; of equal ones the first."""
    pairs = [F.when(plausible(c, now), F.struct(c.alias("at"), F.lit(i).alias("clue"))) for i, c in enumerate(clues)]
    return F.array_min(F.array_compact(F.array(*pairs)))


def _seconds(y: int, mo: int, d: int, h: int = 0, mi: int = 0, s: int = 0) -> int | None:
    if y not in YEARS or not (1 <= mo <= 12) or h > 23 or mi > 59 or s > 59 or not (1 <= d <= calendar.monthrange(y, mo)[1]):
        return None
    return int(dt.datetime(y, mo, d, h, mi, s, tzinfo=dt.UTC).timestamp())


def _read(digits: str) -> int | None:
    """A run of digits as a time: 14 to the second, 12 to the minute or with a short year, 8 a day."""
    n = [int(digits[i : i + 2]) for i in range(0, len(digits) - 1, 2)]
    year = n[0] * 100 + n[1] if len(n) > 1 else 0
    if len(digits) == 14:
        return _seconds(year, *n[2:7])
    if len(digits) == 12:
        long_year = _seconds(year, *n[2:6])
        return long_year if long_year is not None else _seconds(2000 + n[0], *n[1:6])
    return _seconds(year, *n[2:4]) if len(digits) == 8 else None


_RUN = re.compile(r"\d(?:[-._ :]?\d){0,13}", re.ASCII)
_EPOCH = re.compile(r"(?<!\d)(\d{13})\d{0,6}(?!\d)", re.ASCII)


def time_in_name(name: str | None) -> int | None:
    """Unix seconds (UTC) a file name tells, or None.

    From each digit on, up to 14 digits are read across single separators; the first that make
    a time count. Only a name with none is searched for milliseconds since 1970.
    """
    if not name:
        return None
    at = 0
    while m := _RUN.search(name, at):
        t = _read(re.sub(r"\D", "", m.group()))
        if t is not None:
            return t
        at = m.start() + 1
    for m in _EPOCH.finditer(name):
        t = int(m.group(1)) // 1000
        if EPOCH_FROM <= t < EPOCH_TO:
            return t
    return None


@F.pandas_udf(T.LongType())
def filename_time(names: pd.Series) -> pd.Series:
    """``time_in_name`` over a column; equal names are read once a batch."""
    found = {n: time_in_name(n) for n in names.dropna().unique()}
    return names.map(found).astype("Int64")


def exif_time(text: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` (any separators) as unix seconds, years 1990 to 2100; else null."""
    p = lambda a, n: F.try_to_number(F.substring(text, a, n), F.lit("9" * n)).cast("int")
    shape = text.rlike(r"^\d{4}.\d{2}.\d{2}.\d{2}.\d{2}.\d{2}")
    clean = F.regexp_replace(F.substring(text, 1, 19), r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2})", "$1-$2-$3 $4:$5:$6")
    return F.when(shape & p(1, 4).between(YEARS[0], YEARS[-1]), F.unix_timestamp(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss"))))


def iso_time(text: Column) -> Column:
    """An ISO time with an offset or Z as unix seconds; else null."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def shutter(seconds: Column) -> Column:
    """An exposure time for people: ``1/250`` below a second, else seconds."""
    return F.when(seconds <= 0, None).when(seconds < 1, F.concat(F.lit("1/"), F.round(1 / seconds).cast("long").cast("string"))).otherwise(F.concat(F.round(seconds, 1).cast("string"), F.lit("s")))
