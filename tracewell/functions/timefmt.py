"""ISO instants and epoch seconds; sessions run in UTC, offsets in the text are not applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import col

DAY = 86400


def iso_from_epoch(seconds) -> Column:
    days = F.floor(col(seconds) / DAY).cast("int")
    rest = F.pmod(col(seconds).cast("long"), F.lit(DAY))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def epoch_from_civil(year, month, day, hour, minute, second) -> Column:
    days = F.datediff(F.make_date(col(year), col(month), col(day)), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + col(hour) * 3600 + col(minute) * 60 + col(second)


def epoch_from_iso(text) -> Column:
    """Seconds of the first 19 characters; null where they aren't a date and a time."""
    shape = r"\A(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})"
    part = [F.regexp_extract(col(text), shape, i).try_cast("int") for i in range(1, 7)]
    date = F.try_to_date(F.substring(col(text), 1, 10), "yyyy-MM-dd")
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(col(text).rlike(shape), days * DAY + part[3] * 3600 + part[4] * 60 + part[5])


def within_window(instant, start, end, pad: int) -> Column:
    """Whether epoch seconds lie in [start - pad, end + pad]."""
    return col(instant).between(col(start) - pad, col(end) + pad)
