"""Dates that are stored as text in several spellings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose_date(c: Column) -> Column:
    """The day in `yyyyMMdd`, `yyyy-MM-dd`, `yyyy.MM.dd`, `yyyy/MM/dd` or `yyyy년 M월 d일` text, with or without a time
    behind it; null for null, empty, unreadable and impossible dates."""
    s = F.trim(c)
    compact = F.regexp_extract(s, r"^(\d{8})(?:\D|$)", 1)
    part = lambda i: F.regexp_extract(s, r"^(\d{4})\s*(?:[-./]|년)\s*(\d{1,2})\s*(?:[-./]|월)\s*(\d{1,2})", i)
    return F.coalesce(
        F.try_to_date(F.nullif(compact, F.lit("")), "yyyyMMdd"),
        F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))), "yyyy-MM-dd"),
    )


def month_or_unknown(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))
