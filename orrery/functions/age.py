"""Terms of the assembly ("age") from labels, codes, dates and task keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years in which terms begin (on 30 May), and bodies outside the count.
TERM_YEARS = [1948, 1950, 1954, 1958, 1960, 1963, 1967, 1971, 1973, 1979, 1981, 1985, 1988, 1992, 1996, 2000, 2004, 2008, 2012, 2016, 2020, 2024]
NAMED = {"제헌": 1, "제헌국회": 1, "국가보위입법회의": -3, "국가재건최고회의": -2, "비상국무회의": -1}


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def term_label(c: Column) -> Column:
    """`제21대`, `21대`, `21대 국회`, the founding assembly and three special bodies; null for anything else."""
    s = F.trim(c)
    out = F.coalesce(_int(F.regexp_extract(s, r"^제(\d+)대\z", 1)), _int(F.regexp_extract(s, r"^(\d+)대(?:\s*국회)?\z", 1)))
    for name, n in NAMED.items():
        out = F.when(s == name, F.lit(n)).otherwise(out)
    return out


def unit_code(c: Column) -> Column:
    """100001 to 100099 as 1 to 99."""
    n = F.trim(c).try_cast("int")
    return F.when(n.between(100001, 100099), n - 100000)


def digits_before_dae(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"(\d+)대", 1))


def loose_int(c: Column) -> Column:
    """Integer part of a number in text."""
    return F.trim(c).try_cast("double").cast("int")


def task_parameter(key: Column, field: str) -> Column:
    """The number behind `__FIELD_` in a task key."""
    return _int(F.regexp_extract(key, rf"__{field}_(-?\d+)", 1))


def term_of_date(c: Column) -> Column:
    """The latest term that began on or before the date. A bare year counts as its 30 June; of other text the first eight
    digits are the date. The terms are a literal array, so there is nothing to join."""
    digits = F.regexp_replace(F.trim(c), r"\D", "")
    text = F.when(F.trim(c).rlike(r"^\d{4}\z"), F.concat(F.trim(c), F.lit("0630"))).otherwise(F.substring(digits, 1, 8))
    day = F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))
    starts = F.array(*[F.lit(f"{y}-05-30").cast("date") for y in TERM_YEARS])
    n = F.size(F.filter(starts, lambda s: s <= day))
    return F.when(day.isNotNull() & (n > 0), n)


def derived_age(source: str, columns: dict[str, Column], task_key: Column) -> Column:
    """Age by a rule `constant:N`, `param:FIELD`, `column:FIELD`, `date:FIELD`, `join:...` or `none`."""
    kind, _, arg = source.partition(":")
    null = F.lit(None).cast("int")
    if kind == "constant":
        return F.lit(int(arg))
    if kind == "param":
        return task_parameter(task_key, arg)
    if kind not in ("column", "date") or arg not in columns:
        return null
    c = columns[arg].cast("string")
    if kind == "date":
        return term_of_date(c)
    if arg == "ERACO":
        return term_label(c)
    if arg in ("UNIT_CD", "PROFILE_UNIT_CD"):
        return unit_code(c)
    return F.coalesce(digits_before_dae(c), loose_int(c))
