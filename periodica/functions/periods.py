"""Period arithmetic: a period is an integer ordinal, so the next period is +1.

Y = year, Q = year*4 + quarter-1, M = year*12 + month-1, D = days since 1970-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FREQUENCIES = ("Y", "Q", "M", "D")

# Largest number of distinct periods between 0001-01-01 and 9999-12-31 (fixed values).
CALENDAR_PERIODS = {"Y": 9999, "Q": 39996, "M": 119988, "D": 3652059}

# Month names accepted in year-by-month tables (fixed values): English and Spanish, long and short.
MONTH_NAMES = {
    1: ("JANUARY", "JAN", "ENERO", "ENE"),
    2: ("FEBRUARY", "FEB", "FEBRERO"),
    3: ("MARCH", "MAR", "MARZO"),
    4: ("APRIL", "APR", "ABRIL", "ABR"),
    5: ("MAY", "MAYO"),
    6: ("JUNE", "JUN", "JUNIO"),
    7: ("JULY", "JUL", "JULIO"),
    8: ("AUGUST", "AUG", "AGOSTO", "AGO"),
    9: ("SEPTEMBER", "SEP", "SEPT", "SEPTIEMBRE", "SETIEMBRE", "SET"),
    10: ("OCTOBER", "OCT", "OCTUBRE"),
    11: ("NOVEMBER", "NOV", "NOVIEMBRE"),
    12: ("DECEMBER", "DEC", "DICIEMBRE", "DIC"),
}

QUARTER_LABEL = r"^Q[1-4]\s\d\d$"


def check_frequency(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")
    return freq


def period_index(ts: Column | str, freq: str) -> Column:
    """Ordinal of the calendar period that contains ``ts``."""
    check_frequency(freq)
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq == "Y":
        out = F.year(c)
    elif freq == "Q":
        out = F.year(c) * 4 + F.quarter(c) - 1
    elif freq == "M":
        out = F.year(c) * 12 + F.month(c) - 1
    else:
        out = F.unix_date(c.cast("date"))
    return out.cast("bigint")


def period_label(idx: Column | str, freq: str) -> Column:
    """Readable label: ``1999``, ``1999Q2``, ``1999-05`` or ``1999-05-31``."""
    check_frequency(freq)
    c = F.col(idx) if isinstance(idx, str) else idx
    if freq == "Y":
        return c.cast("string")
    if freq == "Q":
        return F.format_string("%dQ%d", F.floor(c / 4), c % 4 + 1)
    if freq == "M":
        return F.format_string("%d-%02d", F.floor(c / 12), c % 12 + 1)
    return F.date_from_unix_date(c.cast("int")).cast("string")


def quarter_label_index(label: Column | str, as_of_year: int) -> Column:
    """``QX YY`` to a quarterly ordinal; two-digit years never lie after ``as_of_year``."""
    c = F.col(label) if isinstance(label, str) else label
    century = as_of_year // 100 * 100
    yy = F.substring(c, 4, 2).cast("int")
    year = F.when(yy + century > as_of_year, yy + (century - 100)).otherwise(yy + century)
    idx = year * 4 + F.substring(c, 2, 1).cast("int") - 1
    return F.when(c.rlike(QUARTER_LABEL), idx.cast("bigint"))


def month_number(name: Column | str) -> Column:
    """Month number of an English or Spanish month name in any case, else null."""
    c = F.col(name) if isinstance(name, str) else name
    pairs = [F.lit(v) for month, names in MONTH_NAMES.items() for n in names for v in (n, month)]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(c)))
