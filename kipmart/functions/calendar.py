"""Calendar helpers (F1-F3, T6, T7, V5-V8) as Column expressions.

Period filters are written as half-open ranges on the raw timestamp so the
predicate reaches the Parquet scan (``PushedFilters: [GreaterThanOrEqual,
LessThan]``); ``date_format(ts) = '…'`` or ``year(ts) = y`` would only push
``IsNotNull``.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH_RE = re.compile(r"^\d{4}-\d{2}$")
_DATE_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")

# Lao month names, January to December, as shown in reports.
LAO_MONTHS = ("ມັງກອນ", "ກຸມພາ", "ມີນາ", "ເມສາ", "ພຶດສະພາ", "ມິຖຸນາ",
              "ກໍລະກົດ", "ສິງຫາ", "ກັນຍາ", "ຕຸລາ", "ພະຈິກ", "ທັນວາ")
# Week label prefix and year label suffix.
WEEK_LABEL_PREFIX = "ອາທິດ "
YEAR_LABEL_SUFFIX = " ປີ"


def _ts(value: _dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def month_bounds(month: str) -> tuple[_dt.datetime, _dt.datetime] | None:
    """[first day, first day of next month) for ``yyyy-MM``; None when the
    month number is out of range (``2024-13`` passes the pattern, matches nothing)."""
    y, m = int(month[:4]), int(month[5:7])
    if not 1 <= m <= 12 or y < 1:
        return None
    start = _dt.datetime(y, m, 1)
    end = _dt.datetime(y + (m == 12), m % 12 + 1, 1)
    return start, end


def month_filter(col: Column, month: str | None) -> Column:
    """optional month filter. Missing or malformed month → no filter (V5);
    well-formed but impossible month → empty (V6)."""
    if not month or not _MONTH_RE.match(month):
        return F.lit(True)
    b = month_bounds(month)
    if b is None:
        return F.lit(False)
    return (col >= _ts(b[0])) & (col < _ts(b[1]))


def month_or_current(month: str | None, as_of: _dt.date) -> str:
    """V5: ``daily`` and ``preorder_time=day`` fall back to the current month."""
    if month and _MONTH_RE.match(month):
        return month
    return as_of.strftime("%Y-%m")


def strict_month_filter(col: Column, month: str) -> Column:
    b = month_bounds(month)
    if b is None:
        return F.lit(False)
    return (col >= _ts(b[0])) & (col < _ts(b[1]))


def day_filter(col: Column, day: str) -> Column:
    """``DATE(col) = day`` as a one-day range; malformed → no rows."""
    if not _DATE_RE.match(day or ""):
        return F.lit(False)
    try:
        d = _dt.datetime.strptime(day, "%Y-%m-%d")
    except ValueError:
        return F.lit(False)
    return (col >= _ts(d)) & (col < _ts(d + _dt.timedelta(days=1)))


def year_filter(col: Column, year: int) -> Column:
    """``YEAR(col) = year`` as a range."""
    return (col >= _ts(_dt.datetime(year, 1, 1))) & (col < _ts(_dt.datetime(year + 1, 1, 1)))


def month_key(col: Column) -> Column:
    """``%Y-%m`` key."""
    return F.date_format(col, "yyyy-MM")


def iso_year(col: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col)


def iso_week_key(col: Column) -> Column:
    """V7: ``YEARWEEK(d, 1)`` = ISO year * 100 + ISO week."""
    return (iso_year(col) * 100 + F.weekofyear(col)).cast("bigint")


def week_of_year_mode1(col: Column) -> Column:
    """V7: ``WEEK(d, 1)`` — ISO week, but 0 before ISO week 1 and 53 after the
    year's last ISO week, counted inside the calendar year."""
    iy = iso_year(col)
    y = F.year(col)
    return (F.when(iy < y, F.lit(0)).when(iy > y, F.lit(53))
            .otherwise(F.weekofyear(col))).cast("bigint")


def lao_month_label(col: Column) -> Column:
    """Lao month name, a blank, the year."""
    names = [F.lit(n) for n in LAO_MONTHS]
    return F.concat(F.elt(F.month(col), *names), F.lit(" "), F.year(col).cast("string"))


def week_label(col: Column) -> Column:
    return F.concat(F.lit(WEEK_LABEL_PREFIX), week_of_year_mode1(col).cast("string"),
                    F.lit(" /"), F.year(col).cast("string"))


def year_label(col: Column) -> Column:
    return F.concat(F.year(col).cast("string"), F.lit(YEAR_LABEL_SUFFIX))


def day_label(col: Column) -> Column:
    """``%d/%m/%Y``."""
    return F.date_format(col, "dd/MM/yyyy")


# ---- partition predicates for tables stored by order month -----------------
MONTH_PARTITION = "order_month"


def month_partition_filter(kind: str | None, value) -> Column | None:
    """Predicate on the ``order_month`` partition column (``yyyy-MM``) that
    matches the period filter of the same kind, so a month-partitioned table
    is pruned at file listing. ``None`` when the period does not restrict."""
    c = F.col(MONTH_PARTITION)
    if kind == "month":
        if not value or not _MONTH_RE.match(value):
            return None
        return c == value if month_bounds(value) else F.lit(False)
    if kind == "strict_month":
        return c == value if month_bounds(value) else F.lit(False)
    if kind == "day":
        return c == value[:7] if value and _DATE_RE.match(value) else F.lit(False)
    if kind == "year":
        return (c >= f"{int(value):04d}-01") & (c <= f"{int(value):04d}-12")
    return None


def period_filter(col: Column, kind: str | None, value) -> Column:
    """The created-at predicate of a period (see the individual filters)."""
    if kind == "month":
        return month_filter(col, value)
    if kind == "strict_month":
        return strict_month_filter(col, value)
    if kind == "day":
        return day_filter(col, value)
    if kind == "year":
        return year_filter(col, value)
    return F.lit(True)
