"""Column expressions shared by all operators (JVM-side, codegen friendly).

Nothing here touches data on the driver: functions either build Column
expressions or turn a scalar parameter (``as_of``) into literals.
"""

from __future__ import annotations

import datetime as _dt
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchwise.sources.schemas import AMOUNT, MONEY, TOTAL

# ---------------------------------------------------------------- fixed values
# Fixed values of the chain's business rules (must stay as stated).
DEFAULT_TOP_N = 8           # top-stock report when N is NULL or <= 0
LOW_STOCK_BELOW = 50        # a product is "low" when stock < 50
PREVIEW_ROWS = 8            # preview shows 8 rows plus a "more" flag
TREND_DAYS = 7              # zero-filled daily trend length
TREND_WEEKS = 8             # weekly trend length
CENTRAL = "CENTRAL"         # the central node is not a selling branch
# Reject codes of the reference procedures.
E_INPUT = 50000
E_NOT_FOUND = 50001
E_50002 = 50002
E_50003 = 50003
E_50004 = 50004
E_50005 = 50005


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- text rules
def clean(x) -> Column:
    """LTRIM(RTRIM(x)): blanks only (not tabs), like T-SQL."""
    return F.trim(c(x))


def blank_to_null(x) -> Column:
    """NULLIF(LTRIM(RTRIM(x)), '')."""
    return F.nullif(clean(x), F.lit(""))


def is_blank(x) -> Column:
    """NULLIF(LTRIM(RTRIM(x)), '') IS NULL."""
    return blank_to_null(x).isNull()


def patch_text(new, old) -> Column:
    """COALESCE(NULLIF(LTRIM(RTRIM(new)), ''), old): blank means no change."""
    return F.coalesce(blank_to_null(new), c(old))


def normalise_branch(x, codes: Column | None = None) -> Column:
    """Trim and upper-case a branch code (registry membership is a join)."""
    return F.upper(clean(x))


def to_number(x) -> Column:
    """JS ``Number(x || 0)``: NULL, blank and non-numeric text become 0."""
    return F.coalesce(clean(c(x).cast("string")).try_cast(TOTAL), F.lit(0).cast(TOTAL))


# ---------------------------------------------------------------- money
def amount(qty="qty", price="unit_price") -> Column:
    """CAST(qty * unit_price AS DECIMAL(18,2)) on INT x DECIMAL(10,2)."""
    return (c(qty).cast("int") * c(price).cast(MONEY)).cast(AMOUNT)


def money_sum(x) -> Column:
    """SUM of amounts, pinned to DECIMAL(28,2) in every engine."""
    return F.sum(c(x)).cast(TOTAL)


def int_sum(x) -> Column:
    return F.sum(c(x)).cast("bigint")


def resolve_price(given, catalogue) -> Column:
    """COALESCE(NULLIF(given, 0), catalogue, 0) as DECIMAL(10,2)."""
    return F.coalesce(F.nullif(c(given), F.lit(0)), c(catalogue), F.lit(0)).cast(MONEY)


# ---------------------------------------------------------------- calendar
def sql_year(ts) -> Column:
    return F.year(c(ts))


def sql_week(ts) -> Column:
    """DATEPART(WEEK, d) with weeks starting Sunday and week 1 holding 1 Jan.

    Not ISO: 2023-01-01 is week 1, 2000-12-31 is week 54.
    """
    d = F.to_date(c(ts))
    jan1 = F.trunc(d, "year")
    return (F.floor((F.dayofyear(d) - 1 + F.dayofweek(jan1) - 1) / 7) + 1).cast("int")


def py_week(d: _dt.date) -> int:
    """The same week rule on a scalar parameter (driver side, no data)."""
    jan1 = _dt.date(d.year, 1, 1)
    jan1_dow = jan1.isoweekday() % 7  # Sunday = 0
    return (d.timetuple().tm_yday - 1 + jan1_dow) // 7 + 1


def week_bounds(as_of: _dt.date, offset: int = 0) -> tuple[_dt.date, _dt.date] | None:
    """[start, end) dates of week ``week(as_of) + offset`` of as_of's year.

    Weeks are cut at 1 January (a partial first and last week), and week 0
    does not exist ("last week" of week 1 is empty, reference quirk Q1).
    Filtering ``created_at`` on these bounds is the same as filtering on
    DATEPART(WEEK/YEAR) but pushes down to the Parquet scan.
    """
    jan1 = _dt.date(as_of.year, 1, 1)
    target = py_week(as_of) + offset
    if target < 1:
        return None
    start = jan1 - _dt.timedelta(days=jan1.isoweekday() % 7) + _dt.timedelta(weeks=target - 1)
    end = start + _dt.timedelta(days=7)
    start, end = max(start, jan1), min(end, _dt.date(as_of.year + 1, 1, 1))
    if start >= end:
        return None
    return start, end


def ts_lit(d: _dt.date) -> Column:
    """Midnight of a date as a TIMESTAMP_NTZ literal (folded by Catalyst).

    Invoice times are wall-clock times without a zone (as in the driver's
    data), so day and week cuts never depend on the session time zone.
    """
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def in_days(ts, start: _dt.date, end: _dt.date) -> Column:
    """start <= ts < end, written on the raw column so it reaches the scan."""
    return (c(ts) >= ts_lit(start)) & (c(ts) < ts_lit(end))


def in_week(ts, as_of: _dt.date, offset: int = 0) -> Column:
    b = week_bounds(as_of, offset)
    if b is None:
        return F.lit(False)
    return in_days(ts, *b)


def as_date(x) -> _dt.date:
    if isinstance(x, _dt.datetime):
        return x.date()
    if isinstance(x, _dt.date):
        return x
    return _dt.date.fromisoformat(str(x))


def week_label(year, week) -> Column:
    """``YYYY-Www`` (week zero-padded to two digits)."""
    return F.format_string("%d-W%02d", c(year), c(week))


def iso_day(ts) -> Column:
    """``toISOString().slice(0, 10)`` in UTC."""
    return F.date_format(c(ts), "yyyy-MM-dd")


def short_day(ts) -> Column:
    return F.date_format(c(ts), "MM-dd")


def display_time(ts) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` in UTC."""
    return F.date_format(c(ts), "dd/MM/yyyy HH:mm:ss")


def generated_id(prefix, batch_tag: str, seq="seq") -> Column:
    """Batch form of the service's generated ids: ``<prefix><batch tag>_<seq>``.

    The service uses the clock (``HD_<epoch ms>``; a branch letter plus the
    last digits of the clock for employees, which can collide).  Here the id
    is a function of the batch and the request, so a re-run of the same
    batch gives the same ids and two requests never share one.
    """
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(pre, F.lit(batch_tag), F.lit("_"), c(seq).cast("string"))


def isin_cols(x, values: Iterable[str]) -> Column:
    return c(x).isin(list(values))
