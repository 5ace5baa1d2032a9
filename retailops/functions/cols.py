"""Column helpers.

Each helper takes and returns ``Column`` objects built from ``pyspark.sql.functions``
only, so they stay inside whole-stage codegen; none is a Python UDF. Reference dates
(``as_of``) are always arguments.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


# --- predicates -----------------------------------------------------------------

def is_present(c) -> Column:
    """A value is present when it is not null and not all blanks."""
    c = _c(c)
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def blank_to_null(c) -> Column:
    """Oracle rule: empty text is null."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def differs(a_cols: Sequence, b_cols: Sequence | None = None, null_safe: bool = True) -> Column:
    """True when any pair of columns differs.

    ``null_safe`` treats null = null as equal and null vs value as different (the
    ``nvl(a, x) != nvl(b, x)`` idiom); otherwise plain ``!=`` (null never differs).
    """
    b_cols = b_cols if b_cols is not None else a_cols
    tests = []
    for a, b in zip(a_cols, b_cols):
        a, b = _c(a), _c(b)
        tests.append(~a.eqNullSafe(b) if null_safe else (a != b))
    return reduce(lambda x, y: x | y, tests)


def in_effect(from_col, to_col, as_of, end: str = "exclusive") -> Column:
    """Row valid on ``as_of``; ``end`` says whether the end date is included."""
    d = _lit_date(as_of)
    f, t = _c(from_col), _c(to_col)
    return (f <= d) & ((t > d) if end == "exclusive" else (t >= d))


def older_than(c, as_of, n: int, unit: str = "days") -> Column:
    """``c`` is before ``as_of`` minus n units (days, months, years, minutes)."""
    return _c(c) < shift(_lit_date(as_of), -n, unit)


def newer_than(c, as_of, n: int, unit: str = "days") -> Column:
    return _c(c) >= shift(_lit_date(as_of), -n, unit)


def allowed_by(status_col, by_col, rule_map: Mapping, default: bool = False) -> Column:
    """Status threshold chosen by another column.

    ``rule_map`` maps a value of ``by_col`` to the set of allowed statuses; the
    result is a boolean usable in ``where``.
    """
    s, b = _c(status_col), _c(by_col)
    expr = None
    for k, allowed in rule_map.items():
        test = s.isin(list(allowed))
        expr = F.when(b == F.lit(k), test) if expr is None else expr.when(b == F.lit(k), test)
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


# --- text ----------------------------------------------------------------------

def right(c, n: int) -> Column:
    """H1: last ``n`` characters."""
    c = _c(c)
    return F.substring(c, -n, n)


def after_last(c, sep: str) -> Column:
    """H4: text after the last separator (whole text when there is none)."""
    return F.substring_index(_c(c), sep, -1)


def zero_padded(text: Column, width: int, what: str = "number") -> Column:
    """Text padded with zeros on the left; an error, not a cut, where it is longer than ``width``."""
    too_wide = F.raise_error(F.concat(F.lit(f"{what} wider than {width} digits: "), text)).cast("string")
    return F.when(F.length(text) > width, too_wide).otherwise(F.lpad(text, width, "0"))


def in_year(c, year: int) -> Column:
    """A date or timestamp column within a calendar year, as a range that reaches the scan."""
    import datetime as dt
    c = _c(c)
    return (c >= F.lit(dt.date(year, 1, 1))) & (c < F.lit(dt.date(year + 1, 1, 1)))


def digits(c, precision: int) -> Column:
    """H5: DB2 ``DIGITS``: absolute value, decimal point dropped, zero padded.

    ``c`` must be an integer or a decimal whose scale the caller has fixed; the
    digit count is the declared precision, and a value with more digits is an error.
    """
    c = _c(c)
    txt = F.regexp_replace(F.abs(c).cast("string"), r"\.", "")
    return zero_padded(txt, precision)


def nullif_prefix(c, prefix: str) -> Column:
    """H7: null when the text starts with a marker prefix."""
    c = _c(c)
    return F.when(c.startswith(prefix), F.lit(None).cast("string")).otherwise(c)


def nvl2(c, if_present, if_null) -> Column:
    """H7: two-way null test."""
    return F.when(_c(c).isNotNull(), if_present).otherwise(if_null)


def map_code(c, mapping: Mapping, default=None) -> Column:
    """H8: code → label map as a CASE chain (stays in codegen, no join)."""
    c = _c(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def letter_code(c, blank_codes: Sequence[str] = ("0", " ", ""), unknown: str = "XX") -> Column:
    """A letter A-Z becomes its two-digit alphabet position ('A' → '01').

    The table of 26 letters is generated from the rule (ascii - 64) instead of being
    written out; ``blank_codes`` map to '00', anything else to ``unknown``.
    """
    c = _c(c)
    return (F.when(c.isin(list(blank_codes)) | c.isNull(), F.lit("00"))
             .when(c.rlike("^[A-Z]$"), F.lpad((F.ascii(c) - 64).cast("string"), 2, "0"))
             .otherwise(F.lit(unknown)))


def row_max(a, b) -> Column:
    """H9: larger of two values, null when either is null (DB2 scalar MAX)."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(a, b))


def row_min(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.least(a, b))


# --- dates and times -----------------------------------------------------------

def shift(c, n: int, unit: str = "days") -> Column:
    """Add ``n`` days/weeks/months/years/minutes/hours (negative subtracts)."""
    c = _c(c)
    unit = unit.rstrip("s")
    if unit == "day":
        return F.date_add(c, n)
    if unit == "week":
        return F.date_add(c, 7 * n)
    if unit == "month":
        return F.add_months(c, n)
    if unit == "year":
        return F.add_months(c, 12 * n)
    if unit in ("minute", "hour", "second"):
        return c + F.make_dt_interval(
            F.lit(0), F.lit(n if unit == "hour" else 0),
            F.lit(n if unit == "minute" else 0), F.lit(n if unit == "second" else 0))
    raise ValueError(f"unknown unit {unit}")


def ts_literal(value, ntz: bool = True) -> Column:
    """A timestamp literal; wall-clock (``timestamp_ntz``) by default, to compare with
    NTZ columns without any session time-zone conversion."""
    if isinstance(value, Column):
        return value
    txt = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else str(value)
    return F.lit(txt).cast("timestamp_ntz" if ntz else "timestamp")


def safe_next_day(c, sentinel: str = "9999-12-31") -> Column:
    """Day after, except the open-end sentinel stays itself (year 10000 is not a date
    any client can receive)."""
    c = _c(c)
    return F.when(c >= F.lit(sentinel).cast("date"), c).otherwise(F.date_add(c, 1))


def safe_prev_day(c, sentinel: str = "0001-01-01") -> Column:
    c = _c(c)
    return F.when(c <= F.lit(sentinel).cast("date"), c).otherwise(F.date_sub(c, 1))


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(_c(later), _c(earlier))


def minutes_between(later, earlier) -> Column:
    """Whole minutes elapsed between two timestamps (floor, microsecond exact)."""
    # timestamp_diff works on wall-clock (NTZ) timestamps as they are; converting
    # through the session time zone would bend differences across DST changes
    return F.floor(F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / 60_000_000).cast("long")


def week_start(c, first_day: int = 1) -> Column:
    """The ``first_day`` (1 = Sunday, as DB2 DAYOFWEEK) on or before the date."""
    c = _c(c)
    return F.date_sub(c, F.pmod(F.dayofweek(c) - F.lit(first_day), F.lit(7)).cast("int"))


def nth_weekday(year, month, dow: int, n: int) -> Column:
    """The n-th weekday ``dow`` (1 = Sunday … 7 = Saturday) of a month."""
    first = F.make_date(_c(year) if not isinstance(year, int) else F.lit(year),
                        _c(month) if not isinstance(month, int) else F.lit(month), F.lit(1))
    offset = F.pmod(F.lit(dow) - F.dayofweek(first), F.lit(7)) + F.lit(7 * (n - 1))
    return F.date_add(first, offset.cast("int"))


def local_time(now, tz_offset_hours) -> Column:
    """Time of day at a place whose clock is ``tz_offset_hours`` from ``now``."""
    minutes = (_c(tz_offset_hours) * 60).cast("int")
    ts = _c(now) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))
    return F.date_format(ts, "HH:mm:ss")


def still_open(now, tz_offset_hours, close_time, latest: str = "21:00:00") -> Column:
    """Local time is before the place's closing time and before ``latest``."""
    lt = local_time(now, tz_offset_hours)
    return (lt < _c(close_time)) & (lt < F.lit(latest))


def valid_date(c, fmt: str = "yyyyMMdd") -> Column:
    """Number or text like 20260231 → date, or null when it is not a real date."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def elapsed_text(hsecs) -> Column:
    """Hundredths of a second → ``hh:mm:ss.cc``."""
    h = _c(hsecs).cast("long")
    secs = F.floor(h / 100).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(secs / 3600)), F.lit(":"), two(F.floor(F.pmod(secs, 3600) / 60)),
                    F.lit(":"), two(F.pmod(secs, 60)), F.lit("."), two(F.pmod(h, 100)))


def int_div(a, b) -> Column:
    """Integer division truncating toward zero (DB2 ``/`` on integers);
    null instead of an error when dividing by zero."""
    return F.try_divide(_c(a).cast("long"), _c(b).cast("long")).cast("long")


def cents(c) -> Column:
    """Money × 100 as a whole number."""
    return F.round(_c(c) * 100, 0).cast("long")


# --- product codes -------------------------------------------------------------

def long_code(c, width: int = 14) -> Column:
    """Zero-padded digit text of a number (the 14-digit item layout); a longer one is an error."""
    return zero_padded(_c(c).cast("decimal(38,0)").cast("string"), width, "item code")


def to_short_code(c) -> Column:
    """14-digit code d1..d14 → 13 characters d1 d3 d2 d4..d13."""
    s = zero_padded(F.rtrim(_c(c)), 14, "item code")
    return F.concat(F.substring(s, 1, 1), F.substring(s, 3, 1), F.substring(s, 2, 1),
                    F.substring(s, 4, 10))


def swap_2_3(c) -> Column:
    """I2 back direction, first step: swap characters 2 and 3 of the 13-char code."""
    s = _c(c)
    return F.concat(F.substring(s, 1, 1), F.substring(s, 3, 1), F.substring(s, 2, 1),
                    F.substring(s, 4, 10))


def check_digit(c, zero_prefixes: Sequence[str] = ()) -> Column:
    """Mod-10 check digit of a 13-digit text, weights 3,1,3,... from the left.

    Digit = (10 - sum mod 10) mod 10. Codes starting with any of ``zero_prefixes``
    get '0' regardless (one audit forces this for two prefixes).
    """
    s = _c(c)
    total = reduce(lambda x, y: x + y,
                   [F.substring(s, i, 1).try_cast("int") * (3 if i % 2 else 1) for i in range(1, 14)])
    dig = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
    for p in zero_prefixes:
        dig = F.when(s.startswith(p), F.lit("0")).otherwise(dig)
    return dig


def to_long_code(c, zero_prefixes: Sequence[str] = ()) -> Column:
    """13-character code → 14-character code: swap chars 2/3, append check digit."""
    g = swap_2_3(c)
    return F.concat(g, check_digit(g, zero_prefixes))


def maker_id(c) -> Column:
    """I4: manufacturer id = '0' followed by characters 2-8 of the 13-character code."""
    return F.concat(F.lit("0"), F.substring(_c(c), 2, 7))
