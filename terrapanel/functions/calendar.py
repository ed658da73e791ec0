"""Calendar and cleaning expressions.

All builders return ``Column`` expressions evaluated inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel import fixed_values as FV


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """trim, upper-case; '', 'NAN', 'NONE' become null."""
    v = F.upper(F.trim(_c(c)))
    return F.when(v.isin("", "NAN", "NONE"), F.lit(None).cast("string")).otherwise(v)


#: Year-first forms only: a day-first and a month-first date cannot be told apart.
DATE_FORMATS = ("yyyy/MM/dd", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """Strict parse by the first of ``formats`` that fits; other text becomes
    null (never raises; ``files.rejected_dates`` counts it)."""
    formats = (formats,) if isinstance(formats, str) else formats
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(c).cast("string")), F.lit(f)).cast("date") for f in formats])


def numeric_coerce(c, dtype: str = "double") -> Column:
    """Non-numeric -> null (ANSI-safe)."""
    return _c(c).try_cast(dtype)


def month_abbr_title(month_num) -> Column:
    """'Jan'..'Dec' for 1..12, else the value as text, else 'Unknown' (app form)."""
    m = _c(month_num)
    names = F.array(*[F.lit(a.title()) for a in FV.MONTH_ABBR])
    return (F.when(m.between(1, 12), F.element_at(names, m.cast("int")))
             .when(m.isNotNull(), m.cast("string"))
             .otherwise(F.lit("Unknown")))


def month_abbr_upper(d) -> Column:
    """P2: 'JAN'.. from a date (locale-free)."""
    names = F.array(*[F.lit(a) for a in FV.MONTH_ABBR])
    return F.element_at(names, F.month(_c(d)))


def month_num(month_text=None, date=None) -> Column:
    """Month number from a name ('Jan', 'JANUARY', ' jan '), a numeric
    text, or the date, in that order of preference."""
    from terrapanel.operators.lookup import month_code_map

    parts = []
    if month_text is not None:
        t = clean_text(month_text)
        parts.append(F.element_at(month_code_map(), t))
        parts.append(F.element_at(month_code_map(), F.substring(t, 1, 3)))
        n = t.try_cast("double")
        parts.append(F.when((n >= 1) & (n <= 12) & (n == F.floor(n)), n.cast("int")))
    if date is not None:
        parts.append(F.month(_c(date)))
    return F.coalesce(*parts).cast("int") if parts else F.lit(None).cast("int")


def month_name(month_text, month_number) -> Column:
    """keep the given month text; fill from the number as 'JAN'.. when missing."""
    names = F.array(*[F.lit(a) for a in FV.MONTH_ABBR])
    m = _c(month_number)
    from_num = F.when(m.between(1, 12), F.element_at(names, m.cast("int")))
    if month_text is None:
        return from_num
    return F.coalesce(clean_text(month_text), from_num)


def month_sin(m) -> Column:
    """sin(2π·m/12); null-safe."""
    return F.sin(F.lit(2 * math.pi) * _c(m).cast("double") / F.lit(12.0))


def month_cos(m) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(m).cast("double") / F.lit(12.0))


def season_upper(season) -> Column:
    """Season text normalised: upper case, '_' read as space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(_c(season)), "_", " "))


def season_num(season) -> Column:
    """WINTER 1, SUMMER 2, MONSOON 3, POST MONSOON 4 (three spellings)."""
    pairs = []
    for k, v in FV.SEASON_CODES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), season_upper(season)).cast("int")


def season_from_month(m) -> Column:
    """state-independent season number of a month."""
    m = _c(m)
    expr = None
    for month, code in FV.MONTH_ONLY_SEASON.items():
        cond = m == F.lit(month)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit(FV.MONTH_ONLY_SEASON_DEFAULT)).cast("int")


def log1p_clipped(t) -> Column:
    """ln(1 + max(t, 0)); null stays null."""
    t = _c(t)
    return F.when(t.isNotNull(), F.log1p(F.greatest(t, F.lit(0.0))))


def month_add(m, i) -> Column:
    """F8: ((m-1+i) mod 12) + 1."""
    return (F.pmod(_c(m) - 1 + _c(i), F.lit(12)) + 1).cast("int")
