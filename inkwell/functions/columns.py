"""Column-level helpers built only from ``pyspark.sql.functions`` (JVM-side,
inside whole-stage codegen)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed evaluation date used instead of CURRENT_DATE so results are
# reproducible (the source ship dates run to 2001-11-04).
DEFAULT_AS_OF = _dt.date(2001, 8, 1)

# Money columns carry at most 4 decimals (price x (1 - discount)); summing
# them as DECIMAL makes totals exact and independent of summation order.
MONEY = "decimal(18,4)"
# Unit prices (price / quantity, quantity <= 50) terminate within 7 decimals
# or are far from a rounding tie, so 8 decimals convert identically everywhere.
UNIT = "decimal(18,8)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of: _dt.date | str | None = None) -> Column:
    value = as_of or DEFAULT_AS_OF
    return F.lit(str(value)).cast("date")


def band(value: Column, cuts: Sequence[tuple[Column, str]], default: str) -> Column:
    """CASE WHEN chain: the first matching condition wins."""
    expr = None
    for cond, label in cuts:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def flag(cond: Column) -> Column:
    """Boolean that is false (not NULL) when the condition is NULL."""
    return F.when(cond, F.lit(True)).otherwise(F.lit(False))


def exact_sum(c: str | Column, dtype: str = MONEY) -> Column:
    """Order-independent sum of a money column, returned as DOUBLE."""
    return F.sum(col(c).cast(dtype)).cast("double")


def exact_avg(c: str | Column, dtype: str = MONEY) -> Column:
    """Mean computed from the exact sum (NULL for an empty group)."""
    x = col(c)
    return F.sum(x.cast(dtype)).cast("double") / F.count(x)


def safe_division(numerator: str | Column, denominator: str | Column, default: float = 0.0) -> Column:
    """n / d, or ``default`` when d is 0 (a NULL numerator stays NULL)."""
    n, d = col(numerator), col(denominator)
    return F.when(d == 0, F.lit(default)).otherwise(n / d)


def pct_change(current: Column, base: Column) -> Column:
    """100 * (current - base) / base when base is positive, else NULL."""
    return F.when(base.isNotNull() & (base > 0), (current - base) / base * 100)


def sql_day_of_week(d: Column) -> Column:
    """SQL EXTRACT(DOW): Sunday = 0 .. Saturday = 6."""
    return (F.dayofweek(d) - 1).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def since(df, as_of=None, days: int = 30, date_col: str = "sale_date", year_col: str = "sale_year"):
    """Rows dated on or after ``as_of - days``. When the frame carries the
    year partition column, the same bound is also stated on it, so a table
    partitioned by year skips whole folders (Spark does not derive that
    from the date predicate)."""
    cutoff = F.date_sub(as_of_lit(as_of), days)
    out = df.where(F.col(date_col) >= cutoff)
    if year_col in df.columns:
        out = out.where(F.col(year_col) >= F.year(cutoff))
    return out
