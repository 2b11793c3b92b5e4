"""Column expressions shared by the operators.

All of these are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen.  Each has a twin SQL spelling in
``pulsewatch.plans.oracle`` used for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` as DOUBLE, NULL when ``den`` is 0 or NULL (ANSI-safe)."""
    den = col(den)
    return F.when(den != 0, col(num).cast("double") / den.cast("double"))


def exact_std(n, s1, s2) -> Column:
    """Sample std from count, sum and sum of squares of an integer series.

    ``sqrt((n*s2 - s1^2) / (n*(n-1)))`` with the numerator formed exactly in
    DECIMAL(38,0), so the result has one rounding step and no cancellation:
    the same bits in every engine and no overflow at large counts.
    NULL when ``n < 2``.
    """
    n, s1, s2 = col(n), col(s1), col(s2)
    d = "decimal(38,0)"
    num = n.cast(d) * s2.cast(d) - s1.cast(d) * s1.cast(d)
    den = n.cast("double") * (n - 1).cast("double")
    return F.when(n >= 2, F.sqrt(num.cast("double") / den))


def sum_sq(c) -> Column:
    """Sum-of-squares input for :func:`exact_std` (exact for BIGINT counts)."""
    v = col(c).cast("decimal(38,0)")
    return v * v


def row_std(cols: Sequence[str | Column]) -> Column:
    """Sample std across columns of one row (n-1 denominator), closed form."""
    cs = [col(c).cast("double") for c in cols]
    n = float(len(cs))
    mean = sum(cs[1:], cs[0]) / F.lit(n)
    sq = [(c - mean) * (c - mean) for c in cs]
    return F.sqrt(sum(sq[1:], sq[0]) / F.lit(n - 1.0))


def round_half_up(c, digits: int) -> Column:
    """Half-up rounding done in binary arithmetic: ``floor(x*10^d + 0.5)/10^d``.

    Written out so that every engine performs the same IEEE operations.
    """
    scale = float(10 ** digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fmt1(c) -> Column:
    """``%.1f`` text of a value rounded half-up to one decimal."""
    return F.format_string("%.1f", round_half_up(c, 1))


def flag_list(pairs: Iterable[tuple[Column, str]], sep: str = ", ") -> Column:
    """Comma-joined labels of the true flags, in the given order."""
    items = [F.when(cond, F.lit(label)) for cond, label in pairs]
    return F.array_join(F.array_compact(F.array(*items)), sep)


def flag(c) -> Column:
    """NULL-safe boolean: NULL comparisons count as false."""
    return F.coalesce(col(c), F.lit(False))


def as_int(c) -> Column:
    return flag(c).cast("int")
