"""Scalar expressions used by panels and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6  # fixed value: clip for probabilities and empty bins


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    return as_col(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    return as_col(c).try_cast("int")


def to_date(c: Column | str) -> Column:
    return as_col(c).try_cast("date")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero."""
    return num / F.nullif(den, F.lit(0.0))


def log_amount(c: Column) -> Column:
    return F.log(F.nullif(c, F.lit(0.0)))


def code_prefix(c: Column | str, n: int = 2) -> Column:
    return F.substring(F.trim(as_col(c)), 1, n)


def presence_flag(c: Column | str) -> Column:
    return F.when(F.coalesce(F.trim(as_col(c)), F.lit("")) != "", 1).otherwise(0)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(cond, 1).otherwise(0)


def band(c: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first cut that is above the value; the last label is the rest."""
    out = F.when(c < F.lit(cuts[0]), labels[0])
    for cut, label in zip(cuts[1:], labels[1:], strict=False):
        out = out.when(c < F.lit(cut), label)
    return out.otherwise(labels[-1])


def lookup(c: Column | str, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table, null for keys it does not hold."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[as_col(c)]


def calendar_months(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed, whatever the day of month."""
    s, e = as_col(start), as_col(end)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def clip01(c: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column) -> Column:
    q = clip01(p)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null, so that JSON stays valid."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def bin_left_closed(x: Column, inner: Column) -> Column:
    """Bin number when bins are [a, b): how many inner edges are <= x."""
    return F.size(F.filter(inner, lambda e: e <= x))


def bin_right_closed(x: Column, inner: Column) -> Column:
    """Bin number when bins are (a, b]: how many inner edges are < x."""
    return F.size(F.filter(inner, lambda e: e < x))


def psi_term(expected: Column, actual: Column, eps: float = EPS) -> Column:
    e, a = F.greatest(expected, F.lit(eps)), F.greatest(actual, F.lit(eps))
    return (a - e) * F.log(a / e)
