"""Typed predicates; columns that a table lacks are left out, as listings over several schemas need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals(df: DataFrame, **values) -> Column:
    """Equality on each column that ``df`` has and whose value isn't None; a sequence means one of it."""
    return all_of(*[F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in values.items() if v is not None and k in df.columns])


def differs(df: DataFrame, **values) -> Column:
    """Inequality on each column that ``df`` has; a missing value differs from none."""
    return all_of(*[F.col(k) != F.lit(v) for k, v in values.items() if v is not None and k in df.columns])


def below(df: DataFrame, **values) -> Column:
    """Values under a bound on each column that ``df`` has."""
    return all_of(*[F.col(k) < F.lit(v) for k, v in values.items() if v is not None and k in df.columns])


def starts_with(column: str, text: str | None) -> Column | None:
    """A prefix, with nothing in ``text`` being special."""
    return F.startswith(F.col(column), F.lit(text)) if text else None


def holds_text(column: str, text: str | None) -> Column | None:
    """Case-blind substring, with nothing in ``text`` being special."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text))) if text else None


def current(df: DataFrame) -> Column:
    """Rows that are current, where the table tells."""
    return F.coalesce(F.col("is_current"), F.lit(True)) if "is_current" in df.columns else F.lit(True)
