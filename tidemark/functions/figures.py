"""Ratios and number text (as SQL expression text), and one-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exprs(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def ratio(part: str, whole: str) -> str:
    """Division of doubles. NULL/0 is NULL; any other x/0 raises, whatever the session's ANSI mode."""
    by_zero = f"({whole}) = 0 and ({part}) is not null"
    divided = f"try_divide(double({part}), double({whole}))"
    return f"if({by_zero}, double(raise_error('DIVIDE_BY_ZERO: {whole}')), {divided})"


def ratio_or_zero(part: str, whole: str) -> str:
    """As `ratio`, but 0 where the divisor is 0 or either side is NULL."""
    return f"coalesce(double({part}) / nullif(double({whole}), 0d), 0d)"


def grouped_whole(value: str) -> str:
    """Round half to even and write as PostgreSQL's pattern FM99G999G999G999D does in locale C.

    The pattern has 11 digits; a longer number overflows to `#` in every digit's place. FM drops
    padding but not the decimal point that D asks for: 1234567.5 -> '1,234,568.'.
    """
    whole = f"rint({value})"
    overflow = f"concat(if({whole} < 0, '-', ''), '##,###,###,###.')"
    return f"if(abs({whole}) >= 1e11d, {overflow}, concat(format_number({whole}, 0), '.'))"


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row made of several one-row results with different column names.

    Stacks them and keeps each column's only value, so nothing is cross joined.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.selectExpr(*[f"max({name}) as {name}" for name in stacked.columns])
