"""Number parsing and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions.text import col, is_missing, lowered, present, strip


def clean_amount(c: Column | str) -> Column:
    """A premium cell: blank and the null words are 0, stray characters go, anything else unreadable is NULL."""
    zero = is_missing(c) | lowered(c).isin(*K.AMOUNT_NULL_WORDS)
    return F.when(zero, F.lit(0.0)).otherwise(F.regexp_replace(strip(c), r"[^0-9.\-]", "").try_cast("double"))


def digits_number(c: Column | str) -> Column:
    """The digits and dots of a cell as a number, NULL where they do not make one."""
    return F.regexp_replace(present(c), r"[^0-9.]", "").try_cast("double")


def plain_number(c: Column | str) -> Column:
    return present(c).try_cast("double")


def parse_number(c: Column | str) -> Column:
    """Grid number: thousands commas go, a lone dash is 0."""
    text = strip(c)
    return F.when(text.rlike("^-+$"), F.lit(0.0)).otherwise(F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def parse_percent(c: Column | str) -> Column:
    return strip(F.regexp_replace(strip(c), "%+$", "")).try_cast("double")


def safe_decimal(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"[^\d.\-]", "").try_cast("decimal(12,2)")


def number_text(c: Column | str) -> Column:
    """A double as a failure text quotes it: ``150.0``, ``16.08``, ``nan`` for NULL."""
    v = col(c)
    whole = F.concat(v.cast("decimal(20,0)").cast("string"), F.lit(".0"))
    long_form = F.regexp_replace(v.cast("decimal(28,8)").cast("string"), "0+$", "")
    return (
        F.when(v.isNull(), F.lit("nan"))
        .when((v == F.floor(v)) & (F.abs(v) < 1e16), whole)
        .when(F.abs(v) < 1e7, v.cast("string"))
        .otherwise(long_form)
    )


def whole_text(c: Column | str) -> Column:
    return col(c).cast("bigint").cast("string")


def trimmed_number_text(c: Column | str) -> Column:
    """``12.0`` as ``12`` and ``12.5`` as ``12.5``; NULL as ``0``."""
    v = F.coalesce(col(c), F.lit(0.0))
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def amount_text(c: Column | str) -> Column:
    """``6725.88`` as ``6,725.88`` and ``4151`` as ``4,151``."""
    return F.regexp_replace(F.regexp_replace(F.format_number(col(c), 2), "0+$", ""), r"\.$", "")


def round_rate(c: Column | str) -> Column:
    return F.bround(col(c), 2)


def in_range(value: Column, low: Column, high: Column, low_open: bool = False) -> Column:
    """``value`` inside ``[low, high]`` (or ``(low, high]``); a NULL bound is open.

    A missing value passes only where both bounds are open.
    """
    above = low.isNull() | ((low < value) if low_open else (low <= value))
    below = high.isNull() | (high >= value)
    return F.when(value.isNull(), low.isNull() & high.isNull()).otherwise(above & below)
