"""Search filters as boolean columns. A blank parameter filters nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, text as T
from ratecraft.functions.numbers import in_range
from ratecraft.sources.rates import group_key


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text not in (None, "") else None
    except ValueError:
        return None


def covers(low: str, high: str, value: str | float | None) -> Column:
    """The closed range holds the value; text that is no number filters nothing."""
    number = value if isinstance(value, (int, float)) else _number(value)
    return F.lit(True) if number is None else in_range(F.lit(float(number)), F.col(low), F.col(high))


def range_text(low: str, high: str, text: str | None) -> Column:
    """``a-b`` asks for exactly those bounds, a bare value for a range that holds it; junk is ignored."""
    if not text:
        return F.lit(True)
    if "-" in text:
        parts = [_number(p.strip()) for p in text.split("-")[:2]]
        tests = [F.col(c) == F.lit(v) for c, v in zip((low, high), parts) if v is not None]
        return reduce(lambda a, b: a & b, tests, F.lit(True))
    value = _number(text)
    return F.lit(True) if value is None else (F.col(low) <= value) & (F.col(high) >= value)


def same_text(column: str, value: str | None) -> Column:
    return F.lit(True) if not value else F.lower(F.col(column)) == value.strip().lower()


def id_or_name(id_column: str, name_column: str, value: str | None) -> Column:
    """Digits are an id, anything else a name in any case."""
    if not value:
        return F.lit(True)
    return F.col(id_column) == int(value) if value.isdigit() else same_text(name_column, value)


def code_or_na(column: str, value: str | None) -> Column:
    if not value:
        return F.lit(True)
    return F.upper(F.coalesce(F.col(column), F.lit("NA"))).isin(value.strip().upper(), "NA")


def class_or_na(column: str, value: str | None) -> Column:
    """A class some product's NA stands for also finds NA rows."""
    if not value:
        return F.lit(True)
    wanted = value.strip().lower()
    stand_ins = {c.strip().lower() for classes in K.PRODUCT_CLASSES.values() for c in classes.split(",")}
    return F.lower(F.col(column)).isin(*{wanted, "na"} if wanted in stand_ins else {wanted})


def in_groups(ids: list[int]) -> Column:
    return F.col("group_id").isin(*ids) | (F.col("group_id").isNull() & F.col("id").isin(*ids))


def id_list(text: str) -> list[int]:
    return [int(p.strip()) for p in text.split(",") if p.strip().isdigit()]


def health_text(query: str | None) -> Column:
    """Insurer or plan contains the text; a list of ``h-<id>`` (every token an id) also finds those rows."""
    if not query:
        return F.lit(True)
    tokens = [p.strip() for p in query.split(",") if p.strip()]
    bare = [t[2:] if t[:2].lower() == "h-" else t for t in tokens]
    test = C.contains_text("insurance_company", query) | C.contains_text("plan_names", query)
    if bare and all(t.isdigit() for t in bare):
        test = test | F.col("id").isin(*[int(t) for t in bare])
    return test


def sum_insured(value: str | None) -> Column:
    if value == "above_25L":
        return F.col("max_sum_insured").isNull() | (F.col("max_sum_insured") > K.ABOVE_25_LAKH)
    return covers("min_sum_insured", "max_sum_insured", value)


def made_in(year: str | int | None, target: Column) -> Column:
    """Vehicle-age band holds the decimal age on ``target`` of a vehicle made in that year."""
    if year in (None, "") or not str(year).isdigit():
        return F.lit(True)
    age = D.decimal_age(target, F.lit(int(year)))
    return in_range(age, F.col("vehicle_age_min"), F.col("vehicle_age_max"))


def in_month(column: str, month: str | None) -> Column:
    return F.lit(True) if not month else F.date_format(column, "yyyy-MM") == month


def within_last(column: str, now: Column, days: int = 0, hours: int = 0) -> Column:
    return F.col(column) >= now - F.make_dt_interval(F.lit(days), F.lit(hours))


__all__ = ["T", "class_or_na", "code_or_na", "covers", "group_key", "health_text", "id_list", "id_or_name", "in_groups",
           "in_month", "made_in", "range_text", "same_text", "sum_insured", "within_last"]
