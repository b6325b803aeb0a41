"""Dates in the handful of formats policy files, grids and documents use."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ratecraft.functions.text import col, is_missing, present

POLICY_FILE_FORMATS = [
    "d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy-M-d H:m:s", "d-M-yyyy H:m:s", "d/M/yyyy H:m:s", "d MMM yyyy",
    "d MMMM yyyy",
]
GRID_FORMATS = ["d/M/yyyy", "yyyy-M-d"]
DOCUMENT_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yy", "d-M-yy", "d MMM yyyy", "d MMMM yyyy"]


_SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}"}


def _shape(pattern: str) -> str:
    """What text of a format looks like. A cheap test: a parser that fails costs an exception per row and format."""
    return "^" + re.sub(r"y+|M+|[dHms]", lambda m: _SHAPES.get(m.group(), r"\d{1,2}"), pattern) + "$"


def parse_date(c: Column | str, formats: list[str]) -> Column:
    """The first format that reads the cell wins; NULL where none does. Two-digit years pivot at 69."""
    text = present(c)
    parsed = []
    for pattern in formats:
        day = F.when(text.rlike(_shape(pattern)), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
        if pattern.endswith("/yy") or pattern.endswith("-yy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        parsed.append(day)
    return F.coalesce(*parsed)


def policy_date(c: Column | str) -> Column:
    """Day-first, with ISO text read as ISO."""
    return parse_date(c, POLICY_FILE_FORMATS)


def upload_date(c: Column | str) -> Column:
    return parse_date(c, ["d/M/yyyy"])


def grid_date(c: Column | str) -> Column:
    return parse_date(c, GRID_FORMATS)


def document_date(c: Column | str) -> Column:
    return parse_date(c, DOCUMENT_FORMATS)


def extract_year(c: Column | str) -> Column:
    """First calendar year 1900-2099 that stands on its own in the cell."""
    return F.regexp_extract(col(c), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")


def vehicle_age(registration: Column, inception: Column, is_new: Column, run_year: int) -> Column:
    """Run year + 1 - year of registration, or of inception for a new vehicle. Neither clamped nor defaulted."""
    year = F.when(is_new, extract_year(inception)).otherwise(extract_year(registration))
    return (F.lit(run_year + 1) - year).cast("double")


def tenure_years(inception: Column, expiry: Column) -> Column:
    """Whole policy years, half-even; NULL unless the policy runs for at least a day."""
    days = F.datediff(expiry, inception)
    return F.when(days > 0, F.bround(days / F.lit(365.25), 0).cast("int"))


def decimal_age(target: Column, made_year: Column) -> Column:
    """Age on ``target`` of a vehicle made on 1 January of ``made_year``."""
    return F.bround(F.datediff(target, F.make_date(made_year, F.lit(1), F.lit(1))) / F.lit(365.25), 2)


def valid_on(day: Column, start: Column | str = "from_date", end: Column | str = "to_date") -> Column:
    start, end = col(start), col(end)
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


def windows_overlap(first: Column, last: Column, start: Column | str = "from_date", end: Column | str = "to_date") -> Column:
    start, end = col(start), col(end)
    return (start.isNull() | (start <= last)) & (end.isNull() | (end >= first))


__all__ = [
    "decimal_age", "document_date", "extract_year", "grid_date", "is_missing", "parse_date", "policy_date",
    "tenure_years", "upload_date", "valid_on", "vehicle_age", "windows_overlap",
]
