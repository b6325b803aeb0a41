"""Labels and names of life payout grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions.text import col, let, lowered, none_if_empty, squash_whitespace, strip


def canonical_type(category: Column | str) -> Column:
    """Plan type behind the many spellings of a category; an unknown category stays as written."""
    text = F.lower(col(category))
    ladder = F.when(col(category).isNull() | (col(category) == ""), F.lit(None).cast("string"))
    for keyword, name in K.LIFE_TYPE_KEYWORDS:
        ladder = ladder.when(F.contains(text, F.lit(keyword)), F.lit(name))
    return ladder.otherwise(col(category))


def _years(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).cast("array<int>")


def renewal_years(label: Column | str) -> Column:
    """Policy years a column label names: struct(year_one_only, years, open_ended).

    ``years`` is NULL where the label names no renewal year and is not open ended either.
    """
    no_years = F.array().cast("array<int>")

    def between(text: Column) -> Column:
        bounds = F.struct(*[
            none_if_empty(F.regexp_extract(text, K.RENEWAL_RANGE_PATTERN, i)).try_cast("int").alias(n)
            for i, n in ((1, "low"), (2, "high"))
        ])
        return let(bounds, lambda b: F.when(
            (b["low"] <= b["high"]) & (b["high"] - b["low"] <= 20),
            F.sequence(b["low"], F.greatest(b["low"], b["high"]))).otherwise(no_years))

    def named(text: Column) -> Column:
        direct = F.array_distinct(F.concat(*[_years(text, p) for p in K.RENEWAL_YEAR_PATTERNS]))
        also = _years(text, K.RENEWAL_ALSO_PATTERN)
        return let(F.array_union(direct, between(text)), lambda y: F.when(F.size(y) > 0, F.array_union(y, also)).otherwise(y))

    def judged(found: Column) -> Column:
        years, open_ended = found["years"], found["open_ended"]
        only_first = (F.size(years) == 1) & F.array_contains(years, F.lit(1)) & ~open_ended
        later = F.array_sort(F.filter(years, lambda y: y != 1))
        unknown = only_first | ((F.size(later) == 0) & ~open_ended)
        return F.struct(
            F.coalesce(only_first, F.lit(False)).alias("year_one_only"),
            F.when(~unknown, later).alias("years"),
            (open_ended & ~only_first).alias("open_ended"),
        )

    def parsed(text: Column) -> Column:
        found = F.struct(named(text).alias("years"), text.rlike(K.RENEWAL_OPEN_PATTERN).alias("open_ended"))
        return let(found, judged)

    return let(F.lower(squash_whitespace(label)), parsed)


def renewal_slots(parsed: Column) -> Column:
    """Slots 0 (year 2) to 4 (year 6 and later) that the parsed years fill, sorted."""
    def slots(p: Column) -> Column:
        years = F.coalesce(p["years"], F.array().cast("array<int>"))
        named = F.transform(F.filter(years, lambda y: y > 1), lambda y: F.least(y - 2, F.lit(4)))
        onwards = F.sequence(F.greatest(F.least(F.array_min(years) - 2, F.lit(4)), F.lit(0)), F.lit(4))
        every = F.when(F.size(years) == 0, F.array(F.lit(4))).otherwise(F.concat(named, onwards))
        return F.array_sort(F.array_distinct(F.when(p["open_ended"], every).otherwise(named)))

    return let(parsed, slots)


def ppt_from_name(name: Column | str) -> Column:
    """Premium paying term inside a product name, NULL where there is none."""
    found = none_if_empty(F.regexp_extract(col(name), K.PPT_PATTERN, 0))
    return strip(F.regexp_replace(found, r"(?i)\s*Pay\s*>?$", ""))


def name_without_ppt(name: Column | str) -> Column:
    raw = col(name)
    found = F.regexp_extract(raw, K.PPT_PATTERN, 0)
    at = F.instr(raw, found)
    rest = strip(F.concat(F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + F.length(found))))
    rest = F.regexp_replace(rest, r"\s{2,}", " ")
    rest = strip(F.regexp_replace(rest, r"^-\s*|\s*-\s*$", ""))
    rest = strip(F.regexp_replace(rest, r"\s*-\s*-\s*", " - "))
    return F.when((found == "") | (rest == ""), raw).otherwise(rest)


def raw_renewals(raw: Column | str, filled_only: bool = False) -> Column:
    """``a: 1; b: 2`` as an array of (label, value)."""
    parts = F.split(F.coalesce(col(raw), F.lit("")), ";")

    def entry(part: Column) -> Column:
        colon = F.instr(part, ":")
        return F.struct(
            strip(F.when(colon > 0, F.substring_index(part, ":", 1)).otherwise(part)).alias("label"),
            strip(F.when(colon > 0, F.substr(part, colon + 1)).otherwise(F.lit(""))).alias("value"),
        )

    entries = F.filter(F.transform(parts, entry), lambda e: e["label"] != "")
    if filled_only:
        entries = F.filter(entries, lambda e: ~e["value"].isin("", "—"))
    return entries


def payout_text(number: Column, text: Column) -> Column:
    """A payout as the grid shows it: a fraction as a percentage, other text unchanged, a dash for nothing."""
    percent = F.floor(number * 100 * 100 + F.lit(0.5)) / 100
    shown = F.when(percent == F.floor(percent), F.format_string("%.1f", percent)).otherwise(percent.cast("string"))
    return F.when(number.isNotNull(), F.concat(shown, F.lit("%"))).otherwise(F.coalesce(text, F.lit("—")))


def matches_search(query: str) -> Column:
    """Any of the seven searched columns contains the query."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    fields = [
        "InsurerDisplay", "Product_Name", "Variant", "Category", "PPT", "Row_Specific_Remarks",
        "Sheet_Level_Notes_And_Conditions",
    ]
    hits = [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(needle)) for f in fields]
    return F.greatest(*hits)


__all__ = [
    "canonical_type", "lowered", "matches_search", "name_without_ppt", "payout_text", "ppt_from_name",
    "raw_renewals", "renewal_slots", "renewal_years",
]
