"""Comma-separated cluster lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions.text import col, lowered, strip


def split_list(c: Column | str) -> Column:
    """Items as written, stripped, blanks dropped; order and duplicates kept."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def cluster_items(c: Column | str) -> Column:
    """Distinct lower-case items, sorted so that equal lists are equal arrays."""
    return F.array_sort(F.array_distinct(F.transform(split_list(c), lambda x: F.lower(x))))


def upper_items(c: Column | str) -> Column:
    return F.array_distinct(F.transform(split_list(c), lambda x: F.upper(x)))


def alnum_tokens(c: Column) -> Column:
    """Distinct runs of A-Z and 0-9 of an upper-case text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z0-9]+"), F.lit(0)))


def unique_join(items: Column) -> Column:
    """Distinct ignoring case, the first spelling wins, joined with a comma and a blank."""
    kept = F.filter(F.transform(F.array_compact(items), strip), lambda x: x != "")
    folded = F.transform(kept, lambda x: F.lower(x))
    first = F.filter(kept, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)
    return F.array_join(first, ", ")


def cluster_preview(items: Column, blank: str = "(blank)") -> Column:
    """``a, b, c +14 more``: at most eight items and about eighty characters, but always the first item."""
    ordered = F.array_sort(items)
    start = F.struct(F.lit(0).alias("shown"), F.lit(0).alias("chars"), F.lit(False).alias("full"))

    def step(acc: Column, item: Column) -> Column:
        chars = acc["chars"] + F.length(item) + 2
        full = acc["full"] | ((acc["shown"] > 0) & (chars > K.CLUSTER_PREVIEW_CHARS))
        return F.struct(
            F.when(full, acc["shown"]).otherwise(acc["shown"] + 1).alias("shown"),
            F.when(full, acc["chars"]).otherwise(chars).alias("chars"),
            full.alias("full"),
        )

    shown = F.aggregate(F.slice(ordered, 1, K.CLUSTER_PREVIEW_ITEMS), start, step, lambda acc: acc["shown"])
    text = F.array_join(F.slice(ordered, F.lit(1), shown), ", ")
    rest = F.size(ordered) - shown
    return (
        F.when(F.size(ordered) == 0, F.lit(blank))
        .when(rest > 0, F.concat(text, F.lit(" +"), rest.cast("string"), F.lit(" more")))
        .otherwise(text)
    )


def contains_text(c: Column | str, needle: Column | str) -> Column:
    """Case-insensitive substring."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lower(needle))


def has_item(c: Column | str, names: Column) -> Column:
    """The list lists one of ``names`` (an array of lower-case names)."""
    return F.arrays_overlap(cluster_items(c), names)


__all__ = [
    "alnum_tokens", "cluster_items", "cluster_preview", "contains_text", "has_item", "lowered", "split_list",
    "unique_join", "upper_items",
]
