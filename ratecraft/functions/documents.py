"""Text that was meant to be JSON or a Python dictionary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratecraft.functions.text import col, strip


def repair_json(c: Column | str) -> Column:
    """Model output as JSON text: code fences and trailing commas removed."""
    text = F.regexp_replace(col(c), r"(?i)^```json\s*", "")
    text = F.regexp_replace(text, r"^```\s*", "")
    text = strip(F.regexp_replace(text, r"\s*```$", ""))
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def json_fields(c: Column | str) -> Column:
    """Top-level fields as text; NULL where the repaired text is still no object."""
    return F.from_json(repair_json(c), "map<string,string>", {"mode": "PERMISSIVE"})


def search_params(details: Column | str) -> Column:
    """Parameters a points-search log line carries, list values reduced to their first element.

    The line holds ``Eligibility Check Parameters: {'product': ['TW'], ...}``. Quotes are read pairwise, so a value
    may hold the other kind of quote.
    """
    text = F.replace(F.coalesce(col(details), F.lit("")), F.lit("Eligibility Check Parameters: "), F.lit(""))
    entry = r"""(?s)('[^']*'|"[^"]*")\s*:\s*(?:\[\s*)?('[^']*'|"[^"]*"|None|True|False|-?[0-9.]+|\])"""
    keys = F.regexp_extract_all(text, F.lit(entry), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(entry), F.lit(2))

    def unquote(v: Column) -> Column:
        return F.when(v.rlike("""^['"]"""), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(
            F.when(v == "]", F.lit("[]")).otherwise(v)
        )

    pairs = F.arrays_zip(F.transform(keys, unquote).alias("k"), F.transform(values, unquote).alias("v"))
    last_wins = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: ~F.exists(
            F.slice(F.transform(keys, unquote), p["i"] + 2, F.size(keys)), lambda k: k == p["k"]
        ),
    )
    return F.map_from_entries(F.transform(last_wins, lambda p: F.struct(p["k"], p["v"])))
