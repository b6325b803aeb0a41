"""Text normalisers. Everything here is a built-in expression, so it stays inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ratecraft import constants as K

_BLANKS = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def literal_lookup(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """A small fixed dictionary as an expression, with the key itself or ``default`` where it has no entry."""
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[key], key if default is None else default)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value it uses several times, without writing the value's expression out each time."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(_BLANKS))


def lowered(c: Column | str) -> Column:
    return F.lower(strip(c))


def is_missing(c: Column | str) -> Column:
    """A blank cell, or the literal text ``nan`` an export wrote for one."""
    return col(c).isNull() | lowered(c).isin("", "nan")


def present(c: Column | str) -> Column:
    """The stripped cell, NULL where it is missing."""
    return F.when(~is_missing(c), strip(c))


def norm_text(c: Column | str) -> Column:
    return lowered(F.coalesce(col(c), F.lit("")))


def norm_code(c: Column | str) -> Column:
    """YES / NO / NA with blank as NA."""
    text = F.upper(strip(F.coalesce(col(c), F.lit(""))))
    return F.when(text == "", F.lit("NA")).otherwise(text)


def squash_whitespace(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_yes_no_na(c: Column | str) -> Column:
    text = lowered(c)
    return (
        F.when(text.isin("yes", "y", "true", "1"), F.lit("YES"))
        .when(text.isin("no", "n", "false", "0"), F.lit("NO"))
        .otherwise(F.lit("NA"))
    )


def nil_dep_class(c: Column | str) -> Column:
    """YES / NO for the spellings of the nil-dep cell, NULL for anything else."""
    text = F.upper(strip(c))
    return F.when(text.isin("1", "YES", "Y", "TRUE"), F.lit("YES")).when(
        text.isin("0", "NO", "N", "FALSE"), F.lit("NO")
    )


def normalize_rto_code(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(present(c), F.lit("")), r"[\s\-]", ""), 1, 4)


def normalize_pincode(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(present(c), F.lit("")), r"\.0$", "")


def normalize_plan_name(c: Column | str) -> Column:
    text = F.replace(lowered(c), F.lit("+"), F.lit(" plus"))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\s]", " "), r"\s+", " "))


def fold_business_type(c: Column | str) -> Column:
    key = strip(F.regexp_replace(lowered(c), r"[\s_\-]+", " "))
    return literal_lookup(K.BUSINESS_TYPE_SYNONYMS, key)


def words(c: Column) -> Column:
    """Distinct whitespace-separated words."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def model_words(c: Column | str) -> Column:
    """Words of a make/model text: hyphens split, and a number glued to a word is its own word."""
    spaced = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "-", " ")
    return words(F.regexp_replace(spaced, r"(?<=[A-Za-z])(?=\d)", " "))


def insurer_key_tokens(c: Column | str) -> Column:
    """The words that tell insurers apart."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_except(words(plain), literal_array(K.INSURER_STOP_WORDS))


def file_name_words(c: Column | str) -> Column:
    base = F.element_at(F.split(F.lower(col(c)), "/"), -1)
    return F.array_distinct(F.regexp_extract_all(base, F.lit(r"[a-z0-9]+"), F.lit(0)))


def is_combined_cc_gvw(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"\d+\s*/\s*\d+"), F.lit(False))


def product_classes(product: Column | str) -> Column:
    """The class list an NA class stands for under a product; NULL for a product without one."""
    return literal_lookup(K.PRODUCT_CLASSES, F.upper(strip(product)), F.lit(None).cast("string"))


def display_class(vehicle_class: Column | str, product: Column | str) -> Column:
    shown = strip(F.coalesce(col(vehicle_class), F.lit("NA")))
    return F.when(F.upper(shown).isin("NA", ""), F.coalesce(product_classes(product), F.lit("NA"))).otherwise(
        col(vehicle_class)
    )


def month_token(c: Column | str) -> Column:
    """``APR26`` out of a cluster label, ``EVERGREEN`` where it carries no month."""
    found = F.regexp_extract(F.upper(col(c)), "(" + "|".join(K.MONTH_NAMES) + r")(\d{2})", 0)
    return F.when(found == "", F.lit(K.EVERGREEN)).otherwise(found)


def month_label(code: Column | str) -> Column:
    c = col(code)
    month = F.substring(c, 1, 3)
    return F.when(c == K.EVERGREEN, F.lit("No specific month")).otherwise(
        F.concat(literal_lookup(K.MONTH_NAMES, month), F.lit(" 20"), F.substring(c, 4, 10))
    )


def month_order(code: Column | str) -> Column:
    """Sort key of a month token: year, then month, evergreen last."""
    c = col(code)
    position = F.array_position(literal_array(list(K.MONTH_NAMES)), F.substring(c, 1, 3))
    return F.when(c == K.EVERGREEN, F.lit(999999)).otherwise(
        F.substring(c, 4, 2).try_cast("int") * 100 + position.cast("int")
    )


def state_code(c: Column | str) -> Column:
    """State of a raw registration code, NULL where the first two characters are not letters."""
    head = F.upper(F.substring(strip(c), 1, 2))
    return F.when(head.rlike("^[A-Z]{2}$"), literal_lookup(K.STATE_ALIASES, head))


def word_match(text: Column, term: Column) -> Column:
    """``term`` occurs in ``text`` with no letter or digit on either side; both are upper case."""
    pattern = F.concat(F.lit(r"(?<![A-Z0-9])\Q"), term, F.lit(r"\E(?![A-Z0-9])"))
    return F.rlike(text, pattern)
