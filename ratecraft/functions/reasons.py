"""Failure texts: composing them, and reading them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions.text import col, none_if_empty, squash_whitespace, strip


def segment(label: Column, detail: Column) -> Column:
    return F.concat(label, F.lit(" — "), detail)


def failed_on(segments: Column) -> Column:
    """``Failed on: a — d | Also failed on: b — e`` from an array of segments, NULLs left out."""
    kept = F.array_compact(segments)
    prefixed = F.transform(
        kept, lambda s, i: F.concat(F.when(i == 0, F.lit(K.FAILED_ON)).otherwise(F.lit(K.ALSO_FAILED_ON)), s)
    )
    return F.array_join(prefixed, K.SEGMENT_SEPARATOR)


def bad_data_reason(errors: Column, segments: Column) -> Column:
    """Data errors first, then every failed rule."""
    also = F.transform(F.array_compact(segments), lambda s: F.concat(F.lit(K.ALSO_FAILED_ON), s))
    return F.array_join(F.concat(F.array_compact(errors), also), K.SEGMENT_SEPARATOR)


def split_failed_on(reason: Column | str) -> Column:
    """The (label, detail) pairs of a stored text; empty where it has another shape."""
    parts = F.split(F.coalesce(col(reason), F.lit("")), r" \| Also failed on: ")
    head = r"^Failed on:\s*([^—]+)—\s*(.*)$"

    def pair(part: Column, i: Column) -> Column:
        dash = F.instr(part, "—")
        label = F.when(dash > 0, F.substring_index(part, "—", 1)).otherwise(part)
        detail = F.when(dash > 0, F.substr(part, dash + 1)).otherwise(F.lit(""))
        return F.struct(
            strip(F.when(i == 0, F.regexp_extract(part, head, 1)).otherwise(label)).alias("label"),
            strip(F.when(i == 0, F.regexp_extract(part, head, 2)).otherwise(detail)).alias("detail"),
        )

    empty = F.array().cast("array<struct<label:string,detail:string>>")
    return F.when(F.get(parts, 0).rlike(head), F.transform(parts, pair)).otherwise(empty)


def gap_key(detail: Column | str) -> Column:
    """What has to be added to close a gap: the first quoted value, else the whole sentence."""
    d = col(detail)
    quoted = none_if_empty(strip(F.regexp_extract(d, r"'([^']*)'", 1)))
    return F.coalesce(quoted, strip(d))


def shown_gap(detail: Column | str) -> Column:
    """A gap's key as a list shows it: whole sentences are cut, quoted values are not."""
    d = col(detail)
    quoted = none_if_empty(strip(F.regexp_extract(d, r"'([^']*)'", 1)))
    return F.coalesce(quoted, strip(F.substring(d, 1, K.GAP_SHOWN_CHARS)))


def group_id_text(reason: Column | str) -> Column:
    return none_if_empty(F.regexp_extract(col(reason), r"Matching Group IDs:\s*(.*)$", 1))


def group_ids(reason: Column | str) -> Column:
    """Group ids a multi-match text lists; the ``(+N more)`` tail is not one."""
    head = F.get(F.split(F.coalesce(group_id_text(reason), F.lit("")), "…"), 0)
    return F.regexp_extract_all(head, F.lit(r"\d+"), F.lit(0)).cast("array<bigint>")


def unresolved_make_value(reason: Column | str) -> Column:
    """The make/model no cluster lists, out of a failure text; NULL for every other text."""
    prefix = f"{K.FAILED_ON}{K.MAKE_MODEL_LABEL} — {K.UNRESOLVED_MAKE_PREFIX}"
    pattern = rf"^\Q{prefix}\E(.*?)\Q{K.UNRESOLVED_MAKE_SUFFIX}\E"
    return none_if_empty(squash_whitespace(F.regexp_extract(col(reason), pattern, 1)))


def normalized_payload(payload: Column | str) -> Column:
    """Payload map keyed by trimmed lower-case header, NULL cells dropped."""
    kept = F.map_filter(col(payload), lambda k, v: v.isNotNull())
    clean = F.transform_values(kept, lambda k, v: strip(v))
    return F.transform_keys(clean, lambda k, v: F.lower(strip(k)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it may name many times: the value is worked out once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def payload_summary(payload: Column | str) -> Column:
    """(summary, rest): up to three identifying entries by key fragment, else the first three, then the others."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    filled = F.filter(F.map_entries(col(payload)), lambda e: e["value"].isNotNull() & (e["value"] != ""))

    def named(entries: Column) -> Column:
        def take(picked: Column, fragment: Column) -> Column:
            hits = F.filter(entries, lambda e: F.contains(F.lower(strip(e["key"])), fragment) & ~F.array_contains(picked, e))
            more = F.coalesce(F.slice(hits, 1, 1), none)
            return F.when(F.size(picked) < K.SUMMARY_LIMIT, F.concat(picked, more)).otherwise(picked)

        return F.aggregate(F.array(*[F.lit(f) for f in K.SUMMARY_KEYS]), none, take)

    def shown(entries: Column) -> Column:
        return _bound(named(entries), lambda picked: F.when(F.size(picked) > 0, picked).otherwise(F.slice(entries, 1, K.SUMMARY_LIMIT)))

    return _bound(filled, lambda entries: _bound(
        shown(entries), lambda summary: F.struct(summary.alias("summary"), F.array_except(entries, summary).alias("rest"))))
