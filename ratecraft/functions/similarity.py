"""String similarity, 0-100, for pairs of distinct values.

Spark has no indel-based ratio. ``ratio``, ``token_sort_ratio`` and ``token_set_ratio`` are column expressions over a bit-parallel
longest common subsequence; the weighted score of insurer names, a maximum over windows, is an Arrow-batched pandas UDF, applied to
candidate pairs of *distinct* names only (see ``ratecraft.operators.resolve``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ratecraft.functions.text import let

WORD = 62
_ALL = (1 << WORD) - 1


# ---- column expressions ---------------------------------------------------------------------------
def _letters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _masks(letters: Column) -> Column:
    """For each letter the places it stands at, as words of 62 bits."""
    starts = F.sequence(F.lit(1), F.size(letters), F.lit(WORD))

    def word(letter: Column, start: Column) -> Column:
        bits = F.transform(F.slice(letters, start, F.lit(WORD)), lambda x, i: F.when(x == letter, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0)))
        return F.aggregate(bits, _long(0), lambda acc, bit: acc.bitwiseOR(bit))

    distinct = F.array_distinct(letters)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda letter: F.transform(starts, lambda start: word(letter, start))))


def _next(row: Column, masks: Column) -> Column:
    """The recurrence for one letter: words are added with carry."""
    start = F.struct(F.array().cast("array<bigint>").alias("words"), _long(0).alias("carry"))

    def step(acc: Column, own: Column, i: Column) -> Column:
        return let(own.bitwiseAND(F.get(masks, i)), lambda hit: let(own + hit + acc["carry"], lambda total: F.struct(
            F.concat(acc["words"], F.array(total.bitwiseAND(_long(_ALL)).bitwiseOR(own - hit))).alias("words"),
            F.shiftright(total, WORD).alias("carry"))))

    numbered = F.transform(row, lambda own, i: F.struct(own.alias("own"), i.alias("i")))
    return F.aggregate(numbered, start, lambda acc, x: step(acc, x["own"], x["i"]), lambda acc: acc["words"])


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    def over(own: Column) -> Column:
        first = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(WORD)), lambda _: _long(_ALL))
        rows = let(_masks(own), lambda masks: F.aggregate(
            _letters(b), first, lambda row, letter: let(F.try_element_at(masks, letter), lambda found: F.when(found.isNull(), row).otherwise(_next(row, found)))))
        return F.aggregate(rows, F.lit(0), lambda n, row: n + F.bit_count(F.bitwise_not(row).bitwiseAND(_long(_ALL))))

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(let(_letters(a), over))


def _share(distance: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(100.0) * (F.lit(1.0) - distance / total))


def ratio(a: Column, b: Column) -> Column:
    """Share of letters that need no insertion or deletion."""
    total = F.length(a) + F.length(b)
    return let(total, lambda t: _share(t - 2 * common_length(a, b), t))


def _sorted_words(c: Column) -> Column:
    return F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """``ratio`` of the words in order."""
    return let(F.struct(F.array_join(_sorted_words(a), " ").alias("a"), F.array_join(_sorted_words(b), " ").alias("b")), lambda x: ratio(x["a"], x["b"]))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of three comparisons: shared words with either text's distinct words, and both texts' with each other."""
    words = F.struct(F.array_distinct(_sorted_words(a)).alias("a"), F.array_distinct(_sorted_words(b)).alias("b"))

    def parts(w: Column) -> Column:
        join = lambda x: F.array_join(x, " ")
        return F.struct(
            F.least(F.size(w["a"]), F.size(w["b"])).alias("least"), F.length(join(F.array_intersect(w["a"], w["b"]))).alias("base"),
            join(F.array_except(w["a"], w["b"])).alias("a"), join(F.array_except(w["b"], w["a"])).alias("b"))

    def best(p: Column) -> Column:
        gap = F.when(p["base"] > 0, 1).otherwise(0)
        left, right = p["base"] + gap + F.length(p["a"]), p["base"] + gap + F.length(p["b"])
        differing = F.length(p["a"]) + F.length(p["b"]) - 2 * common_length(p["a"], p["b"])
        whole = _share(differing, left + right)
        with_shared = F.greatest(whole, _share(gap + F.length(p["a"]), p["base"] + left), _share(gap + F.length(p["b"]), p["base"] + right))
        return (
            F.when(p["least"] == 0, F.lit(0.0))
            .when((p["base"] > 0) & ((p["a"] == "") | (p["b"] == "")), F.lit(100.0))
            .when(p["base"] > 0, with_shared).otherwise(whole)
        )

    return let(words, lambda w: let(parts(w), best))


# ---- by pair --------------------------------------------------------------------------------------

def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bit-parallel recurrence over ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    everything = (1 << len(a)) - 1
    row = everything
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & everything
    return len(a) - row.bit_count()


def _scaled(distance: float, total: int) -> float:
    return 100.0 if total == 0 else 100.0 * (1 - distance / total)


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return _scaled(total - 2 * _common(a, b), total)


def _token_sort(a: str, b: str) -> float:
    return _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = sorted(left & right)
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (only_left and only_right):
        return 100.0
    base = len(" ".join(shared))
    gap = 1 if base else 0
    size_left, size_right = base + gap + len(only_left), base + gap + len(only_right)
    differing = len(only_left) + len(only_right) - 2 * _common(only_left, only_right)
    best = _scaled(differing, size_left + size_right)
    if base:
        best = max(
            best,
            _scaled(gap + len(only_left), base + size_left),
            _scaled(gap + len(only_right), base + size_right),
        )
    return best


def _windows(short: str, long: str) -> float:
    width, letters, best = len(short), set(short), 0.0
    spans = [(0, end) for end in range(1, width)]
    spans += [(start, start + width) for start in range(len(long) - width + 1)]
    spans += [(start, len(long)) for start in range(len(long) - width + 1, len(long))]
    for start, end in spans:
        edge = long[end - 1] if end - start == width or start == 0 else long[start]
        if edge in letters:
            best = max(best, _ratio(short, long[start:end]))
            if best == 100.0:
                break
    return best


def _partial(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _windows(short, long)
    if len(a) == len(b) and best < 100.0:
        best = max(best, _windows(long, short))
    return best


def _partial_token(a: str, b: str) -> float:
    left, right = a.split(), b.split()
    if set(left) & set(right):
        return 100.0
    return _partial(" ".join(sorted(left)), " ".join(sorted(right)))


def _weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = _ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(_token_sort(a, b), _token_set(a, b)))
    scale = 0.9 if spread < 8 else 0.6
    return max(best, scale * _partial(a, b), 0.95 * scale * _partial_token(a, b))


_SCORERS = {
    "ratio": _ratio,
    "token_sort_ratio": _token_sort,
    "token_set_ratio": _token_set,
    "partial_ratio": _partial,
    "weighted_ratio": _weighted,
}


def score(name: str, a: str, b: str) -> float:
    """One pair, for tests."""
    return _SCORERS[name](a, b)


def similarity(name: str, a: Column, b: Column) -> Column:
    scorer = _SCORERS[name]

    @F.pandas_udf("double")
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or y is None else scorer(x, y) for x, y in zip(left, right)], dtype="float64"
        )

    return scored(a, b)
