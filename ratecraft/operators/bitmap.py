"""An index of a rate card: keep-on-fail narrowing without meeting policies and rate rows pair by pair.

Rates of an insurer are numbered, and each rule has, for every value a policy may have, the set of offers that pass: names by
the offers that list them, ranges cut at their ends into elementary intervals. Policies that pass the same sets take the same way, so
they are sorted by them and walked as a tree: a branch narrows its rates once for all policies below it, and a rule that would leave
nothing fails and does not narrow. Small branches are finished with bitmaps over the few rates they have left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ratecraft.functions.numbers import in_range
from ratecraft.session import ship_package, stage

SHARD_RATES = 524_288
SLICE_POLICIES = 16_384
#: slices an insurer may have where its policies are no more than its rates
SLICES = 4
#: policies walked together, bytes of a rule's sets, bits of a step and pairs handed on at once
BATCH_POLICIES = 131_072
SET_BYTES = 2**27
STEP_BITS = 2**23
#: rates times policies (sixteen at most) of a branch that is finished at once
BRANCH = 2**16
PAIRS = 2**20
_JOIN = "\x1f"
#: the token of an empty list, and of a blank value that only matches one
EMPTY = "\x00"
#: a token that every row may offer beside its own
ANY = "\x01"


def _ends(low: Column, high: Column) -> Column:
    """Two bounds as text, which is far cheaper to hand to Python than an array; doubles survive it unchanged."""
    return F.concat_ws(_JOIN, *[F.coalesce(b.cast("double").cast("string"), F.lit("nan")) for b in (low, high)])


def _read_ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.array([[float(x) for x in text.split(_JOIN)] for text in texts]).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


@dataclass(frozen=True)
class Tokens:
    """A rate row passes where it offers one of the strings the policy asks for."""

    asked: Column
    offered: Column

    def policy(self) -> Column:
        return F.when(F.size(self.asked) > 0, F.array_join(self.asked, _JOIN))

    def rate(self) -> Column:
        return F.when(F.size(self.offered) > 0, F.array_join(self.offered, _JOIN))

    def holds(self) -> Column:
        return F.arrays_overlap(self.asked, self.offered)


@dataclass(frozen=True)
class Range:
    """A rate row passes where the value lies in its range; see ``numbers.in_range``. NaN passes anywhere."""

    value: Column
    low: Column
    high: Column
    low_open: bool = False

    def policy(self) -> Column:
        return self.value.cast("double").cast("string")

    def rate(self) -> Column:
        return _ends(self.low, self.high)

    def holds(self) -> Column:
        value = self.value.cast("double")
        return F.coalesce(F.isnan(value), F.lit(False)) | in_range(value, self.low, self.high, self.low_open)


@dataclass(frozen=True)
class Span:
    """A row passes where its interval shares a value with the asked one, NULL bounds being open; with ``seams_apart`` bands that
    only touch do not."""

    low: Column
    high: Column
    r_low: Column
    r_high: Column
    seams_apart: bool = False

    def policy(self) -> Column:
        return _ends(self.low, self.high)

    def rate(self) -> Column:
        return _ends(self.r_low, self.r_high)


def one_of(*values: Column | str) -> Column:
    """An array of the values that are not NULL."""
    return F.array_compact(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]))


def list_or_empty(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.array(F.lit(EMPTY))).otherwise(items)


def names_or_blank(blank: Column, names: Column) -> Column:
    return F.when(blank, F.array(F.lit(EMPTY))).otherwise(names)


def days(date: Column) -> Column:
    return F.unix_date(date)


class _Full(Exception):
    """The sets of a batch of policies take too much room."""


class _Offers:
    """What rate rows offer for one rule, each distinct offer once, and the sets of offers that asked values pass."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        self.offered = [*coded.dictionary.to_pylist(), None]
        self.of_rate = coded.indices.fill_null(len(self.offered) - 1).to_numpy(zero_copy_only=False)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str | int | None, int] = {}
        self.numbers: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []

    def _number(self, asked: str | int | None, passed: np.ndarray) -> int:
        """Equal sets share a number."""
        packed = np.packbits(passed).tobytes()
        if packed not in self.numbers:
            # those of one policy always fit
            if len(self.sets) >= 2 and len(self.sets) * len(passed) > SET_BYTES:
                raise _Full
            self.numbers[packed] = len(self.sets)
            self.sets.append(passed)
        self.known[asked] = self.numbers[packed]
        return self.known[asked]

    def _passed(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def look_up(self, column: pa.Array) -> np.ndarray:
        """The number of each policy's set; a policy without a value passes nowhere."""
        coded = column.dictionary_encode()
        none = np.zeros(len(self.offered), dtype=bool)
        numbers = [self.known[text] if text in self.known else self._number(text, none if text is None else self._passed(text))
                   for text in [*coded.dictionary.to_pylist(), None]]
        return np.array(numbers)[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]


class _TokenOffers(_Offers):
    def __init__(self, column: pa.Array):
        super().__init__(column)
        self.rows: dict[str, list[int]] = {}
        for k, text in enumerate(self.offered):
            for token in () if text is None else text.split(_JOIN):
                self.rows.setdefault(token, []).append(k)

    def _passed(self, text: str) -> np.ndarray:
        found = np.zeros(len(self.offered), dtype=bool)
        for token in text.split(_JOIN):
            found[self.rows.get(token, [])] = True
        return found


class _RangeOffers(_Offers):
    def __init__(self, column: pa.Array, low_open: bool):
        super().__init__(column)
        self.low_open = low_open
        # the last offer is that of no rate row
        self.low, self.high = _read_ends(self.offered[:-1])
        ends = np.concatenate([self.low, self.high])
        self.ends = np.unique(ends[~np.isnan(ends)])

    def _cell(self, cell: int, value: float) -> int:
        """The offers of an elementary interval: -2 no value, -1 any, odd numbers an end itself, even ones a gap."""
        if cell in self.known:
            return self.known[cell]
        if cell == -2:
            passed = np.isnan(self.low) & np.isnan(self.high)
        elif cell == -1:
            passed = np.ones(len(self.low), dtype=bool)
        else:
            above = self.low < value if self.low_open else self.low <= value
            passed = (np.isnan(self.low) | above) & (np.isnan(self.high) | (self.high >= value))
        return self._number(cell, np.append(passed, False))

    def look_up(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        values = np.array([*map(float, coded.dictionary.to_pylist()), 0.0])
        place = np.searchsorted(self.ends, values)
        at = np.zeros(len(values), dtype=bool)
        inside = place < len(self.ends)
        at[inside] = self.ends[place[inside]] == values[inside]
        cells = np.where(np.isnan(values), -1, 2 * place + at)
        cells[-1] = -2
        numbers = np.array([self._cell(int(c), v) for c, v in zip(cells, values)])
        return numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]


class _SpanOffers(_Offers):
    def __init__(self, column: pa.Array, seams_apart: bool):
        super().__init__(column)
        self.seams_apart = seams_apart
        self.low, self.high = _read_ends(self.offered[:-1])

    def _passed(self, text: str) -> np.ndarray:
        low, high = map(float, text.split(_JOIN))
        # comparisons with NaN are false, so an open bound is never beyond another
        meets = ~((low > self.high) | (self.low > high))
        if self.seams_apart:
            above = (high == self.low) & (np.isnan(low) | (low < high)) & (np.isnan(self.high) | (self.high > self.low))
            below = (self.high == low) & (np.isnan(self.low) | (self.low < self.high)) & (np.isnan(high) | (high > low))
            meets &= ~(above | below)
        return np.append(meets, False)


@dataclass(frozen=True)
class Groups:
    """Bigint columns of a card: the group of a row, its place in the group, and what it pays. ``shown`` ids are listed, or all."""

    group: str = "r_group"
    payout: str = "r_payout"
    place: str = "r_place"
    shown: int | None = None

    columns = property(lambda self: [self.group, self.payout, self.place])
    schema = "row_count bigint, group_count bigint, low_payout bigint, high_payout bigint, group_key bigint, used bigint, group_keys array<bigint>"

    def totals(self, counts: np.ndarray, group: np.ndarray, payout: np.ndarray, place: np.ndarray) -> list[pa.Array]:
        """A row for each run of ``counts`` matches, which come by group and place."""
        some = counts > 0
        first = (np.cumsum(counts) - counts)[some]
        new = np.ones(len(group), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        new[first] = True

        def number(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(counts), dtype=np.int64)
            out[some] = values
            return pa.array(out, mask=~some)

        reduced = (lambda ufunc, x: ufunc.reduceat(x, first)) if len(first) else (lambda ufunc, x: np.zeros(0, dtype=np.int64))
        groups = np.zeros(len(counts), dtype=np.int64)
        groups[some] = reduced(np.add, new.astype(np.int64))
        ids, listed = group[new], groups
        if self.shown is not None:
            listed = np.minimum(groups, self.shown)
            ids = ids[np.arange(len(ids)) - np.repeat(np.cumsum(groups) - groups, groups) < self.shown]
        return [pa.array(counts.astype(np.int64)), pa.array(groups), number(reduced(np.minimum, payout)), number(reduced(np.maximum, payout)),
                number(group[first]), number(place[first]), _lists(listed, ids)]


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


class _Index:
    def __init__(self, rates: pa.Table, kinds: list[tuple[type, bool]], carry: list[str], groups: Groups | None):
        column = lambda name: rates.column(name).combine_chunks()
        made = {Tokens: lambda c, _: _TokenOffers(c), Range: _RangeOffers, Span: _SpanOffers}
        self.rules = [made[kind](column(f"x{i}"), flag) for i, (kind, flag) in enumerate(kinds)]
        self.carried = [column(c).fill_null(-2**63).to_numpy(zero_copy_only=False) for c in carry]
        self.groups, self.rates = groups, np.arange(rates.num_rows)
        if groups:
            group, _, place = self.carried
            self.rates = np.lexsort((place, group))

    def narrow(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        """The other columns of the policies with their masks, and the carried numbers of the rate rows that pass every rule."""
        try:
            codes = np.array([rule.look_up(part.column(f"x{i}").combine_chunks()) for i, rule in enumerate(self.rules)])
        except _Full:
            for rule in self.rules:
                rule.clear()
            half = part.num_rows // 2
            yield from self.narrow(part.slice(0, half))
            yield from self.narrow(part.slice(half))
            return
        order = np.lexsort(codes[::-1])
        codes = codes[:, order]
        starts = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(starts, part.num_rows))
        codes, rest = np.ascontiguousarray(codes[:, starts]), part.drop_columns([f"x{i}" for i in range(len(self.rules))]).take(pa.array(order))
        held, low, pairs = [], 0, 0
        for found in self._walk(codes, 0, codes.shape[1], 0, self.rates, 0):
            held.append(found)
            pairs += len(found[2])
            if pairs >= PAIRS:
                yield from self._out(rest, starts, sizes, low, held)
                low, held, pairs = low + sum(len(f[0]) for f in held), [], 0
        yield from self._out(rest, starts, sizes, low, held)

    def _walk(self, codes: np.ndarray, low: int, high: int, level: int, rates: np.ndarray, mask: int) -> Iterator[tuple]:
        """(masks, counts, rates) of the ways ``low`` to ``high``, in their order; all of them took the same way to this level."""
        if len(rates) * min(high - low, 16) <= BRANCH:
            step = max(1, STEP_BITS // max(64, len(rates)))
            for at in range(low, high, step):
                yield self._finish(codes[:, at : min(high, at + step)], level, rates, mask)
            return
        if level == len(self.rules):
            whole = mask == 2 ** len(self.rules) - 1
            yield np.array([mask]), np.array([len(rates) if whole else 0]), rates if whole else rates[:0]
            return
        rule, own = self.rules[level], codes[level, low:high]
        offers = rule.of_rate[rates]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), high - low]
        for a, b in zip(cuts, cuts[1:]):
            left = rates[rule.sets[own[a]][offers]]
            passed = len(left) > 0
            yield from self._walk(codes, low + a, low + b, level + 1, left if passed else rates, mask * 2 + passed)

    def _finish(self, codes: np.ndarray, level: int, rates: np.ndarray, mask: int) -> tuple:
        n, words = codes.shape[1], max(1, -(-len(rates) // 64))
        full = np.zeros(words * 64, dtype=bool)
        full[: len(rates)] = True
        bits = np.tile(np.packbits(full, bitorder="little").view(np.uint64), (n, 1))
        masks = np.full(n, mask, dtype=np.int64)
        for rule, own in zip(self.rules[level:], codes[level:]):
            distinct, where = np.unique(own, return_inverse=True)
            offers = rule.of_rate[rates]
            table = np.zeros((len(distinct), words * 64), dtype=bool)
            for k, number in enumerate(distinct):
                table[k, : len(rates)] = rule.sets[number][offers]
            left = bits & np.packbits(table, axis=1, bitorder="little").view(np.uint64)[where]
            passed = left.any(axis=1)
            masks = masks * 2 + passed
            bits[passed] = left[passed]
        bits[masks != 2 ** len(self.rules) - 1] = 0
        row, rate = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(rates)])
        return masks, np.bincount(row, minlength=n), rates[rate]

    def _out(self, rest: pa.Table, starts: np.ndarray, sizes: np.ndarray, low: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Batches for the policies of the ways in ``held``, the first of which has the number ``low``."""
        if not held:
            return
        masks, counts, rates = (np.concatenate(x) for x in zip(*held))
        own = sizes[low : low + len(masks)]
        carried = [c[rates] for c in self.carried]
        found = self.groups.totals(counts, *carried) if self.groups else [_lists(counts, c) for c in carried]
        way = np.repeat(np.arange(len(masks)), own)
        size = np.cumsum(1 + (np.asarray(pa.compute.list_value_length(found[-1]))[way] if found else np.zeros(len(way), dtype=np.int64)))
        first, at = starts[low], 0
        while at < len(way):
            # a batch ends at a number of rows, or of listed numbers
            done = size[at - 1] if at else 0
            end = max(at + 1, min(len(way), at + 8_192, int(np.searchsorted(size, done + PAIRS, side="right"))))
            picked = pa.array(way[at:end])
            kept = rest.slice(first + at, end - at)
            columns = [kept.column(c).combine_chunks() for c in kept.column_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(masks[way[at:end]].astype(np.int64)), *[f.take(picked) for f in found]], names=[str(i) for i in range(len(columns) + 1 + len(found))])
            at = end


def narrowed(policies: DataFrame, rates: DataFrame, rules: list[Tokens | Range | Span], block: str, key: str, carry: list[str] | None = None,
             keep: list[str] | None = None, groups: Groups | None = None) -> DataFrame:
    """(key, *keep, mask, *carry): a row per policy and shard of its insurer's card.

    ``mask`` has a bit per rule, the first the most significant, set where some rate row of the shard survives it; the greatest of
    a policy's shards is its mask over the whole card. ``carry`` names bigint columns of the card and comes back as arrays over the
    rate rows that pass all rules. With ``groups`` those rows come back counted by group instead (``Groups.schema``), and a group lies
    whole in one shard. Policies whose insurer has no rates have no row.

    Cards are cut into shards of about ``SHARD_RATES`` rows and an insurer's policies into slices. Each slice gets the shard's rates,
    so there are few: no more than a quarter of the policies for each rate, or ``SLICES``. What is sent grows as policies and rates do.
    """
    ship_package(policies.sparkSession)
    carry, keep = groups.columns if groups else carry or [], keep or []
    asked = policies.where(F.col(block).isNotNull()).groupBy(block).agg(F.count("*").alias("policies"))
    offered = rates.where(F.col(f"r_{block}").isNotNull()).groupBy(F.col(f"r_{block}").alias(block)).agg(F.count("*").alias("rates"))
    slices = F.least(F.ceil(F.col("policies") / SLICE_POLICIES), F.greatest(F.lit(SLICES), F.ceil(F.col("policies") / (4 * F.col("rates")))))
    sizes = stage(asked.join(offered, block).select(
        F.col(block).alias("_block"), F.ceil(F.col("rates") / SHARD_RATES).cast("int").alias("_shards"), slices.cast("int").alias("_slices"),
    ))

    def spread(of: Column, n: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    kinds = dict(policies.select(key, *keep).dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    types = [(type(r), getattr(r, "low_open", False) or getattr(r, "seams_apart", False)) for r in rules]
    left = policies.join(sizes, F.col(block) == F.col("_block")).select(
        "_block", spread(F.col(key), "_slices").alias("_slice"), each("_shards").alias("_shard"), F.lit(1).alias("_kind"),
        *[F.col(c) for c in (key, *keep)], *[r.policy().alias(f"x{i}") for i, r in enumerate(rules)], *[none("bigint").alias(c) for c in carry],
    )
    own = [r.rate().alias(f"x{i}") for i, r in enumerate(rules)]
    card = rates.where(F.col(f"r_{block}").isNotNull()).select(F.col(f"r_{block}").alias("_r_block"), *own, *carry)
    card = card if carry else card.distinct()
    whole = F.col(groups.group) if groups else F.struct(*[c for c in card.columns if c != "_r_block"])
    right = card.join(sizes, F.col("_r_block") == F.col("_block")).withColumn("_shard", spread(whole, "_shards")).select(
        "_block", each("_slices").alias("_slice"), "_shard", F.lit(0).alias("_kind"),
        *[none(kinds[c]).alias(c) for c in (key, *keep)], *[f"x{i}" for i in range(len(rules))], *[F.col(c).cast("bigint").alias(c) for c in carry],
    )
    both = left.unionByName(right)
    rate_columns = [*[f"x{i}" for i in range(len(rules))], *carry]
    policy_columns = [key, *keep, *[f"x{i}" for i in range(len(rules))]]
    found = groups.schema if groups else ", ".join(f"`{c}` array<bigint>" for c in carry)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (key, *keep)], "mask bigint", *([found] if found else [])])
    names = [key, *keep, "mask", *([c.split()[0] for c in groups.schema.split(", ")] if groups else carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, waiting = None, [], None, []

        def answered() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield from (b.rename_columns(names) for b in index.narrow(pa.Table.from_batches(waiting)))
                waiting.clear()

        for batch in batches:
            for place, kind, part in _runs(batch):
                if place != at:
                    yield from answered()
                    at, held, index = place, [], None
                if kind == 0:
                    held.append(part.select(rate_columns))
                    continue
                if index is None:
                    # a shard may have lost all rows to others by hash
                    empty = pa.RecordBatch.from_pylist([], schema=part.select(rate_columns).schema)
                    index, held = _Index(pa.Table.from_batches(held or [empty]), types, carry, groups), []
                waiting.append(part.select(policy_columns))
                if sum(b.num_rows for b in waiting) >= BATCH_POLICIES:
                    yield from answered()
        yield from answered()

    n = max(1, int(policies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = ["_block", "_shard", "_slice"]
    # a number of its own: the work is in the tasks, not in the bytes that adaptive execution would merge them by
    return both.repartition(n, *places).sortWithinPartitions(*places, "_kind").mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Stretches of a sorted batch with one place and kind."""
    if not batch.num_rows:
        return
    codes = [batch.column("_block").dictionary_encode().indices, *[batch.column(c) for c in ("_shard", "_slice", "_kind")]]
    changed = reduce(np.logical_or, [np.diff(c.to_numpy(zero_copy_only=False)) != 0 for c in codes])
    starts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for low, high in zip(starts, starts[1:]):
        place = tuple(batch.column(c)[low].as_py() for c in ("_block", "_shard", "_slice"))
        yield place, batch.column("_kind")[low].as_py(), batch.slice(low, high - low)
