"""Repair of conversation structure by the cheapest edits, with a square-root checkpointed dynamic program.

Four states tell what a repaired conversation's roles may go on with, and the backward state-cost vector of a place holds the
cost of the cheapest edits from there to the end. Vectors are kept at checkpoints only: at the ends of blocks of rows, which are
worked on by different tasks, and about the square root of a block's length apart within it. Walking forward, the vectors
between two checkpoints are worked out again and the least letter among the tight edits is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows
from ratecraft.session import ship_package, stage

BLOCK_BITS = 10

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACE = " \t\n\x0b\f\r"

# states: nothing yet, after the system turn, after a user turn, after an assistant turn; what a user or assistant turn leads to
_NEXT = (2, 2, 3, 2)
_WANTED = ("user", "user", "assistant", "user")
#: costs of closing a conversation that ends in a state: (s?(ua)+)? is empty or ends in an assistant turn
_END = (0, 4, 2, 0)

# symbols of rows: 0 blank, 1 duplicate, then initial (s, u, a, other) times whether truncated
FAULTS = {0: "blank", 1: "duplicate", 3: "truncated", 5: "truncated", 7: "truncated", 9: "truncated"}


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol > 1:
        initial, late = divmod(symbol - 2, 2)
        if initial == 0 and state == 0:
            out.append(("K", late * TRUNCATED, 1))
        if initial == (2 if state == 2 else 1):
            out.append(("K", late * TRUNCATED, _NEXT[state]))
        out.append(("R", REROLE + late * TRUNCATED, _NEXT[state]))
    return out


_MOVES = [[_moves(symbol, state) for state in range(4)] for symbol in range(10)]


@lru_cache(maxsize=100_000)
def _back(symbol: int, after: tuple) -> tuple:
    best = [min(cost + after[to] for _, cost, to in _MOVES[symbol][state]) for state in range(4)]
    for state in (2, 3, 2, 0, 1):  # inserts before the row
        best[state] = min(best[state], INSERT + best[_NEXT[state]])
    return tuple(best)


def back(symbol: int, after: tuple) -> tuple:
    """The costs before a row from those after it. Equal but for a constant, vectors share one look-up."""
    least = min(after)
    return tuple(x + least for x in _back(symbol, tuple(x - least for x in after)))


def transfer(symbols: bytes) -> list[tuple]:
    """For each state after the rows, the costs of ending in it from every state before them."""
    out = []
    for end in range(4):
        v = tuple(0 if s == end else inf for s in range(4))
        for symbol in reversed(symbols):
            v = back(symbol, v)
        out.append(v)
    return out


def walks(symbols: bytes, after: tuple, states: tuple, last: bool) -> list[tuple[str, int]]:
    """(letters, state after) of the ASCII-least cheapest edits of the rows, from each of the states before them."""
    n, gap = len(symbols), isqrt(len(symbols)) + 1
    kept, v = {}, after
    for i in range(n - 1, -1, -1):
        v = back(symbols[i], v)
        if i % gap == 0:
            kept[i] = v
    now, letters = list(states), [[] for _ in states]
    for low in range(0, n, gap):
        high = min(n, low + gap)
        costs = [kept.get(high, after)]
        for i in range(high - 1, low - 1, -1):
            costs.append(back(symbols[i], costs[-1]))
        costs.reverse()
        for i in range(low, high):
            before, then = costs[i - low], costs[i - low + 1]
            for k, state in enumerate(now):
                letters[k].append(_row(symbols[i], before, then, state))
                now[k] = _after(letters[k][-1], symbols[i], state)
    if last:
        for k, state in enumerate(now):
            letters[k].append("I" * (_END[state] // INSERT))
            now[k] = 3 if _END[state] else state
    return [("".join(x), state) for x, state in zip(letters, now)]


def _row(symbol: int, before: tuple, then: tuple, state: int) -> str:
    """The letters at one row: inserts before it and what is done to it."""
    out = ""
    while True:
        tight = {letter for letter, cost, to in _MOVES[symbol][state] if cost + then[to] == before[state]}
        if "D" not in tight and INSERT + before[_NEXT[state]] == before[state]:
            out, state = out + "I", _NEXT[state]
        else:
            return out + min(tight)


def _after(letters: str, symbol: int, state: int) -> int:
    for letter in letters:
        state = _NEXT[state] if letter == "I" else next(to for x, _, to in _MOVES[symbol][state] if x == letter)
    return state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the given damage by crc32 of ``conv_id:turn`` modulo 20; nulls but the turn are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.cast("int").alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): rows with a place in the order of conversation, turn (nulls first), role and text, as a
    staged table. Ranges are cut by count, so neither a long conversation nor a turn number that repeats fills one task."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stage(rows.drop("tie").withColumn("at", F.monotonically_increasing_id()))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, block, at, symbol) of ordered rows."""
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    late = (~F.substring(bare, -1, 1).isin(".", "!", "?")).cast("int")
    marks = rows.select("conv_id", "at", "role", F.sha2("text", 256).alias("digest"), F.when(bare == "", 0).otherwise(number * 2 + late + 2).alias("symbol"))
    # counted down before the shuffle, so copies of one row meet as one place a task
    first = marks.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    seen = F.when((F.col("symbol") > 0) & F.col("first").isNull(), 1).otherwise(F.col("symbol"))
    return marks.join(first, "at", "left").select("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"), "at", seen.cast("int").alias("symbol"))


def _stream(df: DataFrame, key: str, order: list[Column], function: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of one key in order through one task, one at a time."""
    ship_package(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for row in function(row for batch in batches for low in range(0, batch.num_rows, 256) for row in batch.slice(low, 256).to_pylist()):
            done.append(row)
            if len(done) == 1024:
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema=target)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, fields)


def _fold(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks last to first: the costs after each block."""
    held, v = None, None
    for row in rows:
        last = held is None or held["conv_id"] != row["conv_id"]
        if held:
            yield held | {"first": last}
        v = _END if last else v
        held = {"conv_id": row["conv_id"], "block": row["block"], "after": list(v), "last": last}
        v = tuple(min(row["transfer"][4 * end + s] + v[end] for end in range(4)) for s in range(4))
    if held:
        yield held | {"first": True}


def _chain(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks first to last: the letters from the state in which the block before ended."""
    state = 0
    for row in rows:
        state = 0 if row["first"] else state
        yield {"conv_id": row["conv_id"], "block": row["block"], "state": state}
        state = row["ends"][0 if row["first"] else state]


def _expanded(ids, blocks, places, symbols, letters, firsts, states):
    """One row per edit from the letters of a block."""
    out = [[] for _ in range(8)]
    for one, at, own, of_state, first, state in zip(ids, places, symbols, letters, firsts, states):
        i = nth = 0
        for letter in of_state[0 if first else state]:
            symbol = own[i] if letter != "I" else None
            late = TRUNCATED if symbol in FAULTS and symbol > 1 else 0
            role = _WANTED[state] if letter in "IR" else None
            cost = {"D": DELETE, "I": INSERT, "K": late, "R": REROLE + late}[letter]
            # inserts that follow the last row stand at its place
            for column, value in zip(out, (one, at[min(i, len(at) - 1)], nth, i >= len(at), letter, FAULTS.get(symbol), role, cost)):
                column.append(value)
            nth += 1
            if letter == "I":
                state = _NEXT[state]
            else:
                state = next(to for x, _, to in _MOVES[symbol][state] if x == letter)
                i, nth = i + 1, 0
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """The edits that make the roles' initials of each conversation ``(s?(ua)+)?`` at the least cost, one row each: conv_id, at,
    tail, nth (together their order), edit (Delete, Insert, Keep or Rerole), fault (blank, duplicate or truncated, or null),
    old_role, role, text, cost. Rows that are not deleted are the repaired conversation, in that order.

    Keeping costs 0, a new role 2, deleting 3 (blank rows and such as repeat role and text of an earlier one must go), an inserted
    empty turn 2; a truncated row that stays adds 1. Of equal costs the ASCII-least letters win. Turns are ordered by turn, nulls
    first, then by role and text; repeated rows are rows of their own. Null role and text count as empty, a null conv_id is a
    conversation. Other columns are not looked at. An empty table gives no rows. No task holds more than a block of 1,024
    rows of a conversation; vectors and states at the ends of its blocks pass through one task one by one.
    """
    rows = in_order(conversations)
    kind = dict(rows.dtypes)["conv_id"]
    blocks = _symbols(rows).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    blocks = blocks.select("conv_id", "block", F.col("rows.at").alias("places"), F.col("rows.symbol").alias("symbols"))

    def matrices(ids, numbers, places, symbols):
        return [ids, numbers, places, symbols, [[x for v in transfer(bytes(s)) for x in v] for s in symbols]]

    shape = f"conv_id {kind}, block long, places array<long>, symbols array<int>"
    blocks = stage(map_rows(blocks, matrices, f"{shape}, transfer array<double>"))
    after = _stream(blocks.select("conv_id", "block", "transfer"), "conv_id", [F.col("block").desc()], _fold, f"conv_id {kind}, block long, after array<double>, last boolean, first boolean")
    same = lambda a, b: (a["block"] == b["block"]) & a["conv_id"].eqNullSafe(b["conv_id"])
    own = blocks.join(after, same(blocks, after)).select(blocks["conv_id"], blocks["block"], "places", "symbols", "after", "last", "first")

    def walked(ids, numbers, places, symbols, afters, lasts, firsts):
        found = [walks(bytes(s), tuple(v), (0,) if first else (0, 1, 2, 3), last) for s, v, last, first in zip(symbols, afters, lasts, firsts)]
        return [ids, numbers, places, symbols, firsts, [[x for x, _ in w] for w in found], [[x for _, x in w] for w in found]]

    done = stage(map_rows(own, walked, f"{shape}, first boolean, letters array<string>, ends array<int>"))
    entered = _stream(done.select("conv_id", "block", "first", "ends"), "conv_id", [F.col("block")], _chain, f"conv_id {kind}, block long, state int")
    ready = done.join(entered, same(done, entered)).select(done["conv_id"], done["block"], "places", "symbols", "letters", "first", "state")
    edits = map_rows(ready, _expanded, f"conv_id {kind}, at long, nth int, tail boolean, letter string, fault string, role string, cost long", rows=64)
    names = F.create_map(*[F.lit(x) for x in ("D", "Delete", "I", "Insert", "K", "Keep", "R", "Rerole")])
    said = rows.select("at", F.col("role").alias("old_role"), "text")
    inserted = F.col("letter") == "I"
    return edits.join(said, "at").select(
        "conv_id", "at", "tail", "nth", names[F.col("letter")].alias("edit"), "fault", F.when(~inserted, F.col("old_role")).alias("old_role"),
        F.when(F.col("letter") == "K", F.col("old_role")).otherwise(F.col("role")).alias("role"),
        F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text"), "cost",
    )


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation: blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its edits. A digest is
    sequential, so a conversation streams through one task, but is not held there."""
    kind = dict(edits.dtypes)["conv_id"]
    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        state = None
        for row in rows:
            if state is None or state.conv_id != row["conv_id"]:
                if state:
                    yield state.result()
                state = _Digest(row["conv_id"])
            state.take(row)
        if state:
            yield state.result()

    return _stream(edits, "conv_id", [F.col("at"), F.col("tail"), F.col("nth")], run, schema)


class _Digest:
    """Running counts and digest of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.sha, self.audit, self.before = conv_id, hashlib.sha256(), [], None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.lines = 0

    def take(self, row: dict) -> None:
        self.audit.append(row["edit"][0])
        self.counts["cost"] += row["cost"]
        if row["fault"]:
            self.counts[row["fault"]] += 1
        if row["edit"] != "Insert":
            initial = row["old_role"][:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.before = initial
        if row["edit"] != "Delete":
            line = f"{row['role']}:{row['text']}"
            self.sha.update((line if not self.lines else "\n" + line).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def result(self) -> dict:
        return {"conv_id": self.conv_id, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: gaps, faults, cost, audit and digest of the repair of its ``rows``. Without
    rows: zeros, an empty audit and the digest of the empty text. ``gaps`` is null where it lies beyond 64 bits."""
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct("turn"), F.lit(0)).try_cast("long").alias("gaps"))
    found, ids = digests(repair(rows)), conversations.select("conv_id").distinct()
    out = ids.join(gaps.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.withColumn("none", F.col("gaps").isNull())
    out = out.join(found.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", F.when(F.col("of").isNull() & F.col("none"), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps"), *zero,
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
