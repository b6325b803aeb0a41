"""Chat formatting in budgeted windows.

Prefix sums of turn tokens lay a conversation along a line that is marked off in strides. Turns that lie within a stride form
one window, a turn that crosses a mark forms its own, so windows are aligned with turns and each turn is fresh in exactly one.
A window repeats the system turn and as much history as its share of the budget holds, both without loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows

BUDGET = 1024
HISTORY = 192
TURN_TOKENS = 4  # the template's own marks
BLOCK_TURNS = 1024

_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = re.compile(r"\\([\\lb])")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def escape(text: str | None) -> str:
    """The text without control strings: their first characters and backslashes are written with a backslash."""
    return _CONTROL.sub(lambda m: _ESCAPED[m[0]], text or "")


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: {"\\": "\\", "l": "<", "b": "["}[m[1]], text)


def render(turns: list[tuple[str | None, str | None, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text, fresh) turns and the spans under the loss: texts of fresh assistant turns."""
    parts, spans, at = [], [], 0
    for role, text, fresh in turns:
        head, body = f"<s>{escape(role)}[INST]", escape(text)
        if fresh and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "[/INST]</s>"]
        at += len(head) + len(body) + 11
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def laid_out(turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """Adds ``place`` (from 1) and the prefix sums ``start`` and ``end`` of turn tokens, per conversation.

    Sums are taken over blocks of turn numbers first, so a conversation of very many turns is spread over tasks.
    """
    key = ["conv_id", "block"]
    rows = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("block").alias("of_block"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    match = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
    return rows.join(sums, match).select(
        "conv_id", "role", "text", "tokens", (F.col("place") + F.col("n0")).alias("place"),
        (F.col("end") + F.col("t0") - F.col("tokens")).alias("start"), (F.col("end") + F.col("t0")).alias("end"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, loss (code point spans), repeated (leading turns that are not fresh),
    n_turns (fresh ones), tokens, over_budget.

    Tokens are words and the template's marks. A stride is what the system turn and the history leave of the budget, a quarter
    of it at least; only a single turn longer than that, or a very long system turn, makes a window over budget, and nothing is
    ever cut. Turns are ordered by turn, then role, then text; repeated rows are turns of their own; a null turn number comes
    first. Null text and null role count as empty, and a null conv_id is a conversation. The system turn is a first turn with
    that role. Other columns are not looked at. An empty table gives no rows.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long") + TURN_TOKENS)
    rows = laid_out(turns)
    system = rows.where("place = 1 AND role = 'system'").select(F.col("conv_id").alias("of"), F.struct("role", "text").alias("system"), F.col("tokens").alias("system_tokens"))
    rows = rows.join(system, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    kept = F.coalesce("system_tokens", F.lit(0))
    rows = rows.withColumn("stride", F.greatest(F.lit(budget // 4), F.lit(budget - history) - kept).cast("long"))
    # strides begin after the system turn
    rows = rows.withColumn("start", F.greatest(F.col("start") - kept, F.lit(0))).withColumn("end", F.greatest(F.col("end") - kept, F.lit(1)))
    first = F.floor(F.col("start") / F.col("stride"))
    crossing = F.floor((F.col("end") - 1) / F.col("stride")) != first
    rows = rows.withColumn("window", first * 2 + crossing.cast("long"))
    later = F.flatten(F.transform(F.sequence(F.floor(F.col("end") / F.col("stride")), F.floor((F.col("start") + history) / F.col("stride"))), lambda q: F.array(q * 2, q * 2 + 1)))
    can = (F.col("place") > 1) | F.col("system").isNull()
    repeats = rows.where(can & (F.col("start") + history >= F.col("end"))).withColumn("to", F.explode(later)).where("to > window")
    head = F.when(F.col("place") == 1, F.lit(None)).otherwise(F.col("system"))
    turn = lambda fresh: F.struct("place", "start", "end", F.lit(fresh).alias("fresh"), "role", "text", "tokens")
    both = rows.select("conv_id", "window", "system", "system_tokens", turn(True).alias("turn"))
    both = both.union(repeats.select("conv_id", "to", "system", "system_tokens", turn(False)))
    # at most a stride and a share of history, or one turn, meet here
    grouped = both.groupBy("conv_id", "window").agg(F.first("system").alias("system"), F.first("system_tokens").alias("system_tokens"), F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.where(F.exists("turns", lambda t: t.fresh))

    def run(ids, numbers, systems, system_tokens, turns):
        out = [[] for _ in range(8)]
        for one, number, system, sized, own in zip(ids, numbers, systems, system_tokens, turns):
            fresh = [t for t in own if t["fresh"]]
            begin = fresh[0]["start"]
            past = [t for t in own if not t["fresh"] and t["end"] <= begin and t["start"] >= begin - history]
            lead = [(system["role"], system["text"], False)] if system and fresh[0]["place"] > 1 else []
            text, spans = render(lead + [(t["role"], t["text"], t["fresh"]) for t in past + fresh])
            tokens = sum(t["tokens"] for t in past + fresh) + (sized if lead else 0)
            values = one, number, text, [{"start": a, "end": b} for a, b in spans], len(lead) + len(past), len(fresh), tokens, tokens > budget
            for column, value in zip(out, values):
                column.append(value)
        return out

    kind = dict(conversations.dtypes)["conv_id"]
    return map_rows(grouped, run, f"conv_id {kind}, window long, text string, loss array<struct<start:int,end:int>>, repeated int, n_turns int, tokens long, over_budget boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What windows say when read back, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Windows of a conversation stream through one task in order, one at a time: a digest of all its text is sequential, but no
    conversation is held in memory.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    source = formatted.select("conv_id", "window", "text", "loss", "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, target = None, None
        for batch in batches:
            target = target or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *[pa.field(n, t) for n, t in (("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()))]])
            done = []
            for row in batch.to_pylist():
                if state is None or state.conv_id != row["conv_id"]:
                    done += [state.result()] if state else []
                    state = _Read(row["conv_id"])
                state.take(row["text"], row["loss"], row["repeated"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=target)
        if state:
            yield pa.RecordBatch.from_pylist([state.result()], schema=target)

    return source.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)


class _Read:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_windows = 0

    def take(self, text: str, loss: list[dict], repeated: int) -> None:
        for role, said in parse(text)[repeated:]:
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss.update(said.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(said)
        self.chars += len(text)
        self.n_windows += 1

    def result(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "n_windows": self.n_windows}
