"""Best-fit packing planned over a histogram of lengths.

Pieces of one length are interchangeable, so the plan is made for counts: at most one count per length up to the capacity
reaches the driver, however large the corpus. Pieces then take planned slots by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows
from ratecraft.session import stage

CAPACITY = 2048
CACHE_WORDS = 600_000
RANK_ROWS = 50_000


# letters that keep their case rules and stay as they are under composition; other characters take the tokenizer's own way
_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-įıĲ-ɏ]|<\|")
# the tokenizer's own splitting pattern for such lower-case text, in UTF-8
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class _Words(dict):
    """Ids as bytes, by the piece or word. Bounded: it starts anew when full."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def learn(self, pieces: set[bytes]) -> None:
        """Encodes the pieces not known yet together; each one's last id is an end of word."""
        if len(self) + len(pieces) > CACHE_WORDS:
            self.clear()
        new = [p for p in pieces if p not in self]
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer does not end every piece with an end-of-word id")
            raw = ids.tobytes()
            starts = np.concatenate([[0], stops[:-1]])
            self.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(part, starts.tolist(), stops.tolist()))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_READY: dict[str, _Words] = {}


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of whole texts under the word tokenizer, which lower-cases, drops white space and splits into
    pieces that are encoded alone. Texts of plain Latin letters are split here and their pieces looked up; others, and such as
    hold the start of a special token, are encoded whole.
    """
    words = _READY.get(path) or _READY.setdefault(path, _Words(path))
    plain = [None if _OTHER.search(t or "") else _PIECES.findall((t or "").lower().encode()) for t in texts]
    words.learn(set().union(*(p for p in plain if p)))
    return [words.whole(t) if p is None else b"".join(map(words.__getitem__, p)) for t, p in zip(texts, plain)]


def pieces(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one end id, cut only where longer than the capacity."""
    end = int(end_id).to_bytes(4, "little")

    def run(ids, texts):
        out = [[] for _ in range(5)]
        for one, coded in zip(ids, token_bytes(texts, tokenizer)):
            coded += end
            for piece, low in enumerate(range(0, len(coded), 4 * capacity)):
                part = coded[low : low + 4 * capacity]
                for column, value in zip(out, (one, piece, low // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        return out

    kind = documents.select(id_col).dtypes[0][1]
    return map_rows(documents.select(id_col, text_col), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", rows=256)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, offset), where the k-th of the pieces takes
    the k-th sequence from the first one on. Open sequences of one remaining room are kept as ranges, so the work depends on
    the number of lengths, not on that of pieces."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out, used = [], 0
    for length in sorted(counts, reverse=True):
        need, rank, free = counts[length], 0, length
        while need:
            while free <= capacity and not room[free]:
                free += 1
            if free > capacity:
                n = -(-need // (capacity // length))
                room[capacity].append((used, n))
                used, free = used + n, capacity
            first, n = room[free].pop()
            # the tightest sequence stays the tightest while it has room, so it is filled to the last
            each = free // length
            full = min(n, need // each)
            layers, bins = (each, full) if full else (need, 1)
            for layer in range(layers):
                out.append((length, rank, bins, first, capacity - free + layer * length))
                rank += bins
            need -= layers * bins
            room[free - layers * length].append((first, bins))
            if n > bins:
                room[free].append((first + bins, n - bins))
            free = length
    return out


def ranked(parts: DataFrame, rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``rank``, from 0 within a length, by hashed shares of each length, so a length of very many pieces is no hot task.
    ``place`` tells rows apart that are equal otherwise, so copies are dealt to different shares; it is dropped."""
    shares = max(1, -(-parts.count() // rows))
    parts = parts.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(shares))).drop("place")
    sizes = parts.groupBy("length", "share").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    own = parts.withColumn("rank", F.row_number().over(within) - 1)
    return own.join(sizes, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before")).drop("share", "before")


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most the capacity."""
    parts = stage(parts.withColumn("place", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    by_length = {int(k): slots[slots[:, 0] == k, 1:] for k in np.unique(slots[:, 0])}
    out = ranked(parts)
    fields = [f for f in out.schema.fields if f.name != "rank"]
    at = out.columns.index("length"), out.columns.index("rank")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in at)
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                rows, own = np.flatnonzero(length == k), by_length[int(k)]
                slot = np.searchsorted(own[:, 0], rank[rows], side="right") - 1
                sequence[rows], offset[rows] = own[slot, 2] + rank[rows] - own[slot, 0], own[slot, 3]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(sequence), pa.array(offset)], names=[n for n, _ in kept] + ["sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return out.mapInArrow(take, f"{kinds}, sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Only documents longer than the capacity are cut, every piece but the last
    being full. Repeated rows are packed as often as they occur; ties take slots in order of id, piece and checksum, and equal
    rows are interchangeable. Other columns are not looked at. An empty table gives no rows.
    """
    return place(pieces(documents, tokenizer, id_col, text_col, capacity), capacity)
