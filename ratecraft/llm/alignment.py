"""Alignment of the tokens of two tokenizers by lockstep merging of their ends.

All documents of a batch are merged at once: one NumPy vector holds a pair of pointers for each, every step compares the ends the
pairs point at, emits a link and a cut where both end, moves the pointer that is behind (both at a cut), and compacts the vector
when documents are finished. Long documents are split at common ends first, so that one of them does not leave the vector empty.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows
from ratecraft.session import ship_package, stage

LANE_TOKENS = 512

#: the byte-level tokenizers' own splitting pattern (public, fixed)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters that both implementations of that pattern class alike; other texts are encoded by the tokenizer's file itself
_OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, and what their tokens stand for in bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        ranks = {self.a_bytes[k]: k for token, k in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # ids written with what follows them
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.n, self.written = n, [f"{k}{end}" for end in ",|;" for k in range(n)]

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space and text under A and of the text under B; none of either where their bytes differ from space and text."""
        spaced = [" " + (t or "") for t in texts]
        mine = [None if _OTHER.search(t) else self.fast.encode_ordinary(t) for t in spaced]
        slow = [k for k, ids in enumerate(mine) if ids is None]
        for k, coded in zip(slow, self.a.encode_batch([spaced[k] for k in slow], add_special_tokens=False)):
            mine[k] = coded.ids
        theirs = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for text, whole, x, y in zip(texts, spaced, mine, theirs):
            raw = whole.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw
            out.append((np.array(x if same else [], dtype=np.int64), np.array(y if same else [], dtype=np.int64)))
        return out


_READY: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    """The tokenizers of shipped files, once a worker."""
    if (a, b) not in _READY:
        _READY[a, b] = Tokenizers(SparkFiles.get(a), SparkFiles.get(b))
    return _READY[a, b]


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file to the executors and returns its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, a_stop: np.ndarray, size: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) A tokens of the lanes: documents, split at common ends about ``size`` tokens apart."""
    first, stop = [], []
    for low, high in zip(a_first.tolist(), a_stop.tolist()):
        at = low
        while high - at > 2 * size:
            ends = a_ends[at + size - 1 : min(at + 2 * size, high) - 1]
            common = np.flatnonzero(b_ends[np.searchsorted(b_ends, ends)] == ends)
            if len(common):
                first.append(at)
                at += size + int(common[0])
                stop.append(at)
            else:
                # no common end near: the lane goes on to the next one there is
                rest = a_ends[at + size - 1 : high]
                found = at + size + int(np.flatnonzero(b_ends[np.searchsorted(b_ends, rest)] == rest)[0])
                first.append(at)
                stop.append(found)
                at = found
        if at < high:
            first.append(at)
            stop.append(high)
    return np.array(first, dtype=np.int64), np.array(stop, dtype=np.int64)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every link, in order. ``first`` and ``stop`` are the lanes' A tokens; a lane begins and stops where
    both tokenizers have an end."""
    i = first.copy()
    start = np.where(first > 0, a_ends[first - 1], 0) if len(first) else first
    j = np.searchsorted(b_ends, start, side="right")
    links_a, links_b = [], []
    while len(i):
        left, right = a_ends[i], b_ends[j]
        cut = left == right
        links_a.append(i[cut])
        links_b.append(j[cut])
        i = i + (left <= right)
        j = j + (right <= left)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not links_a:
        return first, first
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a)
    return a[order], b[order]


def aligned(texts: list[str | None], ready: Tokenizers) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per document: A ids, B ids, and the positions of the A and B tokens that end together (one pair a cut)."""
    coded = ready.encode(texts)
    n_a, n_b = (np.array([len(c[k]) for c in coded], dtype=np.int64) for k in (0, 1))
    a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
    join = lambda k: np.concatenate([c[k] for c in coded]) if coded else np.empty(0, dtype=np.int64)
    # both tokenizers cover the same bytes of every document, so ends may be counted through the batch
    a_ends, b_ends = np.cumsum(ready.a_sizes[join(0)]), np.cumsum(ready.b_sizes[join(1)])
    a, b = lockstep(a_ends, b_ends, *lanes(a_ends, b_ends, a_stop - n_a, a_stop))
    marks = np.searchsorted(a, np.concatenate([[0], a_stop]))
    return [
        (x, y, a[low:high] - (end_a - len(x)), b[low:high] - (end_b - len(y)))
        for (x, y), low, high, end_a, end_b in zip(coded, marks, marks[1:], a_stop, b_stop)
    ]


def written_groups(x: np.ndarray, y: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, ready: Tokenizers) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group between cuts."""
    code_a, code_b = x.copy(), y.copy()
    code_a[at_a] += ready.n
    code_b[at_b] += 2 * ready.n
    group = np.concatenate([np.searchsorted(at_a, np.arange(len(x))) * 2, np.searchsorted(at_b, np.arange(len(y))) * 2 + 1])
    codes = np.concatenate([code_a, code_b])[np.argsort(group, kind="stable")]
    return "".join(map(ready.written.__getitem__, codes.tolist()))[:-1]


def alignments(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): ids of both tokenizers and, for each cut, the places (from 0) of the A and B token that
    end there. Nulls, repeated rows and the rest as in ``summaries``."""
    a, b = ship_file(documents.sparkSession, a_path), ship_file(documents.sparkSession, b_path)

    def run(ids, texts):
        found = aligned(texts, tokenizers(a, b))
        return [ids, *[[f[k] for f in found] for k in range(4)]]

    kind = documents.select(id_col).dtypes[0][1]
    return map_rows(documents.select(id_col, text_col), run, f"doc_id {kind}, a_ids array<long>, b_ids array<long>, a_cuts array<long>, b_cuts array<long>", rows=256)


def _pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count) over all links: counted in tasks first, so what is shuffled is bounded by the vocabularies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                new, n = np.unique(np.frombuffer(b"".join(batch.column(0).slice(low, 256).to_pylist()), dtype=np.int64), return_counts=True)
                pairs, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])

    ship_package(links.sparkSession)
    return links.select("links").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def summaries(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is the number of links of all documents with its pair of ids; a link is best if no other pair with its B id
    counts more. The table of pairs is collected: of two tokens that end together one's bytes end with the other's, so their
    number is bounded by the endings in the vocabularies (about 600,000 for the given ones), whatever the corpus.

    Texts that are null, empty, or not given back by one of the tokenizers have no tokens: zeros and an empty string. Repeated
    rows are aligned and counted one by one. Other columns are not looked at. An empty table gives no rows. Whole texts are
    encoded and verified; a task holds at most 256 of them.
    """
    a, b = ship_file(documents.sparkSession, a_path), ship_file(documents.sparkSession, b_path)

    def run(ids, texts):
        ready, out = tokenizers(a, b), [[] for _ in range(5)]
        for x, y, at_a, at_b in aligned(texts, ready):
            sha = hashlib.sha256(written_groups(x, y, at_a, at_b, ready).encode()).hexdigest() if len(x) else ""
            for column, value in zip(out, (len(x), len(y), len(at_a), sha, (x[at_a] << 32 | y[at_b]).tobytes())):
                column.append(value)
        return [ids, *out]

    kind = documents.select(id_col).dtypes[0][1]
    # read once and encoded once: counting and looking up work on the links
    links = stage(map_rows(documents.select(id_col, text_col), run, f"doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, links binary", rows=256))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(2**32 - 1)))
    table = _pair_counts(links).withColumn("best", F.col("count") == most).orderBy("pair").toArrow()
    known = [table.column(k).to_numpy() for k in ("pair", "count", "best")]
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def count(ids, n_a, n_b, n_links, shas, raw):
        pairs, counts, best = shared.value
        places = [np.searchsorted(pairs, np.frombuffer(r, dtype=np.int64)) for r in raw]
        return [ids, n_a, n_b, n_links, n_links, [int(best[p].sum()) for p in places], [int(counts[p].sum()) for p in places], shas]

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_rows(links, count, schema)
