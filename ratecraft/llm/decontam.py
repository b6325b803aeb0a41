"""Benchmark decontamination: a BM25 inverted index of test items, searched with every training passage.

Items are cut into segments that a passage can hold whole, and their postings carry BM25 impacts. Segments lie in blocks, and a
term's greatest impact in each block bounds what the block can score: a passage goes on only into blocks whose summed bounds
reach the threshold (block-max WAND, for all passages of a slice at once), and everything above the threshold is kept. The
items found are then verified by their word shingles and by the words of question and answer.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows
from ratecraft.session import stage

SEGMENT = 48  # words of an item that are indexed together
PASSAGE, STEP = 96, 48  # words; any segment lies whole in some passage
SHARE = 0.6  # of a segment's own score that a passage must reach
SHINGLE, CONTAINED, OVERLAP = 5, 0.8, 0.8
BLOCK = 8  # segments
SHARD = 2048  # segments whose index is held in memory at once
K1, B = 1.2, 0.75

_MARKS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))
_ANSWER = re.compile(r"(?is)^(.*?)\banswer\s*:(.*)$")


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text; ASCII marks separate."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer: what follows "answer:", else its last sentence, else its second half."""
    found = _ANSWER.match(text or "")
    if found:
        return words(found[1]), words(found[2])
    parts = [w for w in (words(s) for s in re.split(r"(?<=[.!?])\s+", text or "")) if w]
    if len(parts) < 2:
        own = parts[0] if parts else []
        return own[: len(own) // 2], own[len(own) // 2 :]
    return [w for p in parts[:-1] for w in p], parts[-1]


def _segments(ids, variants, texts):
    """(item, variant, segment, length, terms, counts) of items' texts; texts without words have none."""
    out = [[] for _ in range(6)]
    for one, variant, text in zip(ids, variants, texts):
        own = words(text)
        for k, low in enumerate(range(0, len(own), SEGMENT)):
            # the last segment reaches back to full length
            part = own[max(0, min(low, len(own) - SEGMENT)) : low + SEGMENT]
            terms = sorted(set(part))
            for column, value in zip(out, (one, variant, k, len(part), terms, [part.count(t) for t in terms])):
                column.append(value)
    return out


class Index:
    """The postings of one shard of segments, with block maxima."""

    def __init__(self, rows: list, segments: int, mean_length: float):
        self.items = [r["item"] for r in rows]
        vocabulary: dict[bytes, int] = {}
        cells: list[tuple[int, int, float]] = []
        own = np.zeros(len(rows))
        for k, r in enumerate(rows):
            for term, count, frequency in zip(r["terms"], r["counts"], r["frequencies"]):
                weight = math.log(1 + (segments - frequency + 0.5) / (frequency + 0.5))
                impact = weight * count * (K1 + 1) / (count + K1 * (1 - B + B * r["length"] / mean_length))
                cells.append((vocabulary.setdefault(bytes(term), len(vocabulary)), k, impact))
                own[k] += impact
        self.vocabulary, self.floor = vocabulary, own * SHARE
        blocks = -(-len(rows) // BLOCK)
        self.bounds = np.zeros((len(vocabulary), blocks), dtype=np.float32)
        self.impacts = np.zeros((len(vocabulary), blocks * BLOCK), dtype=np.float32)
        for term, k, impact in cells:
            self.impacts[term, k] = impact
            self.bounds[term, k // BLOCK] = max(self.bounds[term, k // BLOCK], impact)
        padded = np.full(blocks * BLOCK, np.inf)
        padded[: len(rows)] = self.floor
        self.padded = padded
        self.block_floor = padded.reshape(-1, BLOCK).min(axis=1) * (1 - 1e-5)

    def search(self, own: list[bytes]) -> list[tuple[int, int, float]]:
        """(passage, segment, score as a share of the segment's own) for all passages of a text above the threshold."""
        if not self.items or not own:
            return []
        get = self.vocabulary.get
        terms = np.fromiter((get(w, -1) for w in own), dtype=np.int32, count=len(own))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        terms = terms[at]
        # a word at position p is in passages p//STEP and, overlapping by PASSAGE - STEP, the one before
        inside = [(at // STEP - back, terms) for back in range(PASSAGE // STEP)]
        keys = np.concatenate([np.maximum(p, 0).astype(np.int64) * len(self.vocabulary) + t for p, t in inside])
        keys = np.unique(keys)
        passage, term = keys // len(self.vocabulary), keys % len(self.vocabulary)
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        bound = np.add.reduceat(self.bounds[term], starts, axis=0)
        out = []
        ends = np.append(starts[1:], len(passage))
        for row, block in zip(*np.nonzero(bound >= self.block_floor)):
            within = term[starts[row] : ends[row]]
            scores = self.impacts[within, block * BLOCK : (block + 1) * BLOCK].sum(axis=0)
            for k in np.flatnonzero(scores >= self.padded[block * BLOCK : (block + 1) * BLOCK] * (1 - 1e-5)):
                segment = int(block * BLOCK + k)
                out.append((int(passage[starts[row]]), segment, float(scores[k] / (self.floor[segment] / SHARE))))
        return out


def _shingles(own: list[bytes]) -> set:
    return {tuple(own[k : k + SHINGLE]) for k in range(max(1, len(own) - SHINGLE + 1))}


def _share(part: list[bytes], of: set) -> float:
    distinct = set(part)
    return len(distinct & of) / len(distinct) if distinct else 1.0


def _match(index: Index, keys: list, texts: dict, number: int, ids, documents):
    """Verified items of a slice of documents, each with its best text; keys names the item and text of each segment."""
    out = [[] for _ in range(8)]
    for one, text in zip(ids, documents):
        own = words(text)
        found: dict = {}
        for passage, segment, share in index.search(own):
            item = keys[segment]
            best, places = found.setdefault(item, (0.0, set()))
            places.add(passage)
            found[item] = (max(best, share), places)
        held: dict = {}
        for item, (best, places) in found.items():
            item_words, question, answer = texts[item]
            reach = -(-len(item_words) // STEP) + 1  # an item longer than a passage goes on in the next ones
            spans = sorted((max(0, p - reach) * STEP, (p + reach + 2) * STEP) for p in places)
            near, shingles, low = set(), set(), 0
            for a, b in spans:
                part = own[max(a, low) : b]
                near.update(part)
                shingles |= _shingles(own[max(0, max(a, low) - SHINGLE) : b])
                low = max(low, b)
            wanted = _shingles(item_words)
            contained = len(wanted & shingles) / len(wanted) if len(item_words) >= SHINGLE else _share(item_words, near)
            asked, answered = _share(question, near), _share(answer, near)
            if contained >= CONTAINED and asked >= OVERLAP and answered >= OVERLAP:
                held[item[0]] = max(held.get(item[0], (0.0,)), (contained, best, asked, answered))
        digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest() if held else b""
        for item, (contained, best, asked, answered) in held.items():
            for column, value in zip(out, (one, item, best, contained, asked, answered, digest, number)):
                column.append(value)
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, bm25, contained, question_overlap, answer_overlap), one row per document and item that it holds.

    Every word of every document is in some passage. The index is held for ``shard`` segments at a time and the documents are
    read once for each shard, so what is sent to tasks is bounded however many items there are; document frequencies are those
    of all segments. An item counts as held if 0.8 of its five-word shingles and of the words of its question and of its answer
    are near the passages found; items of fewer than five words are compared by words. Null, empty or wordless texts hold
    nothing and are held by nothing. Repeated document rows give repeated rows. Rows of one item_id are one item, held if any of
    their texts is: all texts are indexed and verified, and the one most contained gives the row. Rows without an item_id are left out. Extra columns are not
    looked at. An empty table gives no rows.
    """
    doc_kind, item_kind = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("item"), F.sha2("text", 256).alias("variant"), "text").distinct()
    parts = map_rows(items, _segments, f"item {item_kind}, variant string, segment int, length int, terms array<binary>, counts array<int>", rows=256)
    whole = parts.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, bm25 double, contained double, question_overlap double, answer_overlap double"
    shards = -(-whole["n"] // shard)
    if not shards:
        return documents.sparkSession.createDataFrame([], schema)
    key = ["item", "variant"]
    postings = parts.select(*key, "segment", "length", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(*key, "segment", "length", "p.terms", "p.counts")
    frequency = postings.groupBy("terms").agg(F.count("*").alias("frequency"))
    full = postings.join(frequency, "terms").groupBy(*key, "segment", "length").agg(F.sort_array(F.collect_list(F.struct("terms", "counts", "frequency"))).alias("p"))
    # written once, as every shard reads its part of it; an item of very many texts is in many shards
    full = stage(full.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards))).join(items, key))
    out = None
    for k in range(shards):
        rows = full.where(F.col("shard") == k).select(*key, "segment", "length", F.col("p.terms").alias("terms"), F.col("p.counts").alias("counts"), F.col("p.frequency").alias("frequencies"), "text").orderBy(*key, "segment").collect()
        keys = [(r["item"], r["variant"]) for r in rows]
        texts = {one: (words(r["text"]), *question_answer(r["text"])) for one, r in zip(keys, rows)}
        match = partial(_match, Index(rows, whole["n"], whole["mean"]), keys, texts, k)
        found = map_rows(documents.select("doc_id", "text"), match, f"{schema}, digest binary, number int", rows=128)
        out = found if out is None else out.union(found)
    columns = ["bm25", "question_overlap", "answer_overlap"]
    if shards > 1:
        # one row a document and item, though several shards hold texts of the item; equal document rows stay as many as they are
        best = out.groupBy("doc_id", "item_id", "digest", "number").agg(F.count("*").alias("n"), F.max(F.struct("contained", *columns)).alias("best"))
        best = best.groupBy("doc_id", "item_id", "digest").agg(F.max("n").alias("n"), F.max("best").alias("best"))
        out = best.select("doc_id", "item_id", "best.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("doc_id", "item_id", "bm25", "contained", "question_overlap", "answer_overlap")
