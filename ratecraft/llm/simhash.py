"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within three bits of each other meet on a variant that both emit. All variants within half the radius, rounded
up, would be 2,081 a fingerprint. Parity halves that and more: fingerprints one or three bits apart have different parity, so
it is enough that the even ones emit the variants one bit away, and the odd ones themselves, the variants one bit away and
those two bits away within one half of the word (of three differing bits two share a half).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ratecraft.llm.common import map_rows
from ratecraft.llm.components import components
from ratecraft.session import stage

RADIUS = 3
SEED = 42
SPAN = 32_768  # shingles hashed at a time
EMIT_ROWS = 16_384
BUCKET_VARIANTS = 2_000_000
_ONE = np.uint64(1)


def _masks() -> np.ndarray:
    """Zero, the 64 single bits, then the pairs of bits within one half of the word."""
    single = _ONE << np.arange(64, dtype=np.uint64)
    pairs = [single[i] | single[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.concatenate([[np.uint64(0)], single, np.array(pairs, dtype=np.uint64)])


MASKS = _masks()
SINGLES = 64
CODE_BITS = 11  # a mask's number


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a whole text, unsigned: bit i is set if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    ones, total = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for low in range(0, total, SPAN):
        part = words[low : low + SPAN + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null and blank texts have fingerprint zero."""

    def run(ids, texts):
        values = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)
        return [ids, pa.array(values.view(np.int64))]

    kind = documents.select(id_col).dtypes[0][1]
    return map_rows(documents.select(id_col, text_col), run, f"doc_id {kind}, fp long", rows=128)


def _emit(buckets: int):
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(fps):
        fps = np.array(fps, dtype=np.int64).view(np.uint64)
        odd = np.bitwise_count(fps) & 1 == 1
        codes = []
        for own, masks in ((odd, np.arange(len(MASKS))), (~odd, np.arange(1, SINGLES + 1))):
            codes.append(((np.flatnonzero(own)[:, None] << CODE_BITS) | masks[None, :]).ravel().astype(np.uint32))
        codes = np.concatenate(codes)
        variants = fps[codes >> CODE_BITS] ^ MASKS[codes & (2**CODE_BITS - 1)]
        to = np.zeros(len(codes), dtype=np.uint16)
        if buckets > 1:
            to = ((variants * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint16 if buckets <= 2**16 else np.uint32)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1))
        codes, where, whole = codes[order], np.flatnonzero(ends[1:] > ends[:-1]), fps.tobytes()
        own, sent = [], []
        for k in where:
            part = codes[ends[k] : ends[k + 1]]
            if len(part) < len(fps):  # then only the fingerprints that it needs
                own.append(fps[part >> CODE_BITS].tobytes())
                part = (np.arange(len(part), dtype=np.uint32) << CODE_BITS) | (part & (2**CODE_BITS - 1))
            else:
                own.append(whole)
            sent.append(part.astype(np.uint32).tobytes())
        return [where.tolist(), own, sent]

    return run


def _collide(group: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one bucket of variants, thinned to a forest: (u, v) of fingerprints."""
    fps, variants, anchors = [], [], []
    for own, codes in zip(group["fps"], group["codes"]):
        own, codes = np.frombuffer(own, dtype=np.uint64), np.frombuffer(codes, dtype=np.uint32)
        mask = codes & (2**CODE_BITS - 1)
        fps.append(own[codes >> CODE_BITS])
        variants.append(fps[-1] ^ MASKS[mask])
        anchors.append(mask <= SINGLES)
    fps, variants, anchors = np.concatenate(fps), np.concatenate(variants), np.concatenate(anchors)
    order = np.argsort(variants)
    same = variants[order][1:] == variants[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    fps, variants, anchors = fps[order], variants[order], anchors[order]
    none = pd.DataFrame({"u": np.array([], dtype=np.int64), "v": np.array([], dtype=np.int64)})
    if not len(fps):
        return none
    starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    # a member at most one bit from the variant links to all others there; two members two bits away each may be four apart
    top = np.iinfo(np.uint64).max
    anchor = np.minimum.reduceat(np.where(anchors, fps, top), starts)
    has = np.logical_or.reduceat(anchors, starts)
    counts = np.diff(np.append(starts, len(fps)))
    anchor, has = np.repeat(anchor, counts), np.repeat(has, counts)
    u, v = fps[has], anchor[has]
    near = (u != v) & (np.bitwise_count(u ^ v) <= RADIUS)
    names, ends = np.unique(np.concatenate([u[near], v[near]]), return_inverse=True)
    if not len(names):
        return none
    left, right = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return pd.DataFrame({"u": names[moved].view(np.int64), "v": names[root[moved]].view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that keep every component of distance three together.

    Variants are dealt by hash into buckets whose number follows the number of fingerprints, so a bucket stays small; a
    variant is met by at most 2,081 fingerprints. Variants travel as four bytes, a fingerprint's place and a mask's number.
    """
    n = distinct.count()
    per = (len(MASKS) + SINGLES) // 2
    buckets = 1 << (n * per // BUCKET_VARIANTS).bit_length()
    # dealt by count, since a small table of fingerprints becomes a large one of variants
    dealt = distinct.select("fp").repartition(max(1, -(-n // EMIT_ROWS)), "fp")
    sent = map_rows(dealt, _emit(buckets), "bucket int, fps binary, codes binary", rows=4096)
    return sent.groupBy("bucket").applyInPandas(_collide, "u long, v long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable by links of at most three differing bits, the row's own included. Null, empty
    and blank texts share fingerprint zero and link like any other. Rows that share a fingerprint, repeated rows among them,
    are one node, so a group of copies costs one fingerprint. A null id never names a component unless all ids of it are null.
    Other columns are not looked at; an empty table gives no rows.
    """
    fps = stage(fingerprints(documents, id_col, text_col, size))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    hung = stage(components(links(nodes)).withColumnRenamed("node", "fp"))
    least = hung.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    moved = hung.join(least, "root").select("fp", "component")
    # written first, so that the join has two plain exchanges and a very common fingerprint can be split
    named = stage(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
