"""Language-model scoring by a hierarchical Pitman-Yor model of words.

A word's context is the ending of the word before it: a restaurant for the last two bytes, below one for the last byte, below
the one of all words, below a uniform base. Restaurants share their parents: whoever opens a table is a customer one level up.
There are at most 65,536 + 256 + 1 restaurants, so their totals are bounded and may be sent to every task; dishes, which grow
with the corpus, are dealt to buckets by word, and all that is known of a word lies in one bucket. Seatings are sampled by
Gibbs sweeps: all customers of a dish in a restaurant are taken away and seated again one by one given everybody else, as of
the sweep before. Predictive probabilities are averaged over the sweeps after the first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ratecraft.llm.common import remainder
from ratecraft.session import ship_package, stage

SWEEPS = 3  # the first is not averaged
STRENGTH = 1.0
FOLDS, HELD = 5, 1
SLICE = 512  # documents read together
BUCKET_BYTES = 24_000_000  # of text in a bucket's words
CONTEXTS = 65_536
END = b"\n"  # no word holds it
_EXACT = 16  # customers seated singly; later ones in blocks of a sixteenth of those seated


def _ending(word: bytes) -> int:
    return word[-1] * 256 + (word[-2] if len(word) > 1 else 0)


def _tokens(texts: list[str | None]):
    """Distinct words' hashes and, for every token of all texts: word, context, text."""
    place: dict[bytes, int] = {}
    words, sizes = [], []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        own.append(END)
        sizes.append(len(own))
        words += own
    for w in words:
        if w not in place:
            place[w] = len(place)
    ids = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    hashes = np.array([xxh64_intdigest(w) for w in place], dtype=np.uint64)
    endings = np.array([0 if w == END else _ending(w) for w in place], dtype=np.int64)
    context = np.zeros(len(ids), dtype=np.int64)
    context[1:] = endings[ids[:-1]]  # after an end, and at the start, the context is 0
    return hashes, ids, context, np.repeat(np.arange(len(texts)), sizes), np.array(sizes)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _shares(hashes: np.ndarray, word: np.ndarray, columns: list[np.ndarray], buckets: int):
    """(bucket, its rows) of rows sorted by bucket and word."""
    to = _bucket(hashes, buckets)[word]
    order = np.lexsort((word, to))
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(k), [c[order[ends[k] : ends[k + 1]]] for c in [hashes[word], *columns]]


def _pack(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows sorted by word, each word's hash once."""
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    counts = np.diff(np.append(np.flatnonzero(new), len(hashes))).astype(np.uint32)
    return pickle.dumps((hashes[new], counts, *columns), protocol=5)


def _unpack(payload: bytes):
    hashes, counts, *columns = pickle.loads(payload)
    return [np.repeat(hashes, counts), *columns]


def _read(documents: DataFrame, schema: str, emit) -> DataFrame:
    """Rows that ``emit(part, ids, texts, learn)`` gives for each slice of documents; part names the slice."""
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 0
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                for row in emit(f"{TaskContext.get().partitionId()}-{number}", *[c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types)], names=names)
                number += 1

    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*((n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))))
    return documents.select("doc_id", "text", (remainder("doc_id", FOLDS) != HELD).alias("learn")).mapInArrow(run, schema)


def _emit_counts(buckets: int):
    def emit(part, ids, texts, learn):
        texts = [t for t, yes in zip(texts, learn) if yes]
        if not texts:
            return
        hashes, word, context, _, _ = _tokens(texts)
        keys, counts = np.unique(word * CONTEXTS + context, return_counts=True)
        for k, (h, c, n) in _shares(hashes, keys // CONTEXTS, [(keys % CONTEXTS).astype(np.uint16), counts.astype(np.uint32)], buckets):
            yield k, _pack(h, c, n)

    return emit


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's dishes: counts of (word, context), sorted, and what the totals need."""
    h, c, n = (np.concatenate(x) for x in zip(*map(_unpack, group["payload"])))
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order].astype(np.int64)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    starts = np.flatnonzero(new)
    h, c, n = h[new], c[new], np.add.reduceat(n, starts)
    tokens, words = int(n.sum()), len(np.unique(h))
    return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "tokens": [tokens], "words": [words], "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())], "dishes": [_pack(h, c, n.astype(np.uint32))]})


def _seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after seating each row's customers one by one; ``pull`` is (strength + discount * tables) * parent's probability."""
    tables = np.ones(len(customers), dtype=np.int64)
    rows = np.flatnonzero(customers > 1)
    seated = 1
    while len(rows):
        step = 1 if seated < _EXACT else seated // 16
        block = np.minimum(step, customers[rows] - seated)
        p = pull[rows] / (seated - discount * tables[rows] + pull[rows])
        tables[rows] += rng.binomial(block, p) if step > 1 else rng.random(len(rows)) < p
        seated += step
        rows = rows[customers[rows] > seated]
    return tables


def _levels(h: np.ndarray, c: np.ndarray):
    """Starts of (word, last byte) and of words among dishes sorted by word and context."""
    last = c >> 8
    new_word = np.concatenate([[True], h[1:] != h[:-1]])
    return np.flatnonzero(new_word | np.concatenate([[True], last[1:] != last[:-1]])), np.flatnonzero(new_word)


def _sweep(h, c, n, state, totals: dict, seed: int):
    """One Gibbs sweep of a bucket: tables of each dish at each level, given the totals and tables of the sweep before."""
    rng = np.random.default_rng(seed)
    s1, s0 = _levels(h, c)
    w1 = np.searchsorted(s0, s1, side="right") - 1  # word of each (word, last byte)
    d1 = np.searchsorted(s1, np.arange(len(h)), side="right") - 1
    t2, t1, t0 = state if state else (np.ones(len(h), dtype=np.int64), np.ones(len(s1), dtype=np.int64), np.ones(len(s0), dtype=np.int64))
    p0, p1, _ = _predict(h, c, n, (t2, t1, t0), totals)
    d = totals["discount"]
    base = 1 / (totals["words"] + 1)
    t2 = _seat(n, (STRENGTH + d * totals["t2"][c]) * p1[d1], d, rng)
    c1 = np.add.reduceat(t2, s1)
    t1 = _seat(c1, (STRENGTH + d * totals["t1"][c[s1] >> 8]) * p0[w1], d, rng)
    c0 = np.add.reduceat(t1, np.searchsorted(s1, s0))
    t0 = _seat(c0, np.full(len(s0), (STRENGTH + d * totals["t0"]) * base), d, rng)
    return t2, t1, t0


def _predict(h, c, n, state, totals: dict):
    """Predictive probabilities of a bucket's words: at the root, given the last byte, and given both, where they were seen."""
    s1, s0 = _levels(h, c)
    w1 = np.searchsorted(s0, s1, side="right") - 1
    d1 = np.searchsorted(s1, np.arange(len(h)), side="right") - 1
    t2, t1, t0 = state
    d = totals["discount"]
    c1, c0 = np.add.reduceat(t2, s1), np.add.reduceat(t1, np.searchsorted(s1, s0))
    p0 = (c0 - d * t0 + (STRENGTH + d * totals["t0"]) / (totals["words"] + 1)) / (totals["c0"] + STRENGTH)
    k1 = c[s1] >> 8
    p1 = (c1 - d * t1 + (STRENGTH + d * totals["t1"][k1]) * p0[w1]) / (totals["c1"][k1] + STRENGTH)
    p2 = (n - d * t2 + (STRENGTH + d * totals["t2"][c]) * p1[d1]) / (totals["c2"][c] + STRENGTH)
    return p0, p1, p2


def _sweeps(dishes: bytes, totals: list[dict], bucket: int):
    """The dishes of a bucket and their states after each sweep; sweeps are seeded, so a lost task gives the same again."""
    h, c, n = _unpack(dishes)
    c, n = c.astype(np.int64), n.astype(np.int64)
    states, state = [], None
    for k, known in enumerate(totals):
        state = _sweep(h, c, n, state, known, bucket * 101 + k)
        states.append(state)
    return h, c, n, states


def _totals(counts: DataFrame, known: list[dict], scalars: dict) -> dict:
    """Customers and tables of every restaurant after the sweeps so far: at most 65,793 sums come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, dishes in zip(frame["bucket"], frame["dishes"]):
                h, c, n, states = _sweeps(dishes, known, bucket)
                s1, s0 = _levels(h, c)
                t2, t1, t0 = states[-1] if states else (np.ones(len(h)), np.ones(len(s1)), np.ones(len(s0)))
                keys = np.concatenate([c, CONTEXTS + (c[s1] >> 8), [CONTEXTS + 256]])
                customers = np.concatenate([n, np.add.reduceat(t2, s1), [t1.sum()]])
                tables = np.concatenate([t2, t1, [t0.sum()]])
                name, at = np.unique(keys, return_inverse=True)
                yield pd.DataFrame({"k": name, "c": np.bincount(at, customers), "t": np.bincount(at, tables)})

    sums = counts.select("bucket", "dishes").mapInPandas(run, "k long, c double, t double").groupBy("k").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    c, t = np.zeros(CONTEXTS + 257), np.zeros(CONTEXTS + 257)
    for row in sums.toLocalIterator():
        c[row["k"]], t[row["k"]] = row["c"], row["t"]
    return {**scalars, "c2": c[:CONTEXTS], "c1": c[CONTEXTS:-1], "c0": c[-1], "t2": t[:CONTEXTS], "t1": t[CONTEXTS:-1], "t0": t[-1]}


def _emit_uses(buckets: int):
    def emit(part, ids, texts, learn):
        hashes, word, context, text, sizes = _tokens(texts)
        home = xxh64_intdigest(part) % buckets
        yield home, part, pickle.dumps((ids, [not x for x in learn], sizes)), True
        keys, counts = np.unique((word * CONTEXTS + context) * SLICE + text, return_counts=True)
        pair = keys // SLICE
        columns = [(pair % CONTEXTS).astype(np.uint16), (keys % SLICE).astype(np.uint16), counts.astype(np.uint32)]
        for k, (h, c, i, n) in _shares(hashes, pair // CONTEXTS, columns, buckets):
            yield k, part, _pack(h, c, i, n.astype(np.uint8) if n.max() < 256 else n), False

    return emit


def _scorer(totals: list[dict]):
    """Scores what a bucket's words add to each text of each slice."""
    final = totals[-1]
    size, vocabulary, d = final["tokens"], final["words"], final["discount"]

    def score(key, uses: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(own):
            h, c, n, states = _sweeps(own["dishes"].iloc[0], totals[:-1], int(own["bucket"].iloc[0]))
        else:
            h, c, n, states = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        if len(h):
            s1, s0 = _levels(h, c)
            words, total = h[s0], np.add.reduceat(n, s0)
            pair1 = np.searchsorted(s0, s1, side="right") - 1
            keys1, keys2 = pair1 * 256 + (c[s1] >> 8), (np.searchsorted(s0, np.arange(len(h)), side="right") - 1) * CONTEXTS + c
            predicted = [_predict(h, c, n, s, t) for s, t in zip(states[1:], totals[2:])]
        samples = totals[2:]
        unknown = [(STRENGTH + d * t["t0"]) / (t["words"] + 1) / (t["c0"] + STRENGTH) for t in samples]
        out = []
        for part, payload, names in zip(uses["part"], uses["payload"], uses["names"]):
            if names:
                out.append((part, payload, True))
                continue
            uh, uc, ui, un = _unpack(payload)
            uc, ui, un = uc.astype(np.int64), ui.astype(np.int64), un.astype(np.int64)
            if len(h):
                w = np.minimum(np.searchsorted(words, uh), len(words) - 1)
                known = words[w] == uh
                at1 = np.minimum(np.searchsorted(keys1, w * 256 + (uc >> 8)), len(keys1) - 1)
                has1 = known & (keys1[at1] == w * 256 + (uc >> 8))
                at2 = np.minimum(np.searchsorted(keys2, w * CONTEXTS + uc), len(keys2) - 1)
                has2 = known & (keys2[at2] == w * CONTEXTS + uc)
                count = np.where(known, total[w], 0)
            else:
                known, count = np.zeros(len(uh), dtype=bool), np.zeros(len(uh))
            mean = np.zeros(len(uh))
            for k, t in enumerate(samples):
                p0, k1 = np.full(len(uh), unknown[k]), uc >> 8
                if len(h):
                    p0 = np.where(known, predicted[k][0][w], p0)
                p1 = (STRENGTH + d * t["t1"][k1]) * p0 / (t["c1"][k1] + STRENGTH)
                if len(h):
                    p1 = np.where(has1, predicted[k][1][at1], p1)
                p2 = (STRENGTH + d * t["t2"][uc]) * p1 / (t["c2"][uc] + STRENGTH)
                if len(h):
                    p2 = np.where(has2, predicted[k][2][at2], p2)
                mean += p2 / len(samples)
            plain = np.log10((count + 0.5) / (size + 0.5 * (vocabulary + 1)))
            texts, at = np.unique(ui, return_inverse=True)
            sums = [np.bincount(at, un * x) for x in (known, plain, np.log10(mean))]
            out.append((part, pickle.dumps((texts.astype(np.uint16), *sums), protocol=5), False))
        return pd.DataFrame(out, columns=["part", "payload", "names"])

    return score


def scores(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from whole texts of documents outside the fold crc32(doc_id) mod 5 = 1 and scores every whole text. Null and empty
    texts are the end token alone. Words never learned share one more type of the base. Words are told apart by their 64-bit
    hash. Repeated rows count as often as they occur and score alike. With nothing to learn from, counts are zero and the base is
    uniform over the one unknown type. Other columns are not looked at. An empty table gives no rows.
    """
    kind = dict(documents.dtypes)["doc_id"]
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    sent = _read(documents, "bucket int, payload binary", _emit_counts(buckets))
    counts = stage(sent.groupBy("bucket").applyInPandas(_count, "bucket int, tokens long, words long, once long, twice long, dishes binary"))
    row = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "words", "once", "twice"))).first()
    once, twice = max(1, row["once"]), row["twice"]
    scalars = {"tokens": row["tokens"], "words": row["words"], "discount": min(0.95, max(0.05, once / (once + 2 * twice)))}
    known: list[dict] = []
    for _ in range(SWEEPS + 1):
        known.append(_totals(counts, known, scalars))
    uses = _read(documents, "bucket int, part string, payload binary, names boolean", _emit_uses(buckets))
    parts = uses.groupBy("bucket").cogroup(counts.select("bucket", "dishes").groupBy("bucket")).applyInPandas(_scorer(known), "part string, payload binary, names boolean")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    learned = int(row["tokens"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        ids, held, sizes = pickle.loads(group["payload"][group["names"]].iloc[0])
        sums = np.zeros((3, len(ids)))
        for payload in group["payload"][~group["names"]]:
            texts, *values = pickle.loads(payload)
            sums[:, texts.astype(np.int64)] += values
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "held_out": held, "n_tokens": sizes, "n_known": sums[0].round().astype(np.int64), "train_tokens": learned, "base_score": sums[1], "score": sums[2], "perplexity": 10 ** np.minimum(300, -sums[2] / sizes)})

    return parts.groupBy("part").applyInPandas(together, schema)
