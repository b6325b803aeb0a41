"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a text forwards and backwards, labels every position, and the document's probabilities are
the mean of those of its positions. It is trained here, in numpy, by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import map_rows, remainder

HIDDEN = 8
SPAN = 128  # bytes read as one sequence
SAMPLE = 500  # fitting: documents of each language
STEPS, BATCH, TRAIN_SPAN = 240, 160, 64
PAD = 256
FOLDS, HELD = 4, 2
PART_CHARS = 4096
_PLAIN_LETTER = re.compile(r"[A-Za-z]")


def _blank(classes: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    model = {}
    for side in "fb":
        model["x" + side] = (rng.normal(size=(257, 3 * HIDDEN)) * 0.3).astype(np.float32)
        model["u" + side] = (rng.normal(size=(HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
    model["o"] = (rng.normal(size=(2 * HIDDEN, classes)) * 0.3).astype(np.float32)
    model["c"] = np.zeros(classes, dtype=np.float32)
    return model


def _table(model: dict, side: str) -> np.ndarray:
    """Inputs of each byte; padding shuts the update gate, so the state passes it unchanged."""
    table = model["x" + side].copy()
    table[PAD] = 0
    table[PAD, HIDDEN : 2 * HIDDEN] = -40
    return table


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step of x (steps, sequences); gates are kept for training."""
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    out = np.empty((*x.shape, HIDDEN), dtype=np.float32)
    for t in range(len(x)):
        g, m = table[x[t]], h @ u
        gates = g[:, : 2 * HIDDEN] + m[:, : 2 * HIDDEN]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * m[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, r, z, n, m[:, 2 * HIDDEN :].copy()))
        h = h + z * (n - h)
        out[t] = h
    return out


def _back(u: np.ndarray, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights, through time."""
    dtable, du, dh = np.zeros((257, 3 * HIDDEN), dtype=np.float32), np.zeros_like(u), 0
    for t in range(len(x) - 1, -1, -1):
        h, r, z, n, mn = kept[t]
        d = dout[t] + dh
        dn = d * z * (1 - n * n)
        dz = d * (n - h) * z * (1 - z)
        dr = dn * mn * r * (1 - r)
        dg = np.concatenate([dr, dz, dn], axis=1)
        dm = np.concatenate([dr, dz, dn * r], axis=1)
        np.add.at(dtable, x[t], dg)
        du += h.T @ dm
        dh = d * (1 - z) + dm @ u.T
    return dtable, du


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def fit(texts: list[bytes], labels: list[int], classes: int, seed: int = 3) -> dict:
    """Adam on the cross-entropy of every position, over random spans of the sample."""
    model, rng = _blank(classes, seed), np.random.default_rng(seed)
    by_class = [[i for i, y in enumerate(labels) if y == k and texts[i]] for k in range(classes)]
    by_class = [x for x in by_class if x]
    first, second = {k: 0.0 for k in model}, {k: 0.0 for k in model}
    for step in range(1, STEPS + 1 if by_class else 1):
        chosen = [x[rng.integers(len(x))] for x in (by_class[k] for k in rng.integers(len(by_class), size=BATCH))]
        x = np.full((TRAIN_SPAN, BATCH), PAD, dtype=np.int64)
        for k, i in enumerate(chosen):
            low = rng.integers(max(1, len(texts[i]) - TRAIN_SPAN + 1))
            part = np.frombuffer(texts[i][low : low + TRAIN_SPAN], dtype=np.uint8)
            x[: len(part), k] = part
        y = np.array([labels[i] for i in chosen])
        kf, kb = [], []
        forward = _run(_table(model, "f"), model["uf"], x, kf)
        backward = _run(_table(model, "b"), model["ub"], x[::-1], kb)
        h = np.concatenate([forward, backward[::-1]], axis=2)
        d = _softmax(h @ model["o"] + model["c"])
        d[:, np.arange(BATCH), y] -= 1
        d *= (x != PAD)[:, :, None] / max(1, (x != PAD).sum())
        dh = d @ model["o"].T
        grads = {"o": np.einsum("tbh,tbk->hk", h, d), "c": d.sum(axis=(0, 1))}
        grads["xf"], grads["uf"] = _back(model["uf"], x, kf, np.ascontiguousarray(dh[:, :, :HIDDEN]))
        grads["xb"], grads["ub"] = _back(model["ub"], x[::-1], kb, np.ascontiguousarray(dh[::-1, :, HIDDEN:]))
        for k, grad in grads.items():
            grad = np.clip(grad, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            model[k] = (model[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def score(model: dict, texts: list[bytes], sequences: int = 4096) -> np.ndarray:
    """Mean probabilities over all positions of whole texts (rows: texts, columns: languages)."""
    classes = len(model["c"])
    total = np.zeros((len(texts), classes))
    counts = [-(-len(t) // SPAN) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    raw = np.full((len(owner), SPAN), PAD, dtype=np.int16)
    at = 0
    for text, n in zip(texts, counts):
        raw[at : at + n].ravel()[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += n
    tf, tb = _table(model, "f"), _table(model, "b")
    for low in range(0, len(owner), sequences):
        x = np.ascontiguousarray(raw[low : low + sequences].T)
        logits = _run(tf, model["uf"], x) @ model["o"][:HIDDEN]
        logits += _run(tb, model["ub"], x[::-1])[::-1] @ model["o"][HIDDEN:]
        logits += model["c"]
        p = _softmax(logits)
        p *= (x != PAD)[:, :, None]
        np.add.at(total, owner[low : low + sequences], p.sum(axis=0))
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (``½``, ``²`` and other numbers are none)."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict]:
    """The languages of the learning folds and a network from at most ``sample`` documents of each, and of each of those from one
    stretch of ``PART_CHARS`` characters, placed by a hash of the text. Both bound fitting only; scoring reads whole texts."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD)).select("doc_id", "text", "lang")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    texts, labels = [], []
    for k, name in enumerate(names):
        chosen = known.where(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        own = known.where(F.col("lang") == name).join(chosen.distinct(), "doc_id").select("text")
        # fitting reads spans, so one part of each sampled text, from anywhere in it, is enough
        rows = sorted(r["part"] for r in own.select(F.col("text").substr(F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - PART_CHARS + 1)).cast("int") + 1, F.lit(PART_CHARS)).alias("part")).collect())[: 4 * sample]
        texts += [t.encode("utf-8", "surrogatepass") for t in rows]
        labels += [k] * len(rows)
    return names, fit(texts, labels, max(1, len(names)))


def languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of documents outside the fold crc32(doc_id) mod 4 = 2; only the text is scored, every
    byte of it. A null text and one without a letter give ``und`` with score 0, as do all texts where no language can be
    learned. Ties go to the language first in order. Repeated rows get equal results. Other columns are not looked at. An empty
    table gives no rows.
    """
    names, model = train(documents, sample)
    kind = dict(documents.dtypes)["doc_id"]

    def run(ids, texts, held):
        letters = [bool(names) and has_letter(t) for t in texts]
        p = score(model, [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, letters)])
        best = p.argmax(axis=1)
        return [ids, held, [names[k] if ok else "und" for k, ok in zip(best, letters)], pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))]

    source = documents.select("doc_id", "text", (remainder("doc_id", FOLDS) == HELD).alias("held_out"))
    return map_rows(source, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double", rows=128)
