"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention, learned from document labels alone, weighs the
passages; the weighted sum is scored. Fitting takes every passage of a bounded sample of labelled documents; scoring takes every passage of
every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratecraft.llm.common import labelled, map_rows, remainder

PASSAGE = 512  # bytes
SAMPLE = 1500  # fitting: documents of each label value
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, GATES = 24, 12
DIM = 256 + 3


def passages(text: str | None) -> np.ndarray:
    """Features (DIM) of every passage of a whole text: byte shares, share of distinct 4-grams, share of repeated bytes, fill.

    A text without bytes is one empty passage.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.empty((n, DIM), dtype=np.float32)
    for low in range(0, n, 2048):  # bounds memory for very long texts
        part = raw[low * PASSAGE : (low + 2048) * PASSAGE]
        k = max(1, -(-len(part) // PASSAGE))
        block = np.zeros((k, PASSAGE), dtype=np.uint8)
        block.ravel()[: len(part)] = part
        size = np.full(k, PASSAGE, dtype=np.float32)
        size[-1] = len(part) - (k - 1) * PASSAGE
        shares = np.bincount((np.arange(k, dtype=np.int64)[:, None] * 256 + block).ravel(), minlength=k * 256).reshape(k, 256).astype(np.float32)
        shares[:, 0] -= PASSAGE - size
        grams = np.zeros((k, PASSAGE - 3), dtype=np.uint32)
        for shift in range(4):
            grams |= block[:, shift : PASSAGE - 3 + shift].astype(np.uint32) << np.uint32(8 * shift)
        grams.sort(axis=1)
        distinct = 1 + (grams[:, 1:] != grams[:, :-1]).sum(axis=1)
        full = np.maximum(size, 1)
        rows = out[low : low + k]
        rows[:, :256] = np.sqrt(np.maximum(shares, 0) / full[:, None])
        rows[:, 256] = np.minimum(1, distinct / np.maximum(1, size - 3))
        rows[:, 257] = (block[:, 1:] == block[:, :-1]).sum(axis=1) / PASSAGE
        rows[:, 258] = size / PASSAGE
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(model: dict, x: np.ndarray, starts: np.ndarray):
    """Logits of bags (rows of x from each start on) and what the gradient needs."""
    counts = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), counts)
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (v * u) @ model["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ model["c"] + model["d"], (bag, h, v, u, a, z)


def fit(bags: list[np.ndarray], labels: list[int], epochs: int = 25, seed: int = 7) -> dict:
    """Adam on the log loss of bag labels."""
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(bags) if bags else np.zeros((1, DIM), dtype=np.float32)
    model = {"mean": stacked.mean(axis=0), "scale": stacked.std(axis=0) + 0.02}
    for name, shape in (("W", (DIM, HIDDEN)), ("b", (HIDDEN,)), ("V", (HIDDEN, GATES)), ("U", (HIDDEN, GATES)), ("w", (GATES,)), ("c", (HIDDEN,)), ("d", ())):
        model[name] = (rng.normal(size=shape) / np.sqrt(shape[0]) if len(shape) > 1 or name in "wc" else np.zeros(shape)).astype(np.float32)
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    first, second, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    y = np.array(labels, dtype=np.float32)
    for _ in range(epochs if len(set(labels)) > 1 else 0):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), 64):
            rows = order[low : low + 64]
            x = np.concatenate([bags[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in rows])[:-1]])
            logit, (bag, h, v, u, a, z) = _forward(model, x, starts)
            g = (_sigmoid(logit) - y[rows]) / len(rows)
            dz = g[:, None] * model["c"]
            da = (h * dz[bag]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            dvu = de[:, None] * model["w"]
            dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
            dh = (a[:, None] * dz[bag] + dv @ model["V"].T + du @ model["U"].T) * (1 - h * h)
            scaled = (x - model["mean"]) / model["scale"]
            grads = {"W": scaled.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ g, "d": g.sum()}
            step += 1
            for k in learned:
                grad = grads[k] + 1e-4 * model[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                model[k] = (model[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart
        model["c"], model["d"] = np.zeros(HIDDEN, dtype=np.float32), np.float32(0 if not labels else 8 if labels[0] else -8)
    return model


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of whole texts, a few at a time so that very long ones don't meet in memory."""
    out = np.empty(len(texts))
    for low in range(0, len(texts), 16):
        bags = [passages(t) for t in texts[low : low + 16]]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
        out[low : low + 16] = _sigmoid(_forward(model, np.concatenate(bags), starts)[0])
    return out


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> dict:
    """A model from all passages of at most ``sample`` documents of each label value outside the held-out fold.

    A passage takes about a byte of driver memory for each byte of text.
    """
    rows = map_rows(
        labelled(documents, labels, "quality", folds, sample),
        lambda texts, y: [[passages(t).astype(np.float16).tobytes() for t in texts], y], "bag binary, y int", rows=64,
    ).collect()
    rows = sorted(((r["y"], bytes(r["bag"])) for r in rows))
    return fit([np.frombuffer(b, dtype=np.float16).astype(np.float32).reshape(-1, DIM) for _, b in rows], [y for y, _ in rows])


def quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, threshold: float = THRESHOLD, model: dict | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted.

    Labels of the fold crc32(doc_id) mod ``folds`` = 0 are never learned from, nor are null labels. Text alone is scored; null
    and empty texts count as one empty passage and get its score. Without labels every score is one half; with labels of one
    value only, all scores lean to it. Repeated rows get equal scores. Columns other than doc_id, text and quality are not looked
    at. An empty table gives no rows. With a ``model``, as where ids are other ones than those of the labels, nothing is fitted.
    """
    model = model or train(documents, labels, sample, folds)
    kind = dict(documents.dtypes)["doc_id"]
    held = documents.select("doc_id", "text", (remainder("doc_id", folds) == 0).alias("held_out"))

    def run(ids, texts, held_out):
        scores = score(model, texts)
        return [ids, held_out, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return map_rows(held, run, f"doc_id {kind}, held_out boolean, score double, predicted int", rows=128)
