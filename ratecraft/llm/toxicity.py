"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings counts their common subsequences of three characters, each weighed by a power of its span, so an
insult with gaps or inserted characters stays close to the plain one. Landmarks are strings that tell toxic from clean labelled
texts; the kernel is approximated in their span; a machine on bags learns from the labels of whole texts which words are to
blame. A sentence is as toxic as its worst word, and a document as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratecraft.llm.common import labelled, map_rows, remainder

DECAY, REACH = 0.6, 8  # weight of each skipped character; greatest span of a subsequence
SAMPLE = 1000  # fitting: documents of each label value
FOLDS, THRESHOLD = 5, 0.5
LANDMARKS, COMMON, HARD, TWICE = 32, 6, 64, 3
GRAM = 5
WORST = 16  # fitting: words of a bag
LONGEST, OVERLAP = 48, 24  # longer words are read in overlapping parts
CACHE = 400_000
R = 61  # word start, letters, digits, classes of other characters
_START = 0

_PLAIN = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\r\x0b\x0c")
_SPELLED = re.compile(rb"(?<![^ ])(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf])(?: (?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf])){2,}(?![^ ])")
PAIRS = [(a, b) for b in range(2, REACH) for a in range(1, b)]


def units(text: str | None) -> set[bytes]:
    """The distinct lower-case words of a whole text without marks, and runs of single characters put together."""
    flat = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PLAIN)
    own = flat.split()
    out = set(own)
    for run in _SPELLED.findall(b" ".join(own)):
        out.add(run.replace(b" ", b""))
    return out


def codes(unit: bytes) -> list[list[int]]:
    """A word as numbers, its start marked; in overlapping parts if it is very long."""
    own = [ord(c) - 96 if "a" <= c <= "z" else 27 if c.isdigit() else 28 + ord(c) % 33 for c in unit.decode("utf-8", "replace")]
    if len(own) <= LONGEST:
        return [[_START, *own]]
    return [[*([_START] if not low else []), *own[low : low + LONGEST]] for low in range(0, len(own) - OVERLAP, LONGEST - OVERLAP)]


def _subsequences(rows: np.ndarray):
    """(numbers of the subsequences of equally long strings, weight) for each shape of gaps."""
    n = rows.shape[1]
    for a, b in PAIRS:
        if b < n:
            yield (rows[:, : n - b] * R + rows[:, a : n - b + a]) * R + rows[:, b:], DECAY ** (b - 2)


def _by_length(parts: list[list[int]]):
    groups: dict[int, list[int]] = defaultdict(list)
    for k, part in enumerate(parts):
        groups[len(part)].append(k)
    for at in groups.values():
        for low in range(0, len(at), 2048):
            own = at[low : low + 2048]
            yield own, np.array([parts[k] for k in own], dtype=np.int64)


def features(strings: list[bytes]) -> np.ndarray:
    """Normalised subsequence weights of landmarks (rows), for all possible subsequences."""
    out = np.zeros((len(strings), R**3), dtype=np.float32)
    for k, s in enumerate(strings):
        for part in codes(s.removeprefix(b"^")):
            part = part if s.startswith(b"^") else part[1:]
            for number, weight in _subsequences(np.array([part], dtype=np.int64)):
                np.add.at(out[k], number[0], weight)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def kernel(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The kernel of words with the landmarks of a table (columns), or their decision values for a table of one column."""
    parts, owner = [], []
    for k, w in enumerate(words):
        for part in codes(w):
            parts.append(part)
            owner.append(k)
    values = np.zeros((len(parts), table.shape[1]), dtype=np.float32)
    for own, rows in _by_length(parts):
        for number, weight in _subsequences(rows):
            for column in range(number.shape[1]):
                values[own] += np.float32(weight) * table[number[:, column]]
    out = np.full((len(words), table.shape[1]), -np.inf, dtype=np.float32)
    np.maximum.at(out, owner, values)
    return out


def landmarks(bags: list[set[bytes]], labels: list[int]) -> tuple[list[bytes], list[bytes]]:
    """Grams that cover the toxic bags, each bag a few times over, and few clean ones; then the commonest clean words."""
    holders: dict[bytes, set[int]] = defaultdict(set)
    for k, bag in enumerate(bags):
        if labels[k]:
            for g in {m[i : i + GRAM] for u in bag for m in [b"^" + u] for i in range(max(1, len(m) - GRAM + 1))}:
                holders[g].add(k)
    holders = {g: h for g, h in holders.items() if len(h) > 2}
    clean, common = Counter(), Counter()
    for k, bag in enumerate(bags):
        if not labels[k]:
            common.update(bag)
            clean.update({m[i : i + GRAM] for u in bag for m in [b"^" + u] for i in range(max(1, len(m) - GRAM + 1))} & holders.keys())
    chosen: list[bytes] = []
    covered: Counter = Counter()
    ranked = sorted(holders, key=lambda g: (4 * clean[g] - len(holders[g]), g))[:5000]
    while len(chosen) < LANDMARKS and ranked:
        gain = {g: sum(covered[k] < TWICE for k in holders[g]) - 4 * clean[g] for g in ranked if g not in chosen}
        best = min(gain, key=lambda g: (-gain[g], g), default=None)
        if best is None or gain[best] < 3:
            break
        chosen.append(best)
        covered.update(holders[best])
    return chosen, [b"^" + w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]


def _machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with hinge loss, by Adam."""
    w, b = np.zeros(x.shape[1]), -1.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        bad = (y * (x @ w + b) < 1) * share * y
        grad = np.append(1e-5 * w - bad @ x, -bad.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.1 * (1 - step / (rounds + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(bags: list[set[bytes]], labels: list[int], rounds: int = 600) -> dict:
    """A decision table over subsequences, its offset and the scale to probabilities.

    The table is the machine's normal vector in the span of the landmarks, so deciding on a word is one sum over its own
    subsequences.
    """
    none = {"table": np.zeros((R**3, 1), dtype=np.float32), "offset": 0.0, "scale": 0.0, "shift": -4.0 if 0 in labels or not labels else 4.0}
    marked, common = landmarks(bags, labels) if len(set(labels)) > 1 else ([], [])
    if not marked:
        return none
    chosen = marked + common
    bags = [bag or {b""} for bag in bags]
    words = sorted(set().union(*bags))
    # the words of a bag that are nearest to a landmark stand for it
    near = dict(zip(words, kernel(words, features(marked).max(axis=0)[:, None])[:, 0].tolist()))
    bags = [sorted(bag, key=lambda u: (-near[u], u))[:WORST] for bag in bags]
    toxic, clean = (Counter(u for bag, label in zip(bags, labels) if label == k for u in bag) for k in (1, 0))
    # to blame are words that come again in toxic texts and never in clean ones
    blamed = sorted(u for u, n in toxic.items() if n > 2 and u not in clean)
    if not blamed:
        return none
    words = blamed + sorted(clean)
    y = np.where(np.arange(len(words)) < len(blamed), 1.0, -1.0)
    weight = np.sqrt([toxic[u] for u in blamed] + [clean[u] for u in words[len(blamed) :]])
    share = np.where(y > 0, 0.2 * weight / max(1, weight[y > 0].sum()), 0.8 * weight / max(1, weight[y < 0].sum()))
    for steps in (rounds // 3, rounds):
        # one more landmark holds all subsequences alike, which makes long words comparable
        marks = np.concatenate([features(chosen), np.full((1, R**3), R**-1.5, dtype=np.float32)])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        whiten = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        x = kernel(words, np.ascontiguousarray(marks.T)) @ whiten.astype(np.float32)
        w, b = _machine(x, y, share, steps)
        # clean words that come too near become landmarks themselves
        hard = np.flatnonzero(y < 0)[np.argsort(-(x @ w)[y < 0] * np.sqrt(weight[y < 0]), kind="stable")[:HARD]]
        chosen = chosen + [b"^" + words[k] for k in hard if steps < rounds]
    decision = dict(zip(words, (x @ w).tolist()))
    rest = sorted({u for bag in bags for u in bag} - decision.keys())
    decision.update(zip(rest, (kernel(rest, np.ascontiguousarray(marks.T)) @ whiten.astype(np.float32) @ w).tolist() if rest else []))
    top = np.array([max(decision[u] for u in bag) for bag in bags]) + b
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    share = 1 / len(y)
    scale, shift = 2.0, 0.0
    for _ in range(500):  # logistic calibration
        p = 1 / (1 + np.exp(-(scale * top + shift)))
        g = (p - (y > 0)) * share
        scale, shift = scale - 2 * (g @ top) - 2e-4 * scale, shift - 2 * g.sum()
    return {"table": (marks.T @ (whiten @ w)).astype(np.float32)[:, None], "offset": float(b), "scale": float(max(scale, 0.0)), "shift": float(shift), "landmarks": chosen}


_KNOWN: dict[bytes, dict[bytes, float]] = {}


def decisions(model: dict, texts: list[str | None]) -> np.ndarray:
    """The decision value of whole texts. Those of words met before are looked up; the store is bounded."""
    key = model["table"].tobytes()[:: 4096]
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {}
    known = _KNOWN[key]
    bags = [units(t) or {b""} for t in texts]
    new = sorted(set().union(*bags) - known.keys())
    if len(known) + len(new) > CACHE:
        known.clear()
        new = sorted(set().union(*bags))
    if new:
        known.update(zip(new, kernel(new, model["table"])[:, 0].tolist()))
    return np.array([max(map(known.__getitem__, bag)) for bag in bags]) + model["offset"]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A machine from at most ``sample`` documents of each label value outside the held-out fold."""
    rows = map_rows(
        labelled(documents, labels, "toxic", FOLDS, sample), lambda texts, y: [[sorted(units(t)) for t in texts], y], "bag array<binary>, y int", rows=64,
    ).collect()
    rows = sorted((r["y"], [bytes(u) for u in r["bag"]]) for r in rows)
    return fit([set(bag) for _, bag in rows], [y for y, _ in rows])


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted.

    Labels of the fold crc32(doc_id) mod 5 = 0 are never learned from, nor are null labels. Text alone is scored, every word of
    it; null, empty and wordless texts get the score of no word at all. Without labels, or with labels of one value, scores are
    constant. Repeated rows get equal scores. Columns other than doc_id, text and toxic are not looked at. An empty table gives
    no rows.
    """
    model = train(documents, labels, sample)
    kind = dict(documents.dtypes)["doc_id"]

    def run(ids, texts, held):
        scores = 1 / (1 + np.exp(-np.clip(model["scale"] * decisions(model, texts) + model["shift"], -60, 60)))
        return [ids, held, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    source = documents.select("doc_id", "text", (remainder("doc_id", FOLDS) == 0).alias("held_out"))
    return map_rows(source, run, f"doc_id {kind}, held_out boolean, score double, predicted int", rows=128)
