"""Structure repair, tokenizer alignment and exact search against brute force."""

import bisect
import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from ratecraft.llm import alignment, queries, repair, search  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER


# structure repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, letters, repaired lines) by a search over whole letter strings, written without the operator's tables."""
    sys.setrecursionlimit(100_000)

    @lru_cache(maxsize=None)
    def best(i, roles, inserted):
        # roles: "", "s", "u" or "a": the last role's initial; inserted: inserts just made
        wanted = "a" if roles == "u" else "u"
        out = []
        if i == len(rows):
            if roles in ("", "a"):
                out.append((0, ""))
        else:
            role, fault = rows[i][0], faults[i]
            add = lambda cost, letter, rest: out.append((cost + rest[0], letter + rest[1]))
            add(3, "D", best(i + 1, roles, 0))
            if fault not in ("blank", "duplicate"):
                late = 1 if fault == "truncated" else 0
                initial = role[:1]
                if initial == wanted or (initial == "s" and roles == ""):
                    add(late, "K", best(i + 1, initial, 0))
                add(2 + late, "R", best(i + 1, wanted, 0))
        if inserted < 3:
            rest = best(i, wanted, inserted + 1)
            out.append((2 + rest[0], "I" + rest[1]))
        return min(out) if out else (10**9, "")

    cost, letters = best(0, "", 0)
    lines, last, i = [], "", 0
    for letter in letters:
        wanted = "a" if last == "u" else "u"
        full = {"a": "assistant", "u": "user"}[wanted]
        if letter == "I":
            lines.append(f"{full}:")
            last = wanted
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            lines.append(f"{role}:{text}")
            last = role[:1]
        elif letter == "R":
            lines.append(f"{full}:{text}")
            last = wanted
    return cost, letters, lines


def expected(all_rows, rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said = [(r[1] or "", r[2] or "") for r in own]
        faults = plain_faults(said)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[0][:1] for r in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, lines = cheapest(said, faults) if own else (0, "", [])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SHAPE = "conv_id long, turn long, role string, text string, at long, block long, fault string"


def found(frame):
    rows = frame.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_repair_of_all_kinds_of_conversations(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "well", "", " \n", "Why?", None, "Yes. ", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(None, None, "user", "Null."), (None, 3, "assistant", "Null."), (500, None, "user", None), (501, 5, "user", "Yes."), (501, 5, "user", "Yes."), (501, 900, "assistant", "So.")]
    # one far longer than a block, with a turn number that repeats
    rows += [(900, rng.randrange(400), rng.choice(roles[:6]), f"{rng.randrange(900)}" + rng.choice([".", "", "!"])) for _ in range(2600)]
    rows = [(*r, None, 7, "clash") for r in rows]
    frame = spark.createDataFrame(rows, SHAPE)
    short = [r[:4] for r in rows]
    assert found(repair.repaired(frame, frame)) == expected(short, short)
    hurt = plain_damage(short)
    assert found(repair.repaired(frame, repair.damaged(frame))) == expected(short, hurt)


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()]
    assert found(queries.QUERIES["op11_structure_repair"](spark, SF)) == expected(rows, plain_damage(rows))


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert repair.repaired(none, repair.damaged(none)).collect() == []
    some = spark.createDataFrame([(1, 1, "user", "a.", None, None, None)], SHAPE)
    assert found(repair.repaired(some, none)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_rebuild_the_conversation(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "So.")], "conv_id int, turn int, role string, text string")
    edits = repair.repair(frame).orderBy("at", "tail", "nth").collect()
    assert [(e.edit, e.role, e.text, e.cost) for e in edits] == [("Insert", "user", "", 2), ("Keep", "assistant", "Hi.", 0), ("Insert", "user", "", 2), ("Keep", "assistant", "So.", 0)] or sum(e.cost for e in edits) == 2
    kept = "".join(e.role[0] for e in edits if e.edit != "Delete")
    assert re.fullmatch("(s?(ua)+)?", kept)


def test_checkpoints_change_nothing():
    rng = random.Random(2)
    for n in (1, 2, 3, 15, 16, 17, 200):
        symbols = bytes(rng.randrange(10) for _ in range(n))
        after = (0, 4, 2, 0)
        costs = [after]
        for s in reversed(symbols):
            costs.append(repair.back(s, costs[-1]))
        matrix = repair.transfer(symbols)
        assert costs[-1] == tuple(min(matrix[e][s] + after[e] for e in range(4)) for s in range(4))
        cut = rng.randrange(n)
        first = repair.walks(symbols, after, (0, 1, 2, 3), True)
        middle = after
        for s in reversed(symbols[cut:]):
            middle = repair.back(s, middle)
        for state, (letters, end) in enumerate(first):
            [(x, between)] = repair.walks(symbols[:cut], middle, (state,), False)
            [(y, stop)] = repair.walks(symbols[cut:], after, (between,), True)
            assert (x + y, stop) == (letters, end)


# tokenizer alignment


def plain_tokens(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    codes = {v: k for k, v in alignment._byte_letters().items()}
    letters = {v: k for k, v in codes.items()}
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        x = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in ids]
        y = []
        for k in b.encode(text) if text else []:
            piece = b.id_to_piece(k)
            y.append((k, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) and b.is_byte(k) else piece.replace("▁", " ").encode()))
        good = text and b"".join(t for _, t in x) == raw and b"".join(t for _, t in y) == raw
        out.append((x, y) if good else ([], []))
    return out


def plain_summaries(texts):
    tokens, all_links, counts = plain_tokens(texts), [], {}
    for x, y in tokens:
        ends = lambda t: list(itertools.accumulate(len(raw) for _, raw in t))
        by_end = {}
        for (k, _), end in zip(y, ends(y)):
            by_end.setdefault(end, []).append(k)
        links = [(a, b, end) for (a, _), end in zip(x, ends(x)) for b in by_end.get(end, [])]
        all_links.append((links, ends(x), ends(y)))
        for a, b, _ in links:
            counts[a, b] = counts.get((a, b), 0) + 1
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (x, y), (links, ends_a, ends_b) in zip(tokens, all_links):
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            own = lambda t, ends: ",".join(str(k) for k, _ in t[bisect.bisect_right(ends, low) : bisect.bisect_right(ends, cut)])
            groups.append(f"{own(x, ends_a)}|{own(y, ends_b)}")
            low = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(groups), len(links), sum(counts[a, b] == top[b] for a, b, _ in links), sum(counts[a, b] for a, b, _ in links), sha))
    return out


ODD = [None, "", " ", "  two  spaces ", "<|endoftext|> and <s> </s> <0x41>", "▁ under", "日本語 and ½ ² émigré\tx\r\n\n", "a b\x85c d", "x" * 3000, "👩‍👩‍👧 ok", "don't DON'T I'll", "﻿bom", "1234567 89", "...!!! ???", "é combining"]


def test_alignment_of_odd_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "straße", "naïve,", "don't", "été.", "123", "\n\n"]) for _ in range(6000))
    texts = [*ODD, *ODD[:5], long]
    rows = [(k, t, 1, 2, "x") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair int, links string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.summaries(frame, A, B).collect()}
    want = plain_summaries(texts[:-1] + [long])
    assert [got[k] for k in range(len(texts))] == want
    full = {r.doc_id: r for r in alignment.alignments(frame, A, B).collect()}
    last = full[len(texts) - 1]
    assert len(last.a_cuts) == len(last.b_cuts) == want[-1][2] and last.a_cuts[-1] == len(last.a_ids) - 1
    assert alignment.summaries(frame.limit(0), A, B).collect() == []


def test_alignment_of_the_given_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY length(text) LIMIT 150").fetchall()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.summaries(frame, A, B).collect()}
    assert [got[k] for k, _ in rows] == plain_summaries([t for _, t in rows])


@pytest.mark.parametrize("size", [2, 7, 512])
def test_lockstep_in_lanes(size):
    rng = random.Random(size)
    ends = []
    for _ in range(2):
        cuts = [sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(1 + n // 2)))) + [n] for n in (50, 1, 900, 300)]
        ends.append(cuts)
    base = np.cumsum([0, 50, 1, 900])
    a, b = (np.concatenate([np.array(c) + o for c, o in zip(own, base)]) for own in ends)
    stop = np.cumsum([len(c) for c in ends[0]])
    first = stop - [len(c) for c in ends[0]]
    x, y = alignment.lockstep(a, b, *alignment.lanes(a, b, first, stop, size))
    common = np.intersect1d(a, b)
    assert a[x].tolist() == b[y].tolist() == common.tolist()


# exact search


def plain_top(rows, k, every):
    out = []
    for q, v in rows:
        if q is None or q % every or v is None:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i) for i, w in rows if w is not None and i != q]
        out += [(q, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda t: t[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k, every):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, vec array<long>, cell int, row string")
    return sorted((tuple(r) for r in search.top_k(frame, frame.where(F.col("vec_id") % every == 0), k).collect()), key=str)


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "large", "few"])
def test_search(spark, kind, monkeypatch):
    rng = random.Random(kind)
    monkeypatch.setattr(search, "CELL_ROWS", 60)
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    if kind == "spread":
        rows = [(i, [rng.randrange(-99, 99) for _ in range(8)]) for i in range(700)]
    elif kind == "clustered":
        middles = [[rng.randrange(-9000, 9000) for _ in range(6)] for _ in range(9)]
        rows = [(i, [x + rng.randrange(-50, 50) for x in rng.choice(middles)]) for i in range(900)]
    elif kind == "ties":
        rows = [(i, [rng.randrange(2), rng.randrange(2), 1]) for i in range(600)] + [(None, [1, 1, 1]), (3, [1, 1, 1]), (0, [1, 0, 1])]
    elif kind == "large":
        rows = [(i, [rng.randrange(-(2**29), 2**29) for _ in range(4)]) for i in range(120)]
    else:
        rows = [(0, [1, 2]), (1, None), (2, []), (3, [5]), (50, None)]
    assert searched(spark, rows, 5, 10) == plain_top(rows, 5, 10)


def test_trees_cover_their_points():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-500, 500, (400, 5)), rng.integers(-3, 3, (400, 5)) + 900])
    tree = search.Tree(points)
    assert sorted(np.concatenate([r for r, c in zip(tree.rows, tree.children) if not c]).tolist()) == list(range(800))
    for centre, radius, rows in zip(tree.matrix, tree.radius, tree.rows):
        assert (np.linalg.norm(points[rows] - centre, axis=1) <= radius).all()
    assert max(len(c) for c in tree.children) > 1


def test_search_leaves_pairs_of_nodes_out(monkeypatch):
    """Clustered points are mostly not compared at all."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-20, 20, (300, 6)) + m for m in rng.integers(-5000, 5000, (12, 6))])
    met, plain = [], search._exact
    monkeypatch.setattr(search, "_exact", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    ids = np.arange(len(points))
    best = search.dual_search(search.Tree(points[::50], search.QUERY_LEAF), ids[::50], search.Tree(points), ids, np.full(72, -(2**63)), 5)
    assert len(best.rows) == 72 * 5 and sum(met) < 72 * len(points) / 2


def test_components_become_whole_numbers(spark):
    rows = [(0, [0.5, -0.001, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, []), (6, [1e300, -1e300])]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", search.whole(F.col("x")).alias("v")).collect()}
    assert got == {0: [128, -1, 256], 1: None, 2: None, 3: None, 4: None, 5: [], 6: [2**62, -(2**62)]}


def test_search_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op13_exact_top_k"]).fetchall())
    got = queries.QUERIES["op13_exact_top_k"](spark, SF)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == want and want
    assert search.top_k(spark.createDataFrame([], "vec_id long, vec array<long>"), spark.createDataFrame([], "vec_id long, vec array<long>"), 5).collect() == []


def test_numbers_are_no_letters():
    from ratecraft.llm import language

    assert [language.has_letter(t) for t in (None, "", "12 _", "½ ²", "Ⅷ", "٣", "é", "日", "1a")] == [False, False, False, False, False, False, True, True, True]


def test_equal_rows_are_dealt_to_several_shares(spark):
    from ratecraft.llm import packing

    rows = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"), F.col("id").alias("place"))
    got = packing.ranked(rows, rows=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(900)) and got[0].asDict().keys() == {"doc_id", "piece", "length", "ids_crc32", "rank"}
