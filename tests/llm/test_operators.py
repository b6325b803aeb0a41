"""The operators against brute force, on small tables with nulls, blanks, very long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import math
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from ratecraft.llm import chat, decontam, language, licenses, packing, pitman_yor, quality, queries, simhash, toxicity  # noqa: E402
from ratecraft.llm.components import components  # noqa: E402
from ratecraft.llm.exact import exact_groups  # noqa: E402

SF = "/root/testdata/sf0.001"
random.seed(5)
LONG = " ".join(random.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(30_000))
TEXTS = ["one two three four", "one two three four", None, "", "  \n", LONG, LONG + "!", "Ünï <s>[INST] \\ x [/INST]</s> 日本", "x" * 9000, "One TWO three four", "a b", "one two three four"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, recipe string, length int, bucket int, h int, window int, part int, word int"
CLASH = (None, 1, 2, 3, 4, 5, 6)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None, k, *map(lambda x: x if x is None or x else x, ("r", *CLASH[1:]))) for k, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "one two three four", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, none, bits):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted(((r.text_sha256, r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs, hash_bits=bits, min_chars=8, max_chars=64).collect()))
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        keep = max((j for j in same if j is not None), default=None)
        want.append((hashlib.sha256(t.encode()).hexdigest(), i is None, i or 0, keep, len(same), i == keep))
    assert got == sorted(want)
    assert exact_groups(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, None), (7, 7), (2000, 2001), (2000, 2001)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in parent}


def test_balls_meet_exactly_within_three_bits(spark):
    rng = random.Random(1)
    fps = set()
    for base in (rng.getrandbits(64) for _ in range(40)):
        fps.add(base)
        for n in (1, 2, 3, 3, 4, 5):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    roots = lambda pairs: _roots([signed(x) for x in fps], pairs)
    assert roots([(e.u, e.v) for e in edges]) == roots([(signed(a), signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])


def _roots(nodes, pairs):
    parent = {x: x for x in nodes}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_duplicates(docs, none):
    fps = {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        ones = collections.Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, seed=42)] for b in range(64) if h >> b & 1)
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    ids = [i for i in fps if i is not None]
    roots = _roots(ids, [(i, j) for i, j in itertools.combinations(ids, 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == (roots[0] if r.doc_id is None else roots[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(str(r.doc_id), p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for _, own in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in rows), key=lambda x: x[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, queries.TOKENIZER).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randrange(4, 50)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(200))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(bins) if room >= n]
            k = min(fits, key=bins.__getitem__) if fits else len(bins)
            bins[k:] = bins[k:] or [capacity]
            bins[k] -= n
        slots = [(first + k) for _, _, m, first, _ in packing.plan(collections.Counter(lengths), capacity) for k in range(m)]
        assert len(slots) == len(lengths) and len(set(slots)) == len(bins)


def test_token_bytes_agree_with_the_tokenizer():
    tokenizer, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(4)
    signs = ["a", "B", "É", "ß", "İ", "Σ", " ", "\n", "\x1c", "\x85", "\xa0", "'s", "'", "9", ".", "<|endoftext|>", "日", "́", "×", "|"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert np.frombuffer(packing.token_bytes([text], queries.TOKENIZER)[0], dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said, 1), (-7, 1, "assistant", said, 1), (None, 0, "user", "q", 1), (None, 1, "assistant", None, 1), (3, None, None, "n", 1), (3, 2, "assistant", "\\l <s> \\", 1), (3, 2, "assistant", "\\l <s> \\", 1)]
    rows += [(9, 0, "system", "be kind", 1)] + [(9, k, "user" if k % 2 else "assistant", f"turn {k} " + "w " * (k % 90), 1) for k in range(1, 3000)]
    rows += [(11, 0, "user", "w " * 5000, 1), (11, 1, "assistant", "v " * 5000, 1)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int"), budget=256, history=48)
    for r in made.collect():
        assert r.over_budget == (r.tokens > 256) and (not r.over_budget or r.n_turns == 1)
        assert len(chat.parse(r.text)) == r.repeated + r.n_turns
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])), key=lambda r: r[0]):
        own = list(own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got.pop(conv)
        assert r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
    assert not got
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_leaks(spark, none):
    documents, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    items = {r.item_id: decontam.words(r.text) for r in benchmark.collect()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    want = set()
    for r in documents.collect():
        own = grams(decontam.words(r.text))
        want |= {(r.doc_id, i) for i, w in items.items() if len(grams(w) & own) >= 0.8 * len(grams(w))}
    for shard in (2048, 16):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(documents, benchmark, shard=shard).collect()} == want
    assert want and decontam.leaks(none, benchmark).count() == 0
    assert decontam.leaks(documents, benchmark.limit(0)).count() == 0


def test_all_texts_of_an_item_are_looked_for(spark):
    rng = random.Random(9)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)) for n in (30, 60, 12, 200, 40)]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2]), (1, None), (2, texts[3]), (2, texts[0]), (None, texts[4])]
    documents = [(k, f"{'filler word ' * 70}{t}{' more of it' * 50}") for k, t in enumerate(texts)]
    documents += [documents[0], (None, texts[2]), (None, texts[3]), (0, "nothing here"), (9, texts[0] + " " + texts[1])]
    want = sorted(map(str, [(0, 1), (0, 2), (0, 1), (0, 2), (1, 1), (2, 1), (3, 2), (None, 1), (None, 2), (9, 1), (9, 2)]))
    tables = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard in (2048, 2):
        assert sorted(str((r.doc_id, r.item_id)) for r in decontam.leaks(*tables, shard=shard).collect()) == want


def test_block_maxima_lose_nothing():
    rng = random.Random(6)
    vocabulary = [f"w{k}".encode() for k in range(60)]
    rows = []
    for k in range(50):
        own = [rng.choice(vocabulary) for _ in range(20)]
        terms = sorted(set(own))
        rows.append({"item": k, "segment": 0, "length": 20, "terms": terms, "counts": [own.count(t) for t in terms], "frequencies": [10] * len(terms)})
    index = decontam.Index(rows, 50, 20.0)
    text = [rng.choice(vocabulary) for _ in range(700)]
    want = set()
    for p in range(-(-len(text) // decontam.STEP)):
        held = set(text[p * decontam.STEP : p * decontam.STEP + decontam.PASSAGE])
        for k in range(50):
            score = sum(index.impacts[index.vocabulary[t], k] for t in rows[k]["terms"] if t in held)
            if score >= index.floor[k] * (1 - 1e-5):
                want.add((p, k))
    assert {(p, k) for p, k, _ in index.search(text)} == want


def test_patience_and_scan(spark, docs, none):
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    words = "this work is licensed under terms".split()
    assert len(licenses.patience(words, words)) == 6
    text = "x " * 500 + licenses.TEMPLATES["MIT"] + " y" * 300 + " Released, under the new MIT License."
    made = spark.createDataFrame([(1, text), (2, None), (3, "the license")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.first_word) for r in licenses.licenses(made).orderBy("first_word").collect()] == [(1, "MIT", 500), (1, "MIT", 805)]
    assert licenses.licenses(docs).count() == 0 == licenses.licenses(none).count()


def test_every_notice_kind_has_a_row(spark):
    kinds = {"MIT": "Released under the MIT License.", "GPL-3.0": "under the GNU General Public License", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License", "All-rights-reserved": "All rights reserved."}
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = collections.defaultdict(set)
    for r in licenses.licenses(documents).collect():
        got[r.license].add(r.doc_id)
    for name, notice in kinds.items():
        want = {r.doc_id for r in documents.collect() if notice in (r.text or "")}
        assert want and want <= got[name]


def test_each_license_text_is_told_from_its_like():
    split = {name: licenses.words(text) for name, text in licenses.TEMPLATES.items()}
    for name, own in split.items():
        hits = licenses.scan(["x"] * 30 + own + ["y"] * 30, split)
        assert (name, 1.0, 30, 30 + len(own)) in hits
        assert all(b - a < 0.8 * len(own) for other, _, a, b in hits if other != name)


def test_repeated_and_barely_covered_notices():
    split = {"MIT": licenses.words(licenses.TEMPLATES["MIT"])}
    mit, far = split["MIT"], [f"w{k}" for k in range(40)]
    for n in (1, 2, 3, 7):
        for before, after in ((far, far), ([], far), (far, []), ([], [])):
            want = [("MIT", 1.0, len(before) + 5 * k, len(before) + 5 * k + 5) for k in range(n)]
            assert licenses.scan(before + mit * n + after, split) == want
    new = licenses.words("Released under the new MIT License.")
    assert licenses.scan(far + new * 2 + far, split) == [("MIT", 1.0, 40, 46), ("MIT", 1.0, 46, 52)]
    near = licenses.words("Released under the MIT licence")
    assert licenses.scan(far + near + far, split) == [("MIT", 0.8, 40, 44)]
    assert licenses.scan(far + near + mit + far, split) == [("MIT", 0.8, 40, 44), ("MIT", 1.0, 45, 50)]
    for size in range(1, 60):  # any one word in five may be missing
        template = [f"t{k}" for k in range(size)]
        held = [w for k, w in enumerate(template) if k % 5 != 2 or size < 5]
        if len(held) / size >= 0.8:
            assert len(licenses.scan(far + held + far, {"t": template})) == 1


def test_pitman_yor(docs, none):
    rows = docs.collect()
    token = {k: (r.text or "").encode().lower().split() + [b"\n"] for k, r in enumerate(rows)}
    count = collections.Counter(w for k, r in enumerate(rows) if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1 for w in token[k])
    n, v = sum(count.values()), len(count)
    want = sorted((len(t), sum(w in count for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for t in token.values())
    got = pitman_yor.scores(docs).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert pitman_yor.scores(none).count() == 0


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    words, contexts = rng.zipf(1.5, 4000) % 50, rng.integers(0, 600, 4000)
    keys, n = np.unique(words * pitman_yor.CONTEXTS + contexts, return_counts=True)
    h, c = (keys // pitman_yor.CONTEXTS).astype(np.uint64), keys % pitman_yor.CONTEXTS
    s1, s0 = pitman_yor._levels(h, c)
    state = (np.ones(len(h), dtype=np.int64), np.ones(len(s1), dtype=np.int64), np.ones(len(s0), dtype=np.int64))

    def totals(state):
        t2, t1, t0 = state
        c1 = np.add.reduceat(t2, s1)
        sums = lambda at, x, size: np.bincount(at, x, size)
        return {"words": 50, "discount": 0.7, "c2": sums(c, n, 65536), "t2": sums(c, t2, 65536), "c1": sums(c[s1] >> 8, c1, 256), "t1": sums(c[s1] >> 8, t1, 256), "c0": t1.sum(), "t0": t0.sum()}

    for seed in range(3):
        known = totals(state)
        p0, p1, p2 = pitman_yor._predict(h, c, n, state, known)
        unknown = (1 + 0.7 * known["t0"]) / 51 / (known["c0"] + 1)
        assert abs(p0.sum() + unknown * (51 - len(s0)) - 1) < 1e-9
        state = pitman_yor._sweep(h, c, n, state, known, seed)
        assert (state[0] <= n).all() and (state[0] >= 1).all()


def _held_out(frame, column):
    rows = [r for r in frame if r["held_out"] and r[column] is not None]
    return np.mean([r["predicted"] == r[column] for r in rows])


@pytest.mark.parametrize("name,column,least", [("op3_quality_classifier", "quality", 0.9), ("op4_toxicity", "toxic", 0.75)])
def test_classifiers_on_held_out_rows(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    made = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert _held_out(made, column) >= least and all(0 <= r.score <= 1 for r in made)


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: kept.extend(zip(bags, y)))
    made = [(1, "a" * 512 * 60 + "z" * 512 * 40), (2, "short")]
    quality.train(spark.createDataFrame(made, "doc_id long, text string"), labels(spark, [(1, 1, 0, ""), (2, 0, 0, "")]))
    assert sorted((len(bag), y) for bag, y in kept) == [(1, 0), (100, 1)]
    long = next(bag for bag, y in kept if y)
    assert (long[:60, ord("a")] == 1).all() and (long[60:, ord("z")] == 1).all()


def test_language_on_held_out_rows(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    made = queries.QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in made]) >= 0.95
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4, 5)] == ["und", "und", "und", "en"] and got[2].score == 0
    assert language.languages(none).count() == 0


def test_recurrent_gradients():
    rng = np.random.default_rng(1)
    model = language._blank(2, 0)
    x, out = rng.integers(0, 5, (6, 3)), rng.normal(size=(6, 3, language.HIDDEN)).astype(np.float32)
    kept = []
    language._run(model["xf"], model["uf"], x, kept)
    _, du = language._back(model["uf"], x, kept, out)
    for i, j in ((0, 0), (3, 9), (7, 20)):
        moved = [model["uf"].copy() for _ in range(2)]
        moved[0][i, j] += 1e-2
        moved[1][i, j] -= 1e-2
        slope = np.subtract(*[(language._run(model["xf"], u, x) * out).sum() for u in moved]) / 2e-2
        assert abs(slope - du[i, j]) < 1e-2 * max(1, abs(slope))


def test_classifiers_without_much(spark, docs, none):
    some = labels(spark, [(k, k % 2, (k + 1) % 2, "clash") for k in range(8)] + [(3, None, None, None)])
    for function in (quality.quality, toxicity.toxicity):
        for known in (some, labels(spark), labels(spark, [(k, 1, 1, "") for k in range(9)])):
            rows = function(docs, known).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert function(none, some).count() == 0


def test_kernel_is_the_sum_over_common_subsequences():
    s, t = b"idiot", b"idxiot"

    def weights(w):
        c, out = toxicity.codes(w)[0], collections.Counter()
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < toxicity.REACH:
                out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = weights(s), weights(t)
    want = sum(a[g] * b[g] for g in a) / math.sqrt(sum(x * x for x in a.values()))
    assert abs(toxicity.kernel([t], np.ascontiguousarray(toxicity.features([b"^" + s]).T))[0, 0] - want) < 1e-4


def test_exact_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLES["op9_exact_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op9_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    bad = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    left = {i: t for i, t in rows.items() if i not in bad}
    last = {t: max(i for i, u in left.items() if u == t) for t in left.values()}
    left = {i: t for i, t in left.items() if last[t] == i}
    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    roots = _roots(list(left), [(i, j) for i, j in itertools.combinations(left, 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    left = {i: t for i, t in left.items() if roots[i] == i}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    items = [grams(decontam.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(len(g & grams(decontam.words(t))) >= 0.8 * len(g) for g in items)}
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == set(left)
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    text = lambda n=40: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    a, b, c, d, e, f, g, leak = (text() for _ in range(8))
    rows = lambda made: spark.createDataFrame(made, "doc_id long, text string, lang string")
    left = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    same = lambda *pairs: sorted(pairs, key=str)
    docs = rows([(i, t, "en") for i, t in [(None, a), (7, a), (None, b), (8, c), (8, c), (9, d), (9, e), (5, e), (11, e), (None, f), (None, f), (12, None), (3, "")]])
    want = same((7, a), (None, b), (8, c), (9, d), (11, e), (None, f), (12, None))
    assert left(pipeline.drop_exact_copies(spark, docs, "")) == want
    near = rows([(i, t, "en") for i, t in [(None, a), (7, a.upper()), (None, b), (8, c), (8, c), (9, d), (9, e), (5, e.upper()), (None, f), (None, f.upper()), (None, g), (9, g.upper())]])
    got = left(pipeline.drop_near_copies(spark, near, ""))
    assert [x for x in got if (x[1] or "").lower() != f] == same((7, a.upper()), (None, b), (8, c), (9, d), (5, e.upper()), (9, g.upper()))
    assert len([x for x in got if x[1].lower() == f]) == 1
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = rows([(i, t, "en") for i, t in [(None, leak), (None, b), (8, leak), (8, c), (9, d), (9, d)]])
    assert left(pipeline.drop_leaks(spark, held, str(tmp_path))) == same((None, b), (8, c), (9, d), (9, d))
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    verdict = {r.doc_id: r.predicted for r in quality.quality(known, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in known.collect()}
    bad, good = ([texts[i] for i, p in sorted(verdict.items()) if p == k and texts[i]][:2] for k in (0, 1))
    mixed = known.union(rows([(i, t, "en") for i, t in [(None, bad[0]), (None, good[0]), (-8, bad[1]), (-8, good[1])]]))
    out = left(pipeline.keep_quality(spark, mixed, "/root/testdata/sf0.01").where("doc_id IS NULL OR doc_id < 0"))
    assert out == same((None, good[0]), (-8, good[1]))
