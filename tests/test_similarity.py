"""Similarity expressions against a plain table of the longest common subsequence."""

import random

from pyspark.sql import functions as F

from ratecraft.functions import similarity as S


def _plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_expressions_equal_the_plain_scores(spark):
    rnd = random.Random(13)
    words = ["GOLD", "PLUS", "SECURE", "a", "é", "日本", "x1", "AB", "BA", "CAB"]
    texts = ["", " ", "a", "a" * 61, "b" * 62, "ab" * 31 + "c", "ab" * 40, "é" * 130 + "z"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(25)]
    texts += ["".join(rnd.choice("abc ") for _ in range(rnd.choice([5, 60, 62, 63, 124, 125, 200]))) for _ in range(20)]
    pairs = [(a, b) for a in texts for b in rnd.sample(texts, 12)] + [(None, "a"), ("a", None)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = frame.select("a", "b", S.common_length(a, b).alias("n"), S.ratio(a, b).alias("ratio"), S.token_sort_ratio(a, b).alias("sort"), S.token_set_ratio(a, b).alias("set")).collect()
    for r in rows:
        if r["a"] is None or r["b"] is None:
            assert r["ratio"] is None
            continue
        assert r["n"] == _plain(r["a"], r["b"])
        assert (r["ratio"], r["sort"], r["set"]) == tuple(S.score(k, r["a"], r["b"]) for k in ("ratio", "token_sort_ratio", "token_set_ratio"))
