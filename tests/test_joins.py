"""Set-oriented joins against row-by-row brute force on random data."""

import itertools
import random

from pyspark.sql import functions as F

from ratecraft import constants as K
from ratecraft.functions import similarity as S
from ratecraft.operators import overlap as O, resolve as R, rulejoin as J
from ratecraft.operators.skew import first_per_group, grid_join, hot_keys


def test_masks_equal_greedy_narrowing(spark):
    rnd = random.Random(7)
    policies = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y", "z"]), rnd.choice([None, 1.0, 5.0, 9.0]), rnd.choice([0.0, 3.0])) for i in range(150)]
    rates = [(rnd.choice("ab"), rnd.choice(["", "x", "y"]), *rnd.choice([(None, None), (0.0, 4.0), (5.0, None), (4.0, 8.0)]), rnd.choice([None, 3.0])) for _ in range(25)]
    p = spark.createDataFrame(policies, "row_id long, insurer string, product string, cc double, sc double")
    r = spark.createDataFrame(rates, "r_insurer string, r_product string, r_low double, r_high double, r_sc double")
    c = F.col
    chain = J.RuleChain(
        lead=[J.Rule(F.lit("p"), J.exact_or_wildcard(c("r_product"), c("product")), F.lit(""))],
        tail=[J.Rule(F.lit("cc"), J.N.in_range(c("cc"), c("r_low"), c("r_high")), F.lit("")), J.Rule(F.lit("sc"), c("r_sc").isNull() | (c("r_sc") == c("sc")), F.lit(""))],
        lead_policy=["product"], lead_rate=["r_product"], tail_policy=["cc", "sc"], tail_rate=["r_low", "r_high", "r_sc"])
    got = {x["row_id"]: x["mask"] for x in J.best_masks(p, r, chain).collect()}

    def greedy(policy):
        _, insurer, product, cc, sc = policy
        tests = [
            lambda t: t[1] in ("", product),
            lambda t: (t[2] is None and t[3] is None) if cc is None else (t[2] is None or t[2] <= cc) and (t[3] is None or t[3] >= cc),
            lambda t: t[4] is None or t[4] == sc]
        rows, mask = [t for t in rates if t[0] == insurer], 0
        if not rows:
            return None
        for test in tests:
            kept = [t for t in rows if test(t)]
            mask = mask * 2 + bool(kept)
            rows = kept or rows
        return mask

    assert got == {p[0]: greedy(p) for p in policies if greedy(p) is not None}


def test_model_word_pairs_equal_counting(spark):
    rnd = random.Random(3)
    vocabulary = ["HONDA", "ACTIVA", "6G", "DIO", "LX", "CITY", "YAMAHA"]
    items = [(f"g{i % 5}", " ".join(rnd.sample(vocabulary, rnd.randint(1, 4)))) for i in range(40)]
    terms = [" ".join(rnd.sample(vocabulary, rnd.randint(1, 4))) for _ in range(30)]
    master = spark.createDataFrame(items, "name string, item string").groupBy("name").agg(F.array_join(F.collect_list("item"), ",").alias("cluster"))
    got = {tuple(x) for x in R.resolve_models(spark.createDataFrame([(t,) for t in terms], "term string"), master).collect()}
    want = {(t, n) for t in terms for n, item in items if len(set(t.split()) & set(item.split())) >= 2}
    assert got == want


def test_codes_match_items_and_whole_words(spark):
    master = spark.createDataFrame([("A", "MH12, MH 14 X"), ("B", "MH120,MH-12"), ("C", "X.1,/")], "name string, cluster string")
    terms = spark.createDataFrame([("mh12",), ("12",), ("MH 14",), ("x.1",), ("/",), ("MH1",)], "term string")
    got = {tuple(x) for x in R.resolve_codes(terms, master).collect()}
    assert got == {("MH12", "a"), ("12", "b"), ("MH 14", "a"), ("X.1", "c"), ("/", "c")}


def test_close_pairs_lose_nothing(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    left = spark.createDataFrame([("k", w) for w in set(words[:30])], "k string, a string")
    right = spark.createDataFrame([("k", w) for w in set(words[30:])], "k string, b string")
    for minimum in (75, 80, 90):
        got = {(x["a"], x["b"]) for x in R.close_pairs(left, right, "k", minimum).collect()}
        want = {(a, b) for a in words[:30] for b in words[30:] if S.score("ratio", a, b) > minimum}
        assert want <= got
    found = {(x["a"], x["b"]) for x in R.fuzzy_category_pairs(left, right, "k").collect()}
    assert found == {(a, b) for a in words[:30] for b in words[30:] if a in b or b in a or S.score("ratio", a, b) > 75}


def test_insurers_without_key_words_still_score(spark):
    sources = spark.createDataFrame([("The General Insurance Co",), ("Magma HDI",), ("zzz",)], "name string")
    targets = spark.createDataFrame([("general insurance company",), ("Magma-HDI General Insurance Co Ltd",), ("SBI General Insurance",)], "name string")
    got = {x["source"]: x["insurer"] for x in R.resolve_insurers(sources, targets).collect()}
    assert got["magma hdi"] == "magma-hdi general insurance co ltd"
    best = max(("general insurance company", "magma-hdi general insurance co ltd", "sbi general insurance"), key=lambda t: S.score("weighted_ratio", "the general insurance co", t))
    assert got["the general insurance co"] == best and "zzz" not in got


def test_grid_join_is_the_plain_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    a = spark.createDataFrame(rows, "x long, k string")
    b = spark.createDataFrame(rows, "y long, k string")
    got = sorted((r["x"], r["y"]) for r in grid_join(a, b, ["k"], ("x", "y"), F.expr("x < y"), side=16).collect())
    assert got == sorted((i, j) for i, k in rows for j, m in rows if k == m and i < j)


def test_grid_join_cuts_the_side_that_is_hot(spark):
    few, many = [(1, "hot"), (2, "k3")], [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    for left, right in ((few, many), (many, few)):
        a, b = spark.createDataFrame(left, "x long, k string"), spark.createDataFrame(right, "y long, k string")
        got = sorted((r["x"], r["y"]) for r in grid_join(a, b, ["k"], ("x", "y"), F.lit(True), side=16).collect())
        assert got == sorted((i, j) for i, k in left for j, m in right if k == m)
        slices = [tuple(r)[1:] for r in hot_keys(a, b, ["k"], 16).collect()]
        assert slices == [(None, 13) if right is many else (13, None)]


def test_first_per_group(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = sorted(tuple(r) for r in first_per_group(rows, ["g"], [F.desc("id")], 4).collect())
    assert got == sorted((i % 3, i) for i in range(988, 1000))


def _groups(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        low = rnd.choice([None, 0.0, 1000.0])
        rows.append((i + 1, None, rnd.choice(["Acme", "Beta"]), rnd.choice(["", "TW", "GCV"]), rnd.choice(["", "STP"]), "", rnd.choice(["NA", "Car", None]), rnd.choice(["NA", "YES", "NO"]), None, "NA",
                     ", ".join(rnd.sample(["m1", "m2", "m3"], rnd.randint(0, 2))), ",".join(rnd.sample(["r1", "r2", "r3", "r4"], rnd.randint(0, 2))), rnd.choice(["a  b", "A B", "c"]),
                     low, None if rnd.random() < .4 else (low or 0.0) + rnd.choice([0.0, 1000.0]), *[None] * 6, None, None, "ACTIVE", "NO"))
    schema = ("id long, group_id long, insurance_company string, product string, sub_product string, fuel_type string, make_model_class string, is_ncb string, is_cpa string, is_zd string, new_vehicle_makes string, "
              "new_rto_list string, add_tnc string, cc_min double, cc_max double, sc_min double, sc_max double, vehicle_age_min double, vehicle_age_max double, tariff_min double, tariff_max double, "
              "from_date date, to_date date, status string, is_deleted string")
    return spark.createDataFrame(rows, schema), rows


def test_overlap_sweep_equals_all_pairs(spark):
    rates, rows = _groups(spark, 90, 20260829)
    groups = O.with_profile(O.active_groups(rates)).cache()
    pairs = O.profile_pairs(O.profiles(groups))
    got = {(r["group_key_a"], r["group_key_b"]): r["conflict_type"] for r in O.list_pairs(groups, pairs).collect()}
    counts = {r["conflict_type"]: r["pairs"] for r in O.true_counts(pairs, O.profiles(groups)).collect()}

    def norm(r):
        split = lambda t: frozenset(x.strip() for x in t.split(",") if x.strip())
        return {"k": r[0], "ins": r[2], "cat": r[3:6], "cls": (r[6] or "").lower(), "ncb": r[7], "makes": split(r[10]), "rtos": split(r[11]), "tnc": " ".join(r[12].lower().split()), "lo": r[13], "hi": r[14]}

    def conflict(a, b):
        if a["ins"] != b["ins"] or any(x and y and x != y for x, y in zip(a["cat"], b["cat"])):
            return False
        if a["cls"] not in ("", "na") and b["cls"] not in ("", "na") and a["cls"] != b["cls"]:
            return False
        if "NA" not in (a["ncb"], b["ncb"]) and a["ncb"] != b["ncb"]:
            return False
        lows = [x for x in (a["lo"], b["lo"]) if x is not None]
        highs = [x for x in (a["hi"], b["hi"]) if x is not None]
        if lows and highs:
            low, high = max(lows), min(highs)
            if low > high:
                return False
            if low == high:
                ends = lambda g: g["hi"] == low and (g["lo"] is None or g["lo"] < low)
                starts = lambda g: g["lo"] == low and (g["hi"] is None or g["hi"] > low)
                if (ends(a) and starts(b)) or (ends(b) and starts(a)):
                    return False
        return all((not a[x] and not b[x]) or bool(a[x] & b[x]) for x in ("makes", "rtos"))

    g = [norm(r) for r in rows]
    hits = [(a, b) for a, b in itertools.combinations(g, 2) if conflict(a, b)]
    assert set(got) == {(a["k"], b["k"]) for a, b in hits if a["tnc"] == b["tnc"]}
    assert counts.get("SKIPPED", 0) == sum(a["tnc"] != b["tnc"] for a, b in hits)
    assert sum(counts.values()) == len(hits)


def test_capped_listing_is_the_head_of_the_full_one(spark):
    rates, _ = _groups(spark, 60, 5)
    same = rates.where("id <= 12").withColumns({c: F.lit("r1") for c in ("new_rto_list", "new_vehicle_makes")}).withColumns({"product": F.lit("TW"), "add_tnc": F.lit("c"), "cc_min": F.lit(1.0), "cc_max": F.lit(2.0)})
    same = same.withColumns({"insurance_company": F.lit("Acme"), "make_model_class": F.lit("NA"), "is_ncb": F.lit("NA"), "sub_product": F.lit("")})
    groups = O.with_profile(O.active_groups(rates.where("id > 12").unionByName(same))).cache()
    pairs = O.profile_pairs(O.profiles(groups))
    full = [tuple(r) for r in O.list_pairs(groups, pairs).select("conflict_type", "insurance_company", "group_key_a", "group_key_b").collect()]
    capped = [tuple(r) for r in O.list_pairs(groups, pairs, {t: 7 for t in K.CONFLICT_SEVERITY}).select("conflict_type", "insurance_company", "group_key_a", "group_key_b").collect()]
    want = []
    for kind in {f[0] for f in full}:
        want += sorted(f for f in full if f[0] == kind)[:7]
    assert sorted(capped) == sorted(want)
    assert len([f for f in full if f[0] == "EXACT_DUPLICATE"]) >= 66


def test_export_makes_a_pairs_row_where_it_is(spark):
    labels = [*O.CATEGORIES.values(), "Vehicle Class", *O.INTERVALS.values(), *O.CODES.values(), *O.LISTS.values(), "Add T&C"]
    axes = [(label, f"a{i}", None if i == 3 else f"b{i}", f"s{i}") for i, label in enumerate(labels)]
    pairs = spark.createDataFrame(
        [("acme", "DOUBLE_RATE_RISK", 1, 2, 3, 4, "CC: 1", axes), ("acme", "PARTIAL", 1, 2, 5, 6, "", axes)],
        "insurance_company string, conflict_type string, group_key_a long, row_count_a long, group_key_b long, row_count_b long, summary string, "
        "axes array<struct<label:string,a:string,b:string,shared:string>>")
    wide = O.export_pivot(pairs)
    rows = {r["group_key_b"]: r for r in wide.collect()}
    assert len(rows) == 2 and rows[3]["note"] and rows[5]["note"] == "" and rows[3]["collides_on"] == "CC: 1"
    for label, a, b, shared in axes:
        assert [rows[3][f"{label} ({side})"] for side in ("Group A", "Group B", "Shared")] == [a, b, shared]
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_groups_are_made_where_their_blocks_met(spark, monkeypatch):
    rates, _ = _groups(spark, 50, 11)
    one = rates.where("id = 1")
    same = one.crossJoin(spark.range(9).withColumnRenamed("id", "i")).withColumn("id", F.col("i") * 3 + 1).drop("i")
    # one profile of nine groups whose texts differ, so detail does too
    same = same.withColumn("add_tnc", F.when(F.col("id") % 2 == 0, F.lit("A B")).otherwise(F.lit("a  b")))
    groups = O.with_profile(O.active_groups(rates.where("id % 3 <> 1 OR id > 25").unionByName(same))).cache()
    pairs = O.profile_pairs(O.profiles(groups)).cache()
    keys = {r["profile"]: [] for r in groups.select("profile").distinct().collect()}
    for r in groups.collect():
        keys[r["profile"]].append(r["grid_key"])
    want = {(min(x, y), max(x, y)): p["conflict_type"] for p in pairs.where("conflict_type IS NOT NULL").collect() for x in keys[p["a_profile"]] for y in keys[p["b_profile"]]}
    want.update({(x, y): "EXACT_DUPLICATE" for own in keys.values() for x in own for y in own if x < y})
    for size in (2, 256):
        monkeypatch.setattr(O, "BLOCK", size)
        listed = O.list_pairs(groups, pairs)
        assert sorted((r["group_key_a"], r["group_key_b"], r["conflict_type"]) for r in listed.collect()) == sorted((*k, v) for k, v in want.items())
    # nothing that grows as the pairs of groups is moved or sent to every task
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(b_members") < plan.index("Exchange") and plan.count("SortMergeJoin") >= 2

    empty = spark.createDataFrame([], "name string, cluster string")
    detailed = O.members_paired(O.with_detail(O.pair_blocks(groups, pairs, O.DETAIL), groups, empty, empty, pairs))
    by_pair = O.with_detail(listed, groups, empty, empty)
    shown = ["group_key_a", "group_key_b", "conflict_type", "insurance_company", "row_count_a", "row_count_b", "severity_rank", "axes", "summary"]
    assert sorted(map(str, detailed.select(*shown).collect())) == sorted(map(str, by_pair.select(*shown).collect()))
