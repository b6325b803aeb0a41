"""The bitmap index of a card against the same rules tested pair by pair."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ratecraft.operators import bitmap as B, gaps as G, healthjoin as H, rulejoin as J
from ratecraft.sources import rates as S

MAKES, RTOS = ["m1", "m2", "m3", "m4"], ["r1", "r2", "r3"]


def _card(spark, n, rnd):
    """Normalised motor rates of any kind: open, half-open, one-point and empty ranges, blank and long lists, equal rows."""
    rows = []
    for i in range(n):
        def bounds(step, rnd=rnd):
            low = rnd.choice([None, None, 0.0, float(step)])
            return low, rnd.choice([None, None, (low or 0.0) + step, low])
        day = rnd.choice([None, datetime.date(2000, 1, 1), datetime.date(2001, 6, 1)])
        end = rnd.choice([None, day, datetime.date(2001, 12, 31)])
        rows.append((
            i + 1, rnd.choice([None, 100 + i // 3]), rnd.choice(["Acme", "Beta", "Beta"]), rnd.choice(["", "tw", "car"]), rnd.choice(["", "", "stp"]), rnd.choice(["", "petrol"]), rnd.choice(["NA", "", "suv"]),
            rnd.choice(["NA", "YES", "NO"]), rnd.choice(["NA", None, "YES"]), rnd.choice(["NA", "NO"]), ", ".join(rnd.sample(MAKES, rnd.randint(0, 3))), ", ".join(rnd.sample(RTOS, rnd.randint(0, 2))),
            *bounds(100), *bounds(4), *bounds(5), *bounds(50), day, end, rnd.choice(["On Net", "On OD"]), "On Net", rnd.choice([None, 1.0, 2.5]), None, rnd.choice([1.0, 3.0]), 0.0, None, None, 4.0, 0.0, "t", "ACTIVE", "NO"))
    bounds = ", ".join(f"{b} double" for b in S.BOUNDS)
    legs = ", ".join(f"{r} double" for r in S.RATES)
    schema = ("id long, group_id long, insurance_company string, product string, sub_product string, fuel_type string, make_model_class string, is_ncb string, is_cpa string, is_zd string, "
              f"new_vehicle_makes string, new_rto_list string, {bounds}, from_date date, to_date date, po_type string, pi_type string, {legs}, add_tnc string, status string, is_deleted string")
    return S.motor_rate_rows(spark.createDataFrame(rows, schema))


def _policies(spark, n, rnd):
    rows = []
    for i in range(n):
        make, rto = rnd.choice(["", "honda city", "unknown x"]), rnd.choice(["", "mh01", "zz99"])
        rows.append((
            i, rnd.choice(["acme", "beta", "beta", "beta", "none", None]), rnd.choice(["", "tw", "car", "bus"]), rnd.choice(["", "stp"]), rnd.choice(["petrol", "", "cng"]), rnd.choice(["", "suv", "na"]),
            rnd.choice([None, 0.0, 50.0, 100.0, 100.5, 200.0]), rnd.random() < .1, rnd.choice([None, 0.0, 4.0, 5.0]), rnd.choice([None, 0, 5, 6]), rnd.choice([None, 0.0, 50.0, 75.0]),
            rnd.choice([None, datetime.date(2000, 1, 1), datetime.date(2001, 6, 2), datetime.date(2002, 1, 1)]), make, rnd.sample(MAKES, 2) if make == "honda city" else [], rto,
            rnd.sample(RTOS, rnd.randint(1, 2)) if rto == "mh01" else [], rnd.choice([None, 0.0, 20.0, 500.0]), rnd.choice([None, 0.0, 750.0]), rnd.choice(["YES", "NO", None])))
    schema = ("row_id long, insurer string, vehproduct string, sub_product string, fuel string, vehicle_class string, cc double, cc_combined boolean, seating double, vehicle_age int, tariff double, inception date, "
              "make_model string, make_names array<string>, rto string, rto_names array<string>, ncb double, cpa double, zd string, age_label string, cc_label string, rto_raw string, nil_dep string")
    return spark.createDataFrame([(*r, "age", "cc", "x", "y") for r in rows], schema)


def _pairs(policies, rates, chain):
    """Every policy against every rate of its insurer, a bit per rule."""
    return policies.join(rates, F.col("insurer") == F.col("r_insurer")).withColumn("own", J.mask_of(chain.rules))


@pytest.fixture(params=[(16_384, 16_384), (7, 5)], ids=["whole", "sharded"])
def cut(request, monkeypatch):
    monkeypatch.setattr(B, "SHARD_RATES", request.param[0])
    monkeypatch.setattr(B, "SLICE_POLICIES", request.param[1])


def test_motor_chain(spark, cut):
    rnd = random.Random(31)
    rates, policies, chain = J.with_group_places(_card(spark, 90, rnd)), _policies(spark, 260, rnd), J.motor_chain()
    pairs = _pairs(policies, rates, chain).cache()
    want = {r["row_id"]: r["m"] for r in pairs.groupBy("row_id").agg(F.max("own").alias("m")).collect()}
    assert {r["row_id"]: r["mask"] for r in J.indexed_masks(policies, rates, chain).collect()} == want and len(set(want.values())) > 20
    full = 2 ** len(chain.rules) - 1
    hits = {}
    for r in pairs.where(F.col("own") == full).select("row_id", "r_id", "r_group", "r_payout", "r_place").collect():
        hits.setdefault(r["row_id"], []).append(r)
    assert hits
    by_id = {r["r_id"]: r for r in rates.collect()}
    for row in J.matched_groups(policies, rates, chain, J.motor_payload()).collect():
        own = hits.get(row["row_id"], [])
        assert row["mask"] == want[row["row_id"]] and row["group_count"] == len({h["r_group"] for h in own}) and (row["row_count"] or 0) == len(own)
        if own:
            low = min(h["r_group"] for h in own)
            place = min(h["r_place"] for h in own if h["r_group"] == low)
            used = next(r for r in by_id.values() if r["r_group"] == low and r["r_place"] == place)
            assert (row["group_key"], row["rate_row"]["r_po_net_rate"]) == (low, used["r_po_net_rate"])
            assert row["same_payout"] == (len({h["r_payout"] for h in own}) == 1) and row["group_keys"] == sorted({h["r_group"] for h in own})
        else:
            assert row["group_key"] is None and row["rate_row"] is None and row["group_keys"] == []


def test_health_chain(spark, cut):
    rnd = random.Random(5)
    day = datetime.date(2000, 1, 1)
    rates = spark.createDataFrame(
        [(i + 1, rnd.choice(["acme", "beta"]), rnd.choice(["", "gold", "gold plus"]), rnd.choice(["", "family"]), rnd.choice(["", "z1", "z1,z2"]), rnd.choice(["", "fresh"]), rnd.choice(["", "gold,silver"]),
          *[rnd.choice([None, 0.0, 10.0]) for _ in range(6)], 20.0, None, 11.0, 12.0, 13.0, 14.0, rnd.choice([None, day]), None) for i in range(70)],
        "r_id long, r_insurer string, r_product_name string, r_policy_category string, r_pincode_zone string, r_business_type string, r_plan_names string, r_min_deductible double, r_max_deductible double, "
        "r_min_sum_insured double, r_max_sum_insured double, r_min_age double, r_max_age double, r_payin_rate double, r_one_year_rate double, r_multi_year_2_rate double, r_multi_year_3_rate double, "
        "r_multi_year_4_rate double, r_multi_year_5_rate double, r_from_date date, r_to_date date")
    features = spark.createDataFrame(
        [(i, "x", rnd.choice(["acme", "beta", None]), "gold", rnd.sample(["gold", "gold plus"], rnd.randint(0, 2)), "family", rnd.sample(["family"], rnd.randint(0, 1)), "fresh", ["fresh"], plan := rnd.choice(["", "gold"]),
          rnd.choice([None, 5.0]), rnd.choice([None, 10.0]), 3.0, pin := rnd.choice(["", "400001"]), ["z2"] if pin else [], rnd.choice([day, None]), rnd.choice([None, 0, 1, 3]), plan) for i in range(120)],
        "row_id long, insurer_raw string, insurer string, product_name string, product_name_matches array<string>, policy_category string, policy_category_matches array<string>, business_type string, "
        "business_type_matches array<string>, plan_name string, deductible double, sum_assured double, age double, pincode string, zones array<string>, inception date, tenure int, plan string")
    features = features.withColumn("plan_matches", F.when(F.col("plan") == "", F.array().cast("array<string>")).otherwise(F.array(F.sha2(F.lit("gold,silver"), 256)))).drop("plan")
    chain = H.health_chain()
    pairs = _pairs(features, rates, chain).cache()
    want = {r["row_id"]: r["m"] for r in pairs.groupBy("row_id").agg(F.max("own").alias("m")).collect()}
    assert {r["row_id"]: r["mask"] for r in J.indexed_masks(features, rates, chain).collect()} == want and len(set(want.values())) > 5
    hits = {}
    for r in pairs.where((F.col("own") == 2 ** len(chain.rules) - 1) & F.col("tenure").between(1, 5)).select("row_id", "r_id").collect():
        hits.setdefault(r["row_id"], set()).add(r["r_id"])
    got = {r["row_id"]: r for r in H.map_health_features(features, rates).collect()}
    assert len(got) == 120 and hits
    for row_id, row in got.items():
        own = hits.get(row_id, set())
        assert (row["mapping_status"] == J.K.NO_MATCH) == (not own)
        if row["mapping_status"] == J.K.MATCH:
            assert row["display_group_id"] == min(own)
        elif own:
            assert row["match_ids"] == sorted(own)



def test_health_matches_are_counted_where_they_are_found(spark, monkeypatch):
    day, names = datetime.date(2000, 1, 1), "r_min_deductible r_max_deductible r_min_sum_insured r_max_sum_insured r_min_age r_max_age".split()
    rates = spark.createDataFrame(
        [(i, "acme", "", "", "", "", "", *[None] * 6, 20.0, 9.0 if i == 7 else 5.0, 6.0, None, None, None, None, None) for i in [*range(1, 30), 30, 30]],
        "r_id long, r_insurer string, r_product_name string, r_policy_category string, r_pincode_zone string, r_business_type string, r_plan_names string, "
        + ", ".join(f"{n} double" for n in names) + ", r_payin_rate double, r_one_year_rate double, r_multi_year_2_rate double, r_multi_year_3_rate double, "
        "r_multi_year_4_rate double, r_multi_year_5_rate double, r_from_date date, r_to_date date")
    features = spark.createDataFrame(
        [(i, "x", "acme", "", [], "", [], "", [], "", 1.0, 1.0, 1.0, "", [], day, tenure, []) for i, tenure in enumerate([1, 2, 3, 6, None])],
        "row_id long, insurer_raw string, insurer string, product_name string, product_name_matches array<string>, policy_category string, policy_category_matches array<string>, business_type string, "
        "business_type_matches array<string>, plan_name string, deductible double, sum_assured double, age double, pincode string, zones array<string>, inception date, tenure int, plan_matches array<string>")
    asked = []
    monkeypatch.setattr(H, "narrowed", lambda *args, **kw: asked.append(kw.get("groups")) or B.narrowed(*args, **kw))
    for card, n, ids in ((rates.where("r_id < 30"), 29, list(range(1, 30))), (rates, 33, [*range(1, 30), 30, 30, 30, 30])):
        got = {r["row_id"]: r for r in H.map_health_features(features, card).collect()}
        assert [got[i]["mapping_status"] for i in range(5)] == [J.K.MULTIPLE, J.K.MATCH, J.K.MATCH, J.K.NO_MATCH, J.K.NO_MATCH]
        assert got[0]["match_ids"] == ids and f"({n} rows)" in got[0]["failure_reason"] and f"(+{n - 10} more)" in got[0]["failure_reason"]
        assert [(got[i]["display_group_id"], got[i]["po_rate"], got[i]["pi_rate"], got[i]["tied_groups"]) for i in (1, 2)] == [(1, 6.0, 20.0, n), (1, None, 20.0, n)]
        shown = {r["row_id"]: r for r in H.map_health_features(features, card, all_ids=False).collect()}
        assert shown[0]["match_ids"] == ids[:10] and all(shown[i]["failure_reason"] == got[i]["failure_reason"] for i in range(5))
    # no match is handed on by itself
    assert all(asked)


def test_index_without_rows(spark):
    rnd = random.Random(1)
    rates, policies, chain = J.with_group_places(_card(spark, 3, rnd)), _policies(spark, 5, rnd), J.motor_chain()
    assert J.indexed_masks(policies, rates.limit(0), chain).collect() == []
    assert J.matched_groups(policies.limit(0), rates, chain, J.motor_payload()).collect() == []


def test_gaps_tell_long_group_lists_apart(spark):
    ids = list(range(10, 20))
    text = "Multiple Rate Master groups matched (11 groups, 11 rows total). Matching Group IDs: " + ", ".join(map(str, ids)) + " … (+1 more)"
    rows = [(1, J.K.MULTIPLE, text, [*ids, 77]), (2, J.K.MULTIPLE, text, [*ids, 88]), (3, J.K.MULTIPLE, text, [*ids, 88]), (4, J.K.NO_MATCH, "Failed on: Policy: cpa — CPA value 'x' is off", [])]
    mapped = spark.createDataFrame(rows, "row_id long, mapping_status string, failure_reason string, match_ids array<long>")
    got = sorted((r["kind"], r["group_ids"][-1:], r["n"]) for r in G.coverage_gaps(mapped).collect())
    assert got == [("multiple_matches", [77], 1), ("multiple_matches", [88], 2), ("no_match", [], 1)]


def test_first_pairs_of_large_profiles(spark):
    """Capped listings of few large profiles, which conflict in every way, form about as many pairs as they list."""
    from ratecraft.operators import overlap as O

    rnd = random.Random(9)
    kinds = [("a", None), ("a", 3.0), ("a", 5.0), ("b", None)]
    rows = []
    for k in rnd.sample(range(1, 3000), 400):
        tnc, low = kinds[0] if rnd.random() < .6 else rnd.choice(kinds)
        rows.append((k, f"p{tnc}{low}", rnd.choice(["Acme"]), 1, tnc, low))
    groups = spark.createDataFrame(rows, "grid_key long, profile string, insurer_display string, row_count long, tnc string, low double")
    names = sorted({r[1] for r in rows})
    pairs = [(x, y, rnd.choice(["PARTIAL", "CONTAINED", None])) for i, x in enumerate(names) for y in names[i + 1 :]]
    pairs[0] = (*pairs[0][:2], "PARTIAL")
    typed = spark.createDataFrame(pairs, "a_profile string, b_profile string, conflict_type string")
    every = {}
    for r in O.list_pairs(groups, typed).collect():
        every.setdefault(r["conflict_type"], []).append((r["insurance_company"], r["group_key_a"], r["group_key_b"]))
    for cap in (1, 7, 150):
        caps = dict.fromkeys(O.K.CONFLICT_SEVERITY, cap)
        got = {}
        for r in O.list_pairs(groups, typed, caps).collect():
            got.setdefault(r["conflict_type"], []).append((r["insurance_company"], r["group_key_a"], r["group_key_b"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:cap] for k, v in every.items()}
        formed = {r["conflict_type"]: r["count"] for r in O._first_pairs(groups, typed.where("conflict_type IS NOT NULL"), caps).groupBy("conflict_type").count().collect()}
        assert all(n <= 2 * cap + 400 for n in formed.values()) and max(map(len, every.values())) > 10_000
