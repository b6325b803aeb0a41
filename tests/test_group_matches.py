"""Matches counted by group where they are found, against the same matches listed one by one."""

import random

import pytest
from pyspark.sql import functions as F

from ratecraft.operators import bitmap as B, gaps as G, rulejoin as J
from tests.test_bitmap import _card, _pairs, _policies


@pytest.fixture(params=[{}, {"BRANCH": 0}, {"BRANCH": 0, "SET_BYTES": 0, "PAIRS": 3, "SHARD_RATES": 11, "SLICE_POLICIES": 9}], ids=["finished", "walked", "cut"])
def way(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(B, name, value)


def test_one_row_a_policy(spark, way):
    rnd = random.Random(8)
    rates, policies, chain = J.with_group_places(_card(spark, 500, rnd)), _policies(spark, 200, rnd), J.motor_chain()
    tests = [rule.test for rule in chain.rules]
    hits = {}
    for r in _pairs(policies, rates, chain).where(F.col("own") == 2 ** len(chain.rules) - 1).select("row_id", "r_group", "r_payout", "r_place").collect():
        hits.setdefault(r["row_id"], []).append(r)
    found = B.narrowed(policies, rates, tests, "insurer", "row_id", groups=B.Groups(shown=1)).collect()
    listed = {}
    for r in found:
        assert len(r["group_keys"]) == min(1, r["group_count"])
        listed.setdefault(r["row_id"], []).append(r)
    assert any(len({h["r_group"] for h in own}) > 1 for own in hits.values())
    for row_id, rows in listed.items():
        own = hits.get(row_id, [])
        assert sum(r["row_count"] for r in rows) == len(own) and sum(r["group_count"] for r in rows) == len({h["r_group"] for h in own})
        if own:
            best = min((r for r in rows if r["group_count"]), key=lambda r: r["group_key"])
            low = min(h["r_group"] for h in own)
            assert (best["group_key"], best["used"]) == (low, min(h["r_place"] for h in own if h["r_group"] == low))
            assert min(r["low_payout"] for r in rows if r["group_count"]) == min(h["r_payout"] for h in own)
            assert max(r["high_payout"] for r in rows if r["group_count"]) == max(h["r_payout"] for h in own)
    if B.SHARD_RATES > 500:
        assert len(found) == len(listed)


def test_policies_that_share_a_key(spark):
    rnd = random.Random(8)
    rates, policies, chain = J.with_group_places(_card(spark, 500, rnd)), _policies(spark, 200, rnd), J.motor_chain()
    shared = policies.withColumn("row_id", F.when(F.col("row_id") >= 20, F.col("row_id") % 90))
    hits, masks = {}, {}
    for r in _pairs(shared, rates, chain).select("row_id", "own", "r_group").collect():
        masks[r["row_id"]] = max(masks.get(r["row_id"], 0), r["own"])
        if r["own"] == 2 ** len(chain.rules) - 1:
            hits.setdefault(r["row_id"], []).append(r["r_group"])
    got = {r["row_id"]: r for r in J.matched_groups(shared, rates, chain, J.motor_payload()).collect()}
    assert set(got) == set(masks) and None in got
    for row_id, row in got.items():
        own = hits.get(row_id, [])
        assert (row["mask"], row["group_count"], row["row_count"] or 0, row["group_keys"]) == (masks[row_id], len(set(own)), len(own), sorted(set(own)))


def test_gaps_read_the_mapped_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(1, J.K.NO_MATCH, "Failed on: Policy: cpa — CPA value 'x' is off | Also failed on: Policy: fuel — Value 'y' is off", []), (2, J.K.NO_MATCH, " odd ", []), (3, J.K.MATCH, "fine", []),
            (4, J.K.MULTIPLE, "Multiple Rate Master groups matched (2 groups, 2 rows total). Matching Group IDs: 5, 6", [5, 6]), (5, None, "Failed on: Policy: fuel — Value 'y' is off", [])]
    schema = "row_id long, mapping_status string, failure_reason string, match_ids array<long>"
    mapped = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    got = sorted(tuple(r) for r in G.gap_counts(mapped).collect())
    assert got == [("multiple_matches", "", "5, 6", [5, 6], 1), ("no_match", "Other", "odd", [], 1), ("no_match", "Policy: cpa", "x", [], 1), ("no_match", "Policy: fuel", "y", [], 1)]
    assert read.value == len(rows)


def test_lists_of_ids_are_kept_apart_and_counted_by_name(spark):
    from pyspark.sql import functions as F

    from ratecraft import constants as K
    from ratecraft.operators import gaps as G, rulejoin as J

    # two shards for policies 1 and 2, one for 3 and 4, none for 5
    found = spark.createDataFrame(
        [(1, list(range(0, 40, 2))), (1, [1, 3]), (2, [1, 3]), (2, list(range(0, 40, 2))), (3, [1, 3]), (4, [1, 3]), (5, [])], "row_id long, group_keys array<long>")
    lists = J.Lists("row_id", "motor")
    named = lists.named(found)
    assert max(len(r["group_keys"]) for r in named.collect()) == J.SHOWN_IDS
    every = lists.all()
    assert sorted(r["ids"] for r in every.collect()) == [sorted([*range(0, 40, 2), 1, 3]), [1, 3]]
    other = J.Lists("row_id", "health")
    of_health = other.named(found.where("row_id = 3").withColumn("row_id", F.lit(6).cast("long")))
    names = named.unionByName(of_health).groupBy("row_id").agg(*J.list_names(named))
    every = every.unionByName(other.all())
    assert every.count() == every.select("list_ids").distinct().count() == 3

    mapped = names.where("row_id <> 5").select(
        F.lit(K.MULTIPLE).alias("mapping_status"), F.lit("Multiple Rate Master groups matched. Matching Group IDs: x").alias("failure_reason"), F.col("list_ids").alias("match_ids"))
    mapped = mapped.unionByName(spark.range(2).select(
        F.lit(K.NO_MATCH).alias("mapping_status"), F.lit("Failed on: Policy: rto no — RTO 'x' is bad").alias("failure_reason"), F.array().cast("array<binary>").alias("match_ids")))
    got = sorted((r["kind"], len(r["group_ids"]), r["n"]) for r in G.coverage_gaps(mapped, lists=every).collect())
    assert got == [("multiple_matches", 2, 3), ("multiple_matches", 22, 2), ("no_match", 0, 2)]
