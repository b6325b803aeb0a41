"""Stored tables: what a change rewrites, retries, and what a failed try leaves."""

import pytest
from pyspark.sql import functions as F

from ratecraft.sources.stored import StoredTable

KIND = "id bigint, group_id bigint, status string"


@pytest.fixture
def table(spark, tmp_path):
    made = StoredTable(spark, str(tmp_path / "rates"), KIND, buckets=8)
    made.insert("load", spark.range(100).select("id", (F.col("id") % 10 + 1000).alias("group_id"), F.lit("ACTIVE").alias("status")))
    return made


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_a_change_rewrites_its_buckets_only_and_once(table, spark):
    first = rows(table.read())
    keys = spark.createDataFrame([(1003,), (5,)], "wanted bigint")
    assert table.set_field("edit", spark.createDataFrame([(5,)], "wanted bigint"), "status", " inactive ") == 2
    folders = {r.bucket: r.folder for r in table.manifests().where("version = 2 AND bucket >= 0").collect()}
    assert sorted(folders.values()).count(2) == 1 and len(folders) == 8
    assert rows(table.read()) == [(i, g, "INACTIVE" if i == 5 else s) for i, g, s in first]
    # a retry finds its version, whatever it would do now; the version before stays readable
    assert table.set_field("edit", keys, "status", "INACTIVE") == 2
    assert table.version() == 2 and rows(table.read(1)) == first
    table.set_field("groups", keys, "status", "INACTIVE")
    assert {i for i, g, s in rows(table.read()) if s == "INACTIVE"} == {i for i, g, _ in first if g == 1003} | {5}


def test_upsert_purge_and_empty(table, spark):
    more = spark.createDataFrame([(7, 1, "NEW"), (500, 2, "NEW"), (None, 3, "NEW")], KIND)

    def apply(old, new):
        return old.join(new, "id", "left_anti").unionByName(new)

    for _ in range(2):
        table.upsert("up", more, apply)
    got = rows(table.read().where("status = 'NEW'").fillna({"id": -1}))
    assert got == [(-1, 3, "NEW"), (7, 1, "NEW"), (500, 2, "NEW")] and table.read().count() == 102
    table.purge("none", F.col("id") == 12345)
    assert table.read().count() == 102
    table.purge("null ids are not above zero", F.col("id") >= 0)
    assert rows(table.read()) == [(None, 3, "NEW")]
    table.purge("all", F.lit(True))
    assert table.read().count() == 0
    table.insert("again", more)
    assert table.read().count() == 3


def test_rows_of_a_failed_try_are_written_over(table, spark):
    before = rows(table.read())
    spark.createDataFrame([(1, 1, "LEFT", b) for b in range(8)], f"{KIND}, bucket int").write.partitionBy("bucket").parquet(f"{table.path}/data/folder=2")
    assert rows(table.read()) == before
    table.purge("p", F.col("id") == 3)
    assert rows(table.read()) == [r for r in before if r[0] != 3]


def test_a_change_may_not_move_rows(table, spark):
    with pytest.raises(ValueError, match="did not touch"):
        table.commit("move", spark.createDataFrame([(1,)], "id bigint"), lambda old: old.withColumn("id", F.col("id") + 1))
    assert table.version() == 1
