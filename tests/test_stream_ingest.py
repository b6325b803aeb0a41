"""The streamed ingest against what a batch run of the same uploads inserts."""

import pytest
from pyspark.sql import functions as F

from ratecraft.operators import maintain as M
from ratecraft.streaming import ingest as S
from test_ingest import ROW, masters, places, upload_of  # noqa: F401


class Job:
    def __init__(self, spark, folder, masters, places):
        self.spark, self.folder, self.arrived = spark, str(folder / "job"), str(folder / "arrived")
        self.masters, self.n = lambda: (masters, *places), 0

    def arrive(self, rows):
        """One upload file."""
        self.shape = upload_of(self.spark, rows).drop("line")
        self.shape.coalesce(1).write.mode("append").parquet(self.arrived)

    def run(self, per_batch=20):
        kinds = ", ".join(f"{f.name} string" for f in self.shape.schema)
        S.run_ingest(S.rate_uploads(self.spark, self.arrived, kinds, per_batch, "parquet"), self.folder, self.masters)
        typed = M.typed_upload(upload_of(self.spark, []))
        self.kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed.schema)
        rows = S.ingested_rates(self.spark, self.folder, self.kind).collect()
        outcomes = sorted((r.success, r.rows, r.problem) for r in S.ingest_outcomes(self.spark, self.folder).collect())
        return rows, outcomes


@pytest.fixture
def job(spark, tmp_path, masters, places):  # noqa: F811
    return Job(spark, tmp_path, masters, places)


def test_replays_groups_and_rejection(job):
    job.arrive([ROW, {**ROW, "product": "private car", "fuel_type": "1"}, {**ROW, "fuel_type": "CNG"}, {**ROW, "pi_net_rate": "6"}])
    job.arrive([{**ROW, "fuel_type": "Steam", "pi_net_rate": "8"}, {**ROW, "new_rto_list": "nowhere"}])
    rows, outcomes = job.run()
    problem = "RTO 'nowhere' does not exist in RTOMaster. Please add it first."
    assert outcomes == [(False, 0, problem), (True, 3, None)]
    assert sorted((r.product, r.fuel_type, r.pi_net_rate) for r in rows) == [("Private Car", "CNG", 5.0), ("Private Car", "Petrol", 5.0), ("Private Car", "Petrol", 6.0)]
    assert len({r.group_id for r in rows}) == 3
    # the same again, in another order, with one new row; a name of the first run keeps its spelling, and Steam was never added
    job.arrive([{**ROW, "pi_net_rate": "6"}, {**ROW, "fuel_type": "cng", "pi_net_rate": "7"}, {**ROW, "fuel_type": "cng"}, ROW])
    again, outcomes = job.run()
    assert outcomes == [(False, 0, problem), (True, 1, None), (True, 3, None)]
    assert {tuple(r) for r in rows} < {tuple(r) for r in again} and len(again) == 4
    assert [r.fuel_type for r in again if r.pi_net_rate == 7] == ["CNG"]
    assert sorted(r.name for r in S._table(job.spark, f"{job.folder}/members", S.MEMBER).collect()) == ["CNG"]


def test_group_is_shared_by_rto_lists_and_batches(job, spark):
    rto = spark.createDataFrame([("North",), ("South",)], "name string")
    dimensions, _, makes = job.masters()
    job.masters = lambda: (dimensions, rto, makes)
    for name in ("north", "south", "north, south"):
        job.arrive([{**ROW, "new_rto_list": name}, {**ROW, "new_rto_list": name, "remarks": "a copy that differs elsewhere"}])
    rows, outcomes = job.run(per_batch=1)
    assert len(rows) == 3 and len({r.group_id for r in rows}) == 1 and {r.remarks for r in rows} == {None}
    assert outcomes == [(True, 1, None)] * 3


def test_table_before_the_job_blocks_its_rows_and_keeps_its_groups(job, spark):
    typed = M.typed_upload(upload_of(spark, [{**ROW, "product": "Private Car", "fuel_type": "Petrol"}, {**ROW, "product": "Private Car", "fuel_type": "Diesel"}])).drop("line")
    old = typed.withColumns({"status": F.when(F.col("fuel_type") == "Petrol", F.lit("ACTIVE")).otherwise(F.lit("INACTIVE")), "upload_batch": F.lit("old")})
    old = old.withColumn("key_hash", M.group_hash(old))
    old = old.withColumn("group_id", F.when(F.col("fuel_type") == "Petrol", F.lit(700)).otherwise(F.lit(3)))
    cng = M.typed_upload(upload_of(spark, [{**ROW, "product": "Private Car", "fuel_type": "CNG"}])).select("key_hash", F.lit(41).alias("group_id"))
    S.feed_groups(cng, job.folder)
    S.feed_table(old, job.folder)
    job.arrive([ROW, {**ROW, "fuel_type": "2"}, {**ROW, "fuel_type": "CNG"}])
    rows, _ = job.run()
    # Petrol is live under another batch; Diesel is there but not live; CNG belongs to a group of the table
    assert sorted(r.fuel_type for r in rows) == ["CNG", "Diesel"]
    ids = {r.fuel_type: r.group_id for r in rows}
    assert ids["CNG"] == 41 and ids["Diesel"] > 700
    # once the row is no longer live, its content may come again
    S.feed_table(old.withColumn("status", F.lit("INACTIVE")), job.folder)
    job.arrive([ROW])
    rows, _ = job.run()
    assert sorted(r.fuel_type for r in rows) == ["CNG", "Diesel", "Petrol"]


def test_retried_batch_keeps_its_decision_and_adds_nothing(job, spark):
    job.arrive([ROW, {**ROW, "pi_net_rate": "6"}])
    first, outcomes = job.run()
    batch = spark.read.parquet(job.arrived).select("*", F.col("_metadata.file_path").alias("upload_id"), F.col("_metadata.file_block_start").alias("block"))
    dimensions, rto, makes = job.masters()
    # masters changed meanwhile: what was decided holds
    S.check_batch(batch, 0, job.folder, lambda: (dimensions, rto.limit(0), makes))
    again, after = job.run()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and outcomes == after == [(True, 2, None)]


def test_nothing_arrives(job, spark):
    job.arrive([])
    rows, outcomes = job.run()
    assert rows == [] and outcomes == []


def test_no_row_of_a_batch_is_looked_up_by_its_line(job, spark, monkeypatch):
    """Such a join would send all lines of a batch to every task: files of repeated cells are small, so Spark may broadcast them."""
    job.arrive([ROW, {**ROW, "pi_net_rate": "six"}])
    job.arrive([{**ROW, "fuel_type": "CNG"}])
    batch = spark.read.parquet(job.arrived).select("*", F.col("_metadata.file_path").alias("upload_id"), F.col("_metadata.file_block_start").alias("block"))
    keys, join = [], type(batch).join

    def spied(self, other, on=None, how=None):
        keys.extend([on] if isinstance(on, str) else on or [])
        return join(self, other, on, how)

    monkeypatch.setattr(type(batch), "join", spied)
    S.check_batch(batch, 0, job.folder, job.masters)
    assert "upload_id" in keys and "line" not in keys
    outcomes = sorted((r.success, r.problem) for r in S._table(spark, f"{job.folder}/outcome", S.OUTCOME).collect())
    assert outcomes == [(False, "pi_net_rate value 'six' is not a valid number."), (True, None)]
