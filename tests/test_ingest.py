"""Rate uploads applied to a table as one job."""

import pytest
from pyspark.sql import functions as F

from ratecraft.operators import maintain as M
from ratecraft.plans import ingest as I
from ratecraft.session import stage


def upload_of(spark, rows):
    """All-text upload rows with the given cells, every other cell empty."""
    cells = ["insurance_company", "new_rto_list", "from_date", "to_date", "user_id", "upload_batch_id", *M.TEXT_FIELDS, *M.NUMBER_FIELDS, *M.CODE_FIELDS]
    kinds = ", ".join(["line bigint", *[f"{c} string" for c in dict.fromkeys(cells)]])
    return spark.createDataFrame([(n, *[r.get(c, "") for c in dict.fromkeys(cells)]) for n, r in enumerate(rows)], kinds)


@pytest.fixture
def masters(spark):
    names = spark.createDataFrame([(1, "Petrol"), (2, "Diesel")], "id bigint, name string")
    products = spark.createDataFrame([(7, "Private Car")], "id bigint, name string")
    return {"product": products, "fuel_type": names}


@pytest.fixture
def places(spark):
    return spark.createDataFrame([("North",)], "name string"), spark.createDataFrame([("cars",)], "name string")


def apply(spark, rows, masters, places, existing=None, groups=None):
    up = upload_of(spark, rows)
    existing = M.typed_upload(up.limit(0)) if existing is None else existing.drop("group_id")
    groups = spark.createDataFrame([], "group_id bigint, key_hash string") if groups is None else groups
    return I.ingest_rates(up, existing, groups, masters, *places)


ROW = {"insurance_company": "acme", "new_rto_list": "north", "new_vehicle_makes": "Cars", "product": "7", "fuel_type": "PETROL", "pi_net_rate": "5"}


def test_ids_and_names_are_one_member_and_replays_insert_nothing(spark, masters, places):
    rows = [ROW, {**ROW, "product": "private car", "fuel_type": "1"}, {**ROW, "fuel_type": "CNG"}, {**ROW, "fuel_type": "cng", "pi_net_rate": "6"}, {**ROW, "product": "99", "fuel_type": ""}]
    done = apply(spark, rows, masters, places)
    got = sorted((r.line, r.product, r.fuel_type) for r in done.inserted.collect())
    assert got == [(0, "Private Car", "Petrol"), (2, "Private Car", "CNG"), (3, "Private Car", "CNG"), (4, None, None)]
    assert [tuple(r) for r in done.new_members.collect()] == [("fuel_type", "CNG")]
    assert sorted(r.group_id for r in done.inserted.collect()) == [1, 2, 3, 4]
    groups = done.inserted.select("group_id", "key_hash").distinct()
    again = apply(spark, rows, masters, places, done.inserted, groups)
    assert again.inserted.count() == 0
    assert tuple(again.outcome.first()) == (True, 0, None)


def test_group_of_a_known_rule_is_kept(spark, masters, places):
    first = apply(spark, [ROW], masters, places)
    groups = first.inserted.select("group_id", "key_hash")
    north = (places[0].unionByName(spark.createDataFrame([("South",)], "name string")), places[1])
    more = apply(spark, [{**ROW, "new_rto_list": "South"}, {**ROW, "pi_net_rate": "9"}], masters, north, first.inserted, groups)
    assert sorted((r.line, r.group_id) for r in more.inserted.collect()) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("cell, problem", [
    ({"new_rto_list": "north, nowhere"}, "RTO 'nowhere' does not exist in RTOMaster. Please add it first."),
    ({"new_vehicle_makes": "boats"}, "Vehicle Make 'boats' does not exist in MakeModelMaster. Please add it first."),
    ({"pi_net_rate": "five"}, "pi_net_rate value 'five' is not a valid number."),
])
def test_any_problem_rejects_the_whole_upload(spark, masters, places, cell, problem):
    done = apply(spark, [ROW, {**ROW, "fuel_type": "CNG", **cell}], masters, places)
    assert tuple(done.outcome.first()) == (False, 0, problem)
    assert done.inserted.count() == 0 and done.new_members.count() == 0


def test_empty_upload(spark, masters, places):
    done = I.ingest_rates(upload_of(spark, [ROW]).where(F.lit(False)), M.typed_upload(upload_of(spark, [])), spark.createDataFrame([], "group_id bigint, key_hash string"), masters, *places)
    assert tuple(done.outcome.first()) == (True, 0, None)


def test_lines_of_a_small_file_are_dealt_to_all_tasks(spark, masters, places, tmp_path, monkeypatch):
    upload_of(spark, [{**ROW, "pi_net_rate": str(n)} for n in range(400)]).coalesce(1).write.parquet(str(tmp_path / "upload"))
    one_file = spark.read.parquet(str(tmp_path / "upload"))
    files = []
    monkeypatch.setattr(I, "stage", lambda df: files.append(len((made := stage(df)).inputFiles())) or made)
    done = I.ingest_rates(one_file, M.typed_upload(one_file.limit(0)), spark.createDataFrame([], "group_id bigint, key_hash string"), masters, *places)
    assert one_file.rdd.getNumPartitions() == 1 and files[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tuple(done.outcome.first()) == (True, 400, None)
