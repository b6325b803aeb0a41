"""The policy view on tables of its own: the same rows, whatever the size of its tasks."""

import datetime

from catalog import bridge
from catalog.registry import Source
from ratecraft.operators import resolve as R


def _tables(spark, folder):
    day = datetime.datetime(1996, 3, 1)
    lines = [(k, k % 3 if k % 5 else None, k % 4, k % 7, float(k % 50), 100.0 * k, 0.05, 0.02, "RNA"[k % 3], "OF"[k % 2], day) for k in range(40)]
    lines += lines[:6] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", day)]
    one = {
        "lineitem": (lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                            "l_linestatus string, l_shipdate timestamp"),
        "orders": ([(k, k % 3 if k % 6 else None, day) for k in range(30)] + [(3, 0, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "part": ([(k, f"big ring {k}", "SMALL") for k in (0, 1, 2, 2)], "p_partkey long, p_name string, p_type string"),
        "customer": ([(k, k, "BUILDING") for k in range(3)], "c_custkey long, c_nationkey long, c_mktsegment string"),
    }
    for name, (rows, schema) in one.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_large_tables_are_cut_into_more_tasks(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    read = lambda: Source(spark, str(tmp_path)).policy
    want = sorted(map(repr, read().collect()))
    monkeypatch.setattr(bridge, "LINES_PER_TASK", 5)
    large = read()
    assert sorted(map(repr, large.collect())) == want and len(want) > 20
    assert "REPARTITION_BY_NUM" in large._jdf.queryExecution().toString() and large.select("row_id", "rto").rdd.getNumPartitions() == 10


def test_code_terms_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            read.add(row.num_rows)
            yield row

    terms = spark.createDataFrame([("mh01",), ("dl 1",), ("",), ("mh01",)], "term string").mapInArrow(count, "term string")
    master = spark.createDataFrame([("West", "MH01, DL 1 X"), ("North", "DL 1")], "name string, cluster string")
    assert sorted(map(tuple, R.resolve_codes(terms, master).collect())) == [("DL 1", "north"), ("DL 1", "west"), ("MH01", "west")]
    assert read.value == 4
