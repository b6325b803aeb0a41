"""Life grid files as they are written elsewhere."""

import json

import pytest
from pyspark.errors import AnalysisException

from ratecraft.sources import life as LS


def test_grid_files(spark, tmp_path):
    folder = tmp_path / "grids"
    folder.mkdir()
    rows = [{"Row_ID": 1, "Insurer": "A, B", "Base_Payout_Yr1": 0.25, "Renewal_Yr2": "as agreed", "More": [1, {"x": "]}"}]},
            {"Row_ID": 2, "Base_Payout_Yr1": "0.5", "Product_Name": None, "PPT": 10}, {"Row_ID": "no number"}]
    (folder / "a.json").write_text(json.dumps({"meta": {"n": 3}, "rows": rows}, indent=2))
    (folder / "b.json").write_text(json.dumps({"rows": []}))
    (folder / "c.json").write_text(json.dumps({"meta": {}}))
    got = LS.read_life_grid(spark, str(folder)).select("Row_ID", "Insurer", "PPT", "Base_Payout_Yr1", "Renewal_Yr2", "Renewal_Yr2_text")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "A, B", None, 0.25, None, "as agreed"), (2, None, "10", 0.5, None, None), (None, None, None, None, None, None)]


def test_missing_grid(spark, tmp_path):
    with pytest.raises(AnalysisException):
        LS.read_life_grid(spark, str(tmp_path / "none"))
    assert LS.read_life_grid(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
