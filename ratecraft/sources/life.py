"""Life payout grids stored as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

ROW = """Row_ID bigint, Insurer string, InsurerDisplay string, InsurerCode string, Category string, Product_Name string, Variant string,
PPT string, PT string, Base_Payout_Yr1 string, Renewal_Yr2 string, Renewal_Yr3 string, Renewal_Yr4 string, Renewal_Yr5 string,
Renewal_Yr6_Plus string, Row_Specific_Remarks string, Sheet_Level_Notes_And_Conditions string, All_Renewal_Years_Raw string"""
PAYOUTS = ["Base_Payout_Yr1", "Renewal_Yr2", "Renewal_Yr3", "Renewal_Yr4", "Renewal_Yr5", "Renewal_Yr6_Plus"]


def read_life_grid(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Rows of ``{meta, rows: [...]}`` files; a payout is a number, a text, or NULL. A missing path is an
    error, or no rows where the caller allows for it.

    A file is one variant, whose rows are handed out one by one; a file without rows gives none, a field of another type NULL.
    """
    fields = [c.split() for c in ROW.replace("\n", " ").split(",")]
    try:
        files = spark.read.option("singleVariantColumn", "doc").option("multiLine", True).json(path)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return typed_payouts(spark.createDataFrame([], ROW))
    listed = files.select(F.try_variant_get("doc", "$.rows", "variant").alias("listed"))
    rows = listed.lateralJoin(spark.tvf.variant_explode(F.col("listed").outer()))
    return typed_payouts(rows.select(*[F.try_variant_get("value", f"$.{n}", t).alias(n) for n, t in fields]))


def typed_payouts(rows: DataFrame) -> DataFrame:
    """Every payout as a number column of its own name and, where it is no number, a ``<name>_text`` column."""
    numbers = {c: F.col(c).try_cast("double") for c in PAYOUTS}
    texts = {f"{c}_text": F.when(F.col(c).try_cast("double").isNull(), F.col(c)) for c in PAYOUTS}
    return rows.withColumns(texts).withColumns(numbers)
