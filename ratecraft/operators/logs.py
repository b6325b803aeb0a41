"""Points-search logs as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft import constants as K
from ratecraft.functions import clusters as C
from ratecraft.functions.documents import search_params

DIMENSION_PARAMS = ["product", "sub_product", "make_model_class", "fuel"]
TEXT_PARAMS = [
    "target_date", "vehicle_no", "policy_holder_name", "make_names", "rto_code", "mfg_year", "cc", "sc", "sum_insured", "age",
    "pincode", "policy_term",
]


def points_log(log: DataFrame, now: Column, kind: str = "", **contains: str) -> DataFrame:
    """Search entries of the retention window, newest first where listed; ``contains`` filters on the details text."""
    actions = {"motor": K.POINTS_SEARCH_ACTIONS[:1], "health": K.POINTS_SEARCH_ACTIONS[1:]}.get(kind, K.POINTS_SEARCH_ACTIONS)
    rows = log.where(F.col("action").isin(*actions) & (F.col("ts") >= now - F.make_dt_interval(F.lit(K.LOG_RETENTION_DAYS))))
    for text in contains.values():
        rows = rows.where(C.contains_text("details", text)) if text else rows
    return rows


def audit_report(log: DataFrame, now: Column, user_id: int | None = None, action: str = "") -> DataFrame:
    rows = log.where(F.col("action").isin(*K.SECURITY_ACTIONS) & (F.col("ts") >= now - F.make_dt_interval(F.lit(K.LOG_RETENTION_DAYS))))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if action:
        rows = rows.where(F.col("action") == action)
    return rows.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.coalesce("username", F.lit("System")).alias("username"), "action", "details")


def with_names(params: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Numeric dimension parameters replaced by names; others, and unknown ids, stay. Each dim has ``id`` and ``name``."""
    out = params
    for field, dim in dims.items():
        raw = F.col("params")[field]
        names = dim.select(F.col("id").cast("string").alias(f"_{field}_id"), F.col("name").alias(f"_{field}_name"))
        out = out.withColumn(f"_{field}_id", F.when(raw.rlike("^[0-9]+$"), raw.cast("bigint").cast("string"))).join(names, f"_{field}_id", "left")
        out = out.withColumn(f"_{field}", F.coalesce(f"_{field}_name", raw)).drop(f"_{field}_id", f"_{field}_name")
    return out


def points_report(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The 24 columns of the points-search report."""
    parsed = with_names(rows.withColumn("params", search_params("details")), dims)
    health = F.col("action") == "HEALTH_POINTS_SEARCH"
    blank = F.lit("")

    def param(name: str) -> Column:
        return F.coalesce(F.col("params")[name], blank)

    def yes(name: str) -> Column:
        return F.when(F.col("params")[name] == "YES", F.lit("YES")).otherwise(F.lit("NO"))

    return parsed.select(
        "id", F.coalesce("username", F.lit("System")).alias("username"), F.when(health, F.lit("Health")).otherwise(F.lit("Motor")).alias("search_type"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("search_time"), param("target_date").alias("target_date"),
        param("vehicle_no").alias("vehicle_no"), param("policy_holder_name").alias("policy_holder_name"),
        F.coalesce(F.when(health, F.col("params")["product_name"]).otherwise(F.col("_product")), blank).alias("product"),
        F.coalesce(F.when(health, F.col("params")["business_type"]).otherwise(F.col("_sub_product")), blank).alias("sub_product"),
        param("make_names").alias("make"), F.coalesce("_make_model_class", blank).alias("vehicle_class"), param("rto_code").alias("rto_code"),
        param("mfg_year").alias("mfg_year"), F.coalesce("_fuel", blank).alias("fuel"), param("cc").alias("cc"), param("sc").alias("sc"),
        param("policy_category").alias("plan_type"), param("sum_insured").alias("sum_assured"), param("age").alias("age"),
        param("pincode").alias("pincode"), param("policy_term").alias("policy_term"), yes("is_zd").alias("zd"), yes("is_cpa").alias("cpa"),
        yes("is_ncb").alias("ncb"),
    )
