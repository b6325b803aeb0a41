"""Rate cards: active scans with dimensions flattened, and the normal form the rule chains join with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft.functions import clusters as C, text as T

DIMENSIONS = ["product", "sub_product", "policy_type", "fuel_type", "make_model_class"]
CODES = ["is_ncb", "is_cpa", "is_zd"]
BOUNDS = [
    "cc_min", "cc_max", "sc_min", "sc_max", "vehicle_age_min", "vehicle_age_max", "tariff_min", "tariff_max",
]
RATES = [
    "po_od_rate", "po_tp_rate", "po_net_rate", "po_flat_amount", "pi_od_rate", "pi_tp_rate", "pi_net_rate",
    "pi_flat_amount",
]
MAPPING_COLUMNS = [
    "id", "group_id", "insurance_company", "product", "sub_product", "fuel_type", "make_model_class", *CODES,
    "new_vehicle_makes", "new_rto_list", *BOUNDS, "from_date", "to_date", "po_type", "pi_type", *RATES, "add_tnc",
]
HEALTH_COLUMNS = [
    "id", "insurance_company", "product_name", "policy_category", "plan_names", "business_type", "min_deductible",
    "max_deductible", "min_sum_insured", "max_sum_insured", "min_age", "max_age", "pincode_zone", "payin_rate",
    "one_year_rate", "multi_year_2_rate", "multi_year_3_rate", "multi_year_4_rate", "multi_year_5_rate", "from_date",
    "to_date",
]


def group_key() -> Column:
    """Group id, or the row's own id where it has none."""
    return F.coalesce(F.col("group_id"), F.col("id"))


def flatten_dimensions(rates: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """``<dim>_id`` foreign keys replaced by names; each dimension has ``id`` and ``name``."""
    for field, dim in dims.items():
        names = dim.select(F.col("id").alias(f"{field}_id"), F.col("name").alias(field))
        rates = rates.join(names, f"{field}_id", "left").drop(f"{field}_id")
    return rates


def active_rates(rates: DataFrame) -> DataFrame:
    return rates.where("status = 'ACTIVE' AND is_deleted = 'NO'").select(*MAPPING_COLUMNS)


def active_health_rates(rates: DataFrame) -> DataFrame:
    live = rates.where("status = 'ACTIVE' AND coalesce(is_deleted, 'NO') <> 'YES'")
    return live.select(*HEALTH_COLUMNS)


def listed_rates(rates: DataFrame) -> DataFrame:
    """Every row that is not soft-deleted."""
    return rates.where("is_deleted = 'NO'")


def motor_rate_rows(rates: DataFrame) -> DataFrame:
    """Active rates in the form the motor chain joins with: ``r_`` names, lower-case text, lists as arrays."""
    text = [T.norm_text(c).alias(f"r_{c}") for c in ("product", "sub_product", "fuel_type", "make_model_class")]
    return active_rates(rates).select(
        F.col("id").cast("bigint").alias("r_id"),
        F.col("group_id").cast("bigint").alias("r_group_id"),
        T.norm_text("insurance_company").alias("r_insurer"),
        *text,
        *[T.norm_code(c).alias(f"r_{c}") for c in CODES],
        C.cluster_items("new_vehicle_makes").alias("r_make_items"),
        C.cluster_items("new_rto_list").alias("r_rto_items"),
        *[F.col(c).alias(f"r_{c}") for c in (*BOUNDS, "from_date", "to_date", "po_type", "pi_type", *RATES, "add_tnc")],
    )


def health_rate_rows(rates: DataFrame) -> DataFrame:
    """Active health rates in the form the health chain joins with."""
    text = [T.norm_text(c).alias(f"r_{c}") for c in ("product_name", "policy_category", "pincode_zone")]
    numbers = [
        "min_deductible", "max_deductible", "min_sum_insured", "max_sum_insured", "min_age", "max_age", "payin_rate",
        "one_year_rate", "multi_year_2_rate", "multi_year_3_rate", "multi_year_4_rate", "multi_year_5_rate",
    ]
    return active_health_rates(rates).select(
        F.col("id").cast("bigint").alias("r_id"),
        T.norm_text("insurance_company").alias("r_insurer"),
        *text,
        T.fold_business_type(F.coalesce("business_type", F.lit(""))).alias("r_business_type"),
        F.coalesce("plan_names", F.lit("")).alias("r_plan_names"),
        *[F.col(c).cast("double").alias(f"r_{c}") for c in numbers],
        *[F.col(c).alias(f"r_{c}") for c in ("from_date", "to_date")],
    )
