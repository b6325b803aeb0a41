"""Extracted policy documents as a typed register."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratecraft.functions import dates as D, numbers as N
from ratecraft.functions.documents import json_fields

TEXT = [
    "policy_number", "insured_name", "vehicle_registration_number", "vehicle_make", "vehicle_model", "vehicle_make_model",
    "engine_number", "chassis_number", "fuel_type", "cubic_capacity_cc", "rto_location",
]
AMOUNTS = ["gross_premium", "net_premium", "tax_amount"]
DATES = ["policy_start_date", "policy_end_date", "issue_date"]


def policy_register(documents: DataFrame, answer: str = "answer", key: str = "id") -> DataFrame:
    """One register row per document: text as extracted, amounts as decimals, dates in any of the known formats."""
    fields = documents.select(key, json_fields(answer).alias("_f"))

    def f(name: str):
        return F.col("_f")[name]

    insurer = F.coalesce(F.when(f("insurance_company") != "", f("insurance_company")), f("insurer_name"))
    return fields.select(
        key, insurer.alias("insurer_name"), *[f(c).alias(c) for c in TEXT], *[N.safe_decimal(f(c)).alias(c) for c in AMOUNTS],
        *[D.document_date(f(c)).alias(c) for c in DATES],
    )
