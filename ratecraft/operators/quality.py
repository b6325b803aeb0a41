"""Rate-card validity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft import constants as K
from ratecraft.functions import documents as J, text as T


def type_violation(rate_type: str) -> Column:
    """Rows of a pay-in type with a rate outside the columns the type allows. NULL and 0 count as unset."""
    others = [f for f in K.PI_RATE_FIELDS if f not in K.PI_TYPE_FIELDS[rate_type]]
    stray = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(0.0)) != 0 for f in others])
    return (F.col("pi_type") == rate_type) & stray


def not_below(low: str, high: str) -> Column:
    return F.col(low) >= F.col(high)


def same_bound(low: str, high: str) -> Column:
    return F.col(low) == F.col(high)


def tariff_violation() -> Column:
    stp = T.norm_text("sub_product") == "stp"
    return F.coalesce(not_below("tariff_min", "tariff_max"), F.lit(False)) | F.coalesce(
        stp & (F.col("tariff_max") != K.STP_TARIFF_MAX), F.lit(False)
    )


def margin(leg: str) -> Column:
    return F.round(F.greatest(F.col(f"pi_{leg}_rate") - F.col(f"po_{leg}_rate"), F.lit(0.0)), 2)


def margin_violation(leg: str) -> Column:
    """Pay-in must exceed pay-out by the margin; a pay-in no larger than the margin asks for a pay-out of 0."""
    pi, po = F.col(f"pi_{leg}_rate"), F.col(f"po_{leg}_rate")
    exempt = (pi <= K.PI_PO_MARGIN) & (po == 0)
    return pi.isNotNull() & po.isNotNull() & ~exempt & (margin(leg) != K.PI_PO_MARGIN)


def rule_set() -> dict[str, tuple[str, Column]]:
    """label -> (family, violation). Bounds that are not both set never violate."""
    rules = {t: ("pay-in type", type_violation(t)) for t in K.PI_TYPE_FIELDS}
    rules["Invalid Vehicle Age Range"] = ("range", not_below("vehicle_age_min", "vehicle_age_max"))
    rules["Invalid CC Range"] = ("range", not_below("cc_min", "cc_max"))
    rules["Invalid Seating Capacity Range"] = ("range", not_below("sc_min", "sc_max"))
    rules["Invalid Tariff Range"] = ("range", tariff_violation())
    rules["Vehicle Age Equality"] = ("equality", same_bound("vehicle_age_min", "vehicle_age_max"))
    rules["CC Equality"] = ("equality", same_bound("cc_min", "cc_max"))
    rules["SC Equality"] = ("equality", same_bound("sc_min", "sc_max"))
    rules["Tariff Equality"] = ("equality", same_bound("tariff_min", "tariff_max"))
    rules["Validity Date Equality"] = ("equality", same_bound("from_date", "to_date"))
    rules["Invalid OD Rate"] = ("pi/po", margin_violation("od"))
    rules["Invalid TP Rate"] = ("pi/po", margin_violation("tp"))
    rules["Invalid NET Rate"] = ("pi/po", margin_violation("net"))
    rules["Pi/Po Type Mismatch"] = ("pi/po", F.col("pi_type") != F.col("po_type"))
    return rules


def rule_counts(rates: DataFrame) -> DataFrame:
    """(family, rule, violations): every rule counted in one scan."""
    rules = rule_set()
    live = rates.where("is_deleted = 'NO'")
    names = [f"r{i}" for i in range(len(rules))]
    counted = live.agg(*[F.count_if(v).alias(n) for n, (_, v) in zip(names, rules.values())])
    rows = F.array(*[
        F.struct(F.lit(family).alias("family"), F.lit(label).alias("rule"), F.col(n).alias("violations"))
        for n, (label, (family, _)) in zip(names, rules.items())
    ])
    return counted.select(F.inline(rows))


def violating_rows(rates: DataFrame, label: str) -> DataFrame:
    return rates.where("is_deleted = 'NO'").where(rule_set()[label][1])


def violations(rates: DataFrame) -> DataFrame:
    """(id, rule): every violated rule of every row, from one scan."""
    found = F.array_compact(F.array(*[F.when(v, F.lit(label)) for label, (_, v) in rule_set().items()]))
    return rates.where("is_deleted = 'NO'").select("id", F.explode(found).alias("rule"))


def type_violation_groups(rates: DataFrame, rate_type: str) -> tuple[DataFrame, DataFrame]:
    """Violating groups with their row counts, and the number of violating rows without a group."""
    bad = rates.where("is_deleted = 'NO'").where(type_violation(rate_type))
    grouped = bad.where("group_id IS NOT NULL").groupBy("group_id", "insurance_company").agg(F.count("*").alias("rows"))
    return grouped, bad.where("group_id IS NULL").agg(F.count("*").alias("ungrouped"))


def review_flags(register: DataFrame, answer: str, mandatory: list[str], name: str = "document_name") -> DataFrame:
    """Adds the mandatory fields an extracted document lacks, and whether its file name occurs more than once."""
    fields = J.json_fields(answer)
    missing = F.array_compact(F.array(*[
        F.when(T.is_missing(F.col("_fields")[F.replace(F.lower(F.lit(m)), F.lit(" "), F.lit("_"))]), F.lit(m))
        for m in mandatory
    ]))
    seen = register.groupBy(name).agg(F.count("*").alias("_copies"))
    return (
        register.withColumn("_fields", fields)
        .withColumn("missing_fields", missing)
        .join(seen, name, "left")
        .withColumn("duplicate_name", F.coalesce(F.col("_copies") > 1, F.lit(False)))
        .drop("_fields", "_copies")
    )


def extraction_audit(rows: DataFrame, raw_counts: DataFrame) -> DataFrame:
    """Per sheet: raw and processed rows, remarks, rows with more renewal columns than slots, and a status."""
    per_sheet = rows.groupBy("sheet").agg(
        F.count("*").alias("processed_rows"),
        F.count_if(F.col("remarks").isNotNull()).alias("remarks_rows"),
        F.count_if(F.regexp_count("raw_renewals", F.lit(";")) >= 5).alias("overflow_rows"),
    )
    zero = F.lit(0).cast("bigint")
    return raw_counts.join(per_sheet, "sheet", "left").select(
        "sheet", "raw_rows", *[F.coalesce(c, zero).alias(c) for c in ("processed_rows", "remarks_rows", "overflow_rows")],
        F.when(F.coalesce("processed_rows", zero) == 0, F.lit("ZERO ROWS EXTRACTED")).otherwise(F.lit("OK")).alias("status"),
    )


def enough_rows(audit: DataFrame) -> DataFrame:
    return audit.agg(F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("rows")).withColumn(
        "accepted", F.col("rows") >= K.LIFE_MINIMUM_ROWS
    )
