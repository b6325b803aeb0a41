"""Eligibility searches and ranked listings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, predicates as P, text as T
from ratecraft.functions.rates import effective_rate, first_positive, search_rate_text
from ratecraft.operators.resolve import resolve_codes, resolve_search_terms
from ratecraft.sources.rates import group_key

MOTOR_ORDER = ["pi_net_rate", "pi_od_rate", "pi_flat_amount"]
LOCK_ORDER = ["po_net_rate", "po_od_rate", "po_flat_amount"]


@dataclass(frozen=True)
class MotorSearch:
    """Parameters of a motor eligibility search; blank ones filter nothing."""

    target_date: str | None = None
    product: str | None = None
    sub_product: str | None = None
    make_model_class: str | None = None
    fuel: str | None = None
    make_name: str | None = None
    rto_code: str | None = None
    cc: str | None = None
    sc: str | None = None
    made_year: str | None = None
    codes: dict[str, str] = field(default_factory=dict)


def listed_by(rates: DataFrame, column: str, term: str | None, names: DataFrame | None, fallback: str) -> DataFrame:
    """Rates whose list column holds a name the term resolves to.

    A term that resolves to nothing falls back to ``contains`` (substring of the list text) or ``none``. ``names`` has
    one column ``name`` and at most one row per master; they are a scalar of the one filter, so the rates are read once.
    """
    if not term or names is None:
        return rates
    wanted = names.agg(F.collect_set(F.lower("name")).alias("names")).scalar()
    exact = F.arrays_overlap(C.cluster_items(column), wanted)
    loose = F.lit(False) if fallback == "none" else C.contains_text(column, term.strip())
    return rates.where(F.when(F.size(wanted) > 0, exact).otherwise(loose))


def eligible(rates: DataFrame, search: MotorSearch, rto_master: DataFrame, make_master: DataFrame,
             spellings: DataFrame) -> DataFrame:
    """Live rates the search covers, lists resolved through the masters."""
    spark = rates.sparkSession
    tests = [
        F.col("is_deleted") != "YES",
        F.col("status").isin("ACTIVE", "INACTIVE"),
        P.same_text("product", search.product),
        P.same_text("sub_product", search.sub_product),
        P.same_text("fuel_type", search.fuel),
        P.class_or_na("make_model_class", search.make_model_class),
        P.covers("cc_min", "cc_max", search.cc),
        P.covers("sc_min", "sc_max", search.sc),
        *[P.code_or_na(c, v) for c, v in search.codes.items()],
    ]
    if search.target_date:
        day = F.to_date(F.lit(search.target_date))
        tests += [D.valid_on(day), P.made_in(search.made_year, day)]
    found = rates.where(reduce(lambda a, b: a & b, tests))

    def term(value: str | None) -> DataFrame:
        return spark.createDataFrame([(value or "",)], "term string")

    rtos = resolve_codes(term(search.rto_code), rto_master).select("name")
    makes = resolve_search_terms(term(search.make_name), spellings, make_master).select("name")
    found = listed_by(found, "new_rto_list", search.rto_code, rtos, "contains")
    return listed_by(found, "new_vehicle_makes", search.make_name, makes, "contains")


def _ranking(columns: list[str]) -> list[Column]:
    return [*[F.desc_nulls_last(c) for c in columns], F.desc("id")]


def best_of_group(rates: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of every group in the given order; a huge group is cut to its first row before the shuffle."""
    ranked = Window.partitionBy("display_group_id").orderBy(*[F.desc_nulls_last(c) for c in columns], F.desc("id"))
    keyed = rates.select(group_key().alias("display_group_id"), "*")
    return keyed.withColumn("_place", F.row_number().over(ranked)).where("_place = 1").drop("_place")


def with_display(rates: DataFrame) -> DataFrame:
    shown = rates.withColumn("display_class", T.display_class("make_model_class", "product"))
    for side in ("pi", "po"):
        parts = [F.col(f"{side}_{f}") for f in ("type", "od_rate", "tp_rate", "net_rate")]
        shown = shown.withColumn(f"{side}_rate", search_rate_text(*parts))
    return shown


def motor_page(eligible_rates: DataFrame, skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page of groups, best first, and a one-row frame saying whether another group follows."""
    ordered = best_of_group(eligible_rates, MOTOR_ORDER).orderBy(*_ranking(MOTOR_ORDER))
    page = with_display(ordered.offset(skip).limit(limit))
    more = ordered.offset(skip).limit(limit + 1).agg((F.count("*") > limit).alias("has_more"))
    return page, more


def lowest_per_offer(rates: DataFrame) -> DataFrame:
    """Near-duplicates (same insurer, tariff range, type, flat amount and T&C) reduced to the lowest effective rate.

    Of equal rates the one earlier in the search order stays.
    """
    key = ["insurance_company", "tariff_min", "tariff_max", "po_type", "po_flat_amount", "add_tnc"]
    rate = F.when(F.col("po_type") == K.ON_OD_TP,
                  effective_rate(*[F.col(f"po_{f}") for f in ("type", "od_rate", "tp_rate", "net_rate")])).otherwise(
        first_positive(F.col("po_net_rate"), F.col("po_od_rate"), F.col("po_tp_rate")))
    ranked = rates.withColumn("effective_rate", rate)
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_first("effective_rate"), *_ranking(LOCK_ORDER))
    return ranked.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def lock_status(results: DataFrame, locks: DataFrame, vehicle_no: str, holder: str) -> DataFrame:
    """Adds the status of the latest lock of this vehicle and holder on each rate, UNLOCKED where there is none."""
    mine = locks.where(
        (F.lower("vehicle_no") == vehicle_no.lower()) & (F.lower("policy_holder_name") == holder.lower())
    )
    latest = mine.groupBy(F.col("rate_id").alias("id")).agg(F.max_by("status", "id").alias("_status"))
    return results.join(latest, "id", "left").withColumn(
        "lock_status", F.coalesce("_status", F.lit("UNLOCKED"))
    ).drop("_status")


def lock_search(eligible_rates: DataFrame, locks: DataFrame, vehicle_no: str, holder: str, limit: int | None = None) -> DataFrame:
    """Lock-checker result: first row per group, near-duplicates collapsed, best first; ``limit`` asks for the top only."""
    offers = lowest_per_offer(best_of_group(eligible_rates, LOCK_ORDER))
    shown = offers.orderBy(F.desc("effective_rate"), *_ranking(LOCK_ORDER))
    shown = shown if limit is None else shown.limit(limit)
    return with_display(lock_status(shown, locks, vehicle_no, holder))


@dataclass(frozen=True)
class HealthSearch:
    target_date: str | None = None
    term: int = 1
    product_name: str | None = None
    business_type: str | None = None
    policy_category: str | None = None
    insurers: tuple[str, ...] = ()
    sum_insured: str | None = None
    age: str | None = None
    pincode: str | None = None


def health_eligible(rates: DataFrame, search: HealthSearch, pincode_master: DataFrame, strict: bool = False) -> DataFrame:
    """Active health rates the search covers. An unknown pincode falls back to the zone's name, or finds nothing."""
    tests = [
        F.coalesce("is_deleted", F.lit("NO")) != "YES", F.col("status") == "ACTIVE",
        P.sum_insured(search.sum_insured), P.covers("min_age", "max_age", search.age),
    ]
    for column in ("product_name", "business_type", "policy_category"):
        value = getattr(search, column)
        if value:
            tests.append(F.col(column) == value)
    if search.insurers:
        tests.append(F.col("insurance_company").isin(*search.insurers))
    if search.target_date:
        tests.append(D.valid_on(F.to_date(F.lit(search.target_date))))
    found = rates.where(reduce(lambda a, b: a & b, tests))
    if not search.pincode:
        return found
    term = rates.sparkSession.createDataFrame([(search.pincode,)], "term string")
    zones = resolve_codes(term, pincode_master).select("name")
    return listed_by(found, "pincode_zone", search.pincode, zones, "none" if strict else "contains")


def health_search(eligible_rates: DataFrame, term: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows by tenure rate, best first, at most ``limit`` of them if given, and (total, has_more)."""
    rate = K.TENURE_RATES[term - 1]
    shown = (
        eligible_rates.withColumn("applicable_rate", F.coalesce(rate, "payin_rate"))
        .orderBy(F.desc_nulls_last(rate), F.desc_nulls_last("payin_rate"), F.desc("id"))
    )
    shown = shown if limit is None else shown.limit(limit)
    total = eligible_rates.agg(F.count("*").alias("total_found")).withColumn(
        "has_more", F.lit(False) if limit is None else F.col("total_found") > limit
    )
    return shown, total


def group_page(rates: DataFrame, page: int, size: int) -> DataFrame:
    """A dashboard page: groups by their newest matching row, each shown over *all* of its rows.

    ``rates`` carries a boolean ``matches``: only matching rows decide which groups are on the page.
    """
    keyed = rates.withColumn("display_group_id", group_key())
    newest = keyed.where("matches").groupBy("display_group_id").agg(F.max("id").alias("_newest"))
    keys = newest.orderBy(F.desc("_newest")).offset((page - 1) * size).limit(size)
    return group_display(keyed.join(keys, "display_group_id")).orderBy(F.desc("_newest"))


def first_spellings(rows: DataFrame, group: list[str], items: Column, out: str) -> DataFrame:
    """Per group: distinct items ignoring case, first spelling first, joined.

    Reduced to one row per (group, item) before the items of a group meet, so a group of any size costs only its
    distinct items.
    """
    spread = rows.select(*group, "id", F.posexplode(items).alias("_pos", "_item"))
    order = F.struct("id", "_pos")
    once = spread.where("_item IS NOT NULL AND trim(_item) <> ''").groupBy(*group, F.lower("_item").alias("_key")).agg(
        F.min(order).alias("_at"), F.min_by("_item", order).alias("_item")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_item")))
    return once.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["_item"]), ", ").alias(out))


def group_display(keyed: DataFrame) -> DataFrame:
    """Per group: the RTOs and fuels of all its rows, each once, in row order."""
    group = ["display_group_id", "_newest"]
    rtos = first_spellings(keyed, group, C.split_list("new_rto_list"), "display_rto_list")
    fuels = first_spellings(keyed, group, F.array(T.strip("fuel_type")), "display_fuel_types")
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("rows"))
    blank = F.lit("")
    return (
        sizes.join(rtos, group, "left").join(fuels, group, "left")
        .withColumn("display_rto_list", F.coalesce("display_rto_list", blank))
        .withColumn("display_fuel_types", F.coalesce("display_fuel_types", blank))
    )
