"""Filters, searches, quality rules, duplicates and roll-ups over rate cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bridge import master
from catalog.mapping_queries import make_master, pin_master, rto_master
from catalog.registry import Source, query
from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, predicates as P, text as T
from ratecraft.functions.numbers import in_range
from ratecraft.operators import analytics as A, maintain as M, quality as Q, rulejoin as J, search as S
from ratecraft.session import stage
from ratecraft.sources import rates as R, reports


def day(text: str):
    return F.to_date(F.lit(text))


# ---- filters: each over the whole card, one boolean per row ---------------------------------------
def tested(name: str, view: str, build, sql: str) -> None:
    @query(name, f"SELECT id, {sql} FROM {view}")
    def run(s: Source) -> DataFrame:
        return getattr(s, view).select("id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in build().items()])


def _flag(sql: str, name: str) -> str:
    return f"coalesce({sql}, false) AS {name}"


tested("valid_on_date", "rate_card", lambda: {"valid": D.valid_on(day("1997-06-30"))},
       _flag("coalesce(from_date <= DATE '1997-06-30', true) AND coalesce(to_date >= DATE '1997-06-30', true)", "valid"))
tested("date_window_overlap", "rate_card", lambda: {"meets": D.windows_overlap(day("1998-12-31"), day("1999-02-01"))},
       _flag("coalesce(from_date <= DATE '1999-02-01', true) AND coalesce(to_date >= DATE '1998-12-31', true)", "meets"))
tested("point_in_closed_range", "rate_card", lambda: {"cc": P.covers("cc_min", "cc_max", "25"), "sc": P.covers("sc_min", "sc_max", "5.0"), "junk": P.covers("cc_min", "cc_max", "abc")},
       _flag("coalesce(cc_min <= 25, true) AND coalesce(cc_max >= 25, true)", "cc") + ", " + _flag("coalesce(sc_min <= 5, true) AND coalesce(sc_max >= 5, true)", "sc") + ", true AS junk")
tested("point_in_half_open_range", "rate_card", lambda: {"inside": in_range(F.lit(2.0), F.col("vehicle_age_min"), F.col("vehicle_age_max"), low_open=True),
       "missing": in_range(F.lit(None).cast("double"), F.col("vehicle_age_min"), F.col("vehicle_age_max"))},
       _flag("coalesce(vehicle_age_min < 2, true) AND coalesce(vehicle_age_max >= 2, true)", "inside") + ", " + _flag("vehicle_age_min IS NULL AND vehicle_age_max IS NULL", "missing"))
tested("range_text_filter", "rate_card", lambda: {"exact": P.range_text("cc_min", "cc_max", "20 - 45"), "low": P.range_text("cc_min", "cc_max", "20-"), "bare": P.range_text("cc_min", "cc_max", "30"), "junk": P.range_text("cc_min", "cc_max", "x/y")},
       _flag("cc_min = 20 AND cc_max = 45", "exact") + ", " + _flag("cc_min = 20", "low") + ", " + _flag("cc_min <= 30 AND cc_max >= 30", "bare") + ", true AS junk")
tested("above_25_lakh", "health_card", lambda: {"above": P.sum_insured("above_25L"), "point": P.sum_insured("700000")},
       _flag("max_sum_insured > 2500000 OR max_sum_insured IS NULL", "above") + ", " + _flag("coalesce(min_sum_insured <= 700000, true) AND coalesce(max_sum_insured >= 700000, true)", "point"))
tested("exact_or_wildcard", "rate_card", lambda: {"small": J.exact_or_wildcard(T.norm_text("product"), F.lit("small")).holds(), "blank": J.exact_or_wildcard(T.norm_text("product"), F.lit("")).holds()},
       _flag("product = '' OR lower(product) = 'small'", "small") + ", " + _flag("product = ''", "blank"))
tested("class_with_na_wildcard", "rate_card", lambda: {"f": J.class_or_wildcard(T.norm_text("make_model_class"), F.lit("f")).holds(), "blank": J.class_or_wildcard(T.norm_text("make_model_class"), F.lit("")).holds()},
       _flag("make_model_class IN ('NA', 'F')", "f") + ", " + _flag("make_model_class = 'NA'", "blank"))
tested("tri_state_code_match", "rate_card", lambda: {
    "ncb20": J.coded(T.norm_code("is_ncb"), F.lit(20).between(1, 99), F.lit(20) == 0).holds(), "ncb0": J.coded(T.norm_code("is_ncb"), F.lit(0).between(1, 99), F.lit(0) == 0).holds(),
    "cpa750": J.coded(T.norm_code("is_cpa"), F.lit(750).between(1, 1000), F.lit(750) == 0).holds(), "zd": J.coded(T.norm_code("is_zd"), T.nil_dep_class(F.lit("y")) == "YES", T.nil_dep_class(F.lit("y")) == "NO").holds()},
    _flag("is_ncb IN ('NA', 'YES')", "ncb20") + ", " + _flag("is_ncb IN ('NA', 'NO')", "ncb0") + ", " + _flag("coalesce(is_cpa, 'NA') IN ('NA', 'YES')", "cpa750") + ", " + _flag("is_zd IN ('NA', 'YES')", "zd"))
tested("code_or_na_filter", "rate_card", lambda: {"ncb": P.code_or_na("is_ncb", "yes"), "cpa": P.code_or_na("is_cpa", "NO"), "any": P.code_or_na("is_zd", "")},
       _flag("is_ncb IN ('YES', 'NA')", "ncb") + ", " + _flag("coalesce(is_cpa, 'NA') IN ('NO', 'NA')", "cpa") + ", true AS \"any\"")
tested("class_filter_na_fallback", "cells", lambda: {"bike": P.class_or_na("vehicle_class", " Bike "), "other": P.class_or_na("vehicle_class", "Boat")},
       _flag("vehicle_class IN ('Bike', 'NA')", "bike") + ", false AS other")
tested("id_or_name_filter", "rate_card", lambda: {"by_id": P.id_or_name("id", "product", "42"), "by_name": P.id_or_name("id", "product", "mediUM")},
       _flag("id = 42", "by_id") + ", " + _flag("product = 'MEDIUM'", "by_name"))
tested("substring_filter", "rate_card", lambda: {"ring": C.contains_text("new_vehicle_makes", "RING"), "zone": C.contains_text("new_rto_list", "_3")},
       _flag("new_vehicle_makes LIKE '%ring%'", "ring") + ", " + _flag("new_rto_list LIKE '%\\_3' ESCAPE '\\'", "zone"))
tested("list_item_membership", "rate_card", lambda: {"has": C.has_item("new_vehicle_makes", F.array(F.lit("mk_ring"), F.lit("mk_all")))},
       _flag("list_has_any(string_split(new_vehicle_makes, ', '), ['mk_ring', 'mk_all'])", "has"))
tested("group_id_list_filter", "rate_card", lambda: {"hit": P.in_groups(P.id_list("1000003, 40, 77, 1000010, x"))},
       _flag("group_id IN (1000003, 40, 77, 1000010) OR (group_id IS NULL AND id IN (1000003, 40, 77, 1000010))", "hit"))
tested("health_free_text", "health_card", lambda: {"text": P.health_text("optima"), "ids": P.health_text("h-12, 15"), "mixed": P.health_text("h-12, gold")},
       _flag("lower(insurance_company) LIKE '%optima%' OR lower(plan_names) LIKE '%optima%'", "text") + ", " + _flag("id IN (12, 15)", "ids") + ", false AS mixed")


def life_rows(s: Source) -> DataFrame:
    cols = {"row_id": "Row_ID", "insurer": "InsurerDisplay", "category": "Category", "product_name": "Product_Name", "variant": "Variant", "ppt": "PPT", "pt": "PT",
            "base_rate": "Base_Payout_Yr1", "base_text": "base_text", "remarks": "Row_Specific_Remarks", "notes": "Sheet_Level_Notes_And_Conditions", "raw_renewals": "All_Renewal_Years_Raw"}
    renewals = {f"renewal_{i + 2}": slot for i, slot in enumerate(K.RENEWAL_SLOTS)}
    return s.life.select(*[F.col(a).alias(b) for a, b in {**cols, **renewals}.items()])


@query("life_free_text_search", """SELECT row_id FROM life WHERE lower(insurer) LIKE '%brand#1%' OR lower(product_name) LIKE '%brand#1%' OR lower(coalesce(variant, '')) LIKE '%brand#1%'
  OR lower(coalesce(remarks, '')) LIKE '%brand#1%' OR lower(coalesce(notes, '')) LIKE '%brand#1%'""")
def life_free_text_search(s: Source) -> DataFrame:
    from ratecraft.functions.life import matches_search

    return life_rows(s).where(matches_search(" Brand#1 ")).select(F.col("Row_ID").alias("row_id"))


@query("month_status_filter", "SELECT id FROM grids WHERE year(work_effected_date) = 1997 AND month(work_effected_date) = 3 AND status = 'PENDING'")
def month_status_filter(s: Source) -> DataFrame:
    return s.grids.where(P.in_month("work_effected_date", "1997-03") & (F.col("status") == "PENDING")).select("id")


@query("recency_window", "SELECT id FROM audit WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def recency_window(s: Source) -> DataFrame:
    return s.audit.where(P.within_last("ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), days=7)).select("id")


# ---- scans and exports ----------------------------------------------------------------------------
@query("active_rate_scan", f"SELECT {', '.join(R.MAPPING_COLUMNS)} FROM rate_card WHERE status = 'ACTIVE' AND is_deleted = 'NO'")
def active_rate_scan(s: Source) -> DataFrame:
    return R.active_rates(s.rate_card)


@query("health_rate_scan", f"SELECT {', '.join(R.HEALTH_COLUMNS)} FROM health_card WHERE status = 'ACTIVE' AND coalesce(is_deleted, 'NO') <> 'YES'")
def health_rate_scan(s: Source) -> DataFrame:
    return R.active_health_rates(s.health_card)


@query("rate_export", f"SELECT {', '.join(reports.EXPORT_COLUMNS)} FROM rate_card WHERE coalesce(from_date <= DATE '1998-06-30', true) AND coalesce(to_date >= DATE '1998-01-01', true)")
def rate_export(s: Source) -> DataFrame:
    return reports.filtered_export(s.rate_card, "1998-01-01", "1998-06-30")


@query("rate_list", "SELECT id, group_id, status FROM rate_card WHERE is_deleted = 'NO'")
def rate_list(s: Source) -> DataFrame:
    return R.listed_rates(s.rate_card).select("id", "group_id", "status")


@query("master_export", "SELECT name, string_agg(item, ',' ORDER BY item) AS cluster, CAST(count(*) AS INTEGER) AS items FROM make_items GROUP BY 1")
def master_export(s: Source) -> DataFrame:
    return reports.master_export(make_master(s))


@query("health_export", "SELECT 'h-' || CAST(id AS STRING) AS row_key, insurance_company, product_name, policy_category, plan_names, business_type, pincode_zone, payin_rate, one_year_rate, from_date, to_date, status FROM health_card")
def health_export(s: Source) -> DataFrame:
    return reports.health_export(s.health_card)


@query("dimension_star_join", """
WITH names AS (SELECT DISTINCT product AS name FROM rate_card WHERE product <> ''), dim AS (SELECT row_number() OVER (ORDER BY name) AS no, name FROM names)
SELECT r.id, d.name AS product FROM rate_card r LEFT JOIN dim d ON d.name = r.product""")
def dimension_star_join(s: Source) -> DataFrame:
    names = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
    dim = s.rate_card.where("product <> ''").select(F.col("product").alias("name")).distinct().withColumn(
        "id", F.array_position(T.literal_array(names), F.col("name")))
    facts = s.rate_card.select("id", F.when(F.col("product") != "", F.array_position(T.literal_array(names), F.col("product"))).alias("product_id"))
    return R.flatten_dimensions(facts, {"product": dim})


# ---- searches -------------------------------------------------------------------------------------
_RANK = "pi_net_rate DESC NULLS LAST, pi_od_rate DESC NULLS LAST, pi_flat_amount DESC NULLS LAST, id DESC"
_LOCK_RANK = "po_net_rate DESC NULLS LAST, po_od_rate DESC NULLS LAST, po_flat_amount DESC NULLS LAST, id DESC"
_ELIGIBLE = """WITH meant AS (SELECT DISTINCT name FROM spelling asked JOIN spelling same USING (mapping_id) JOIN make_items ON upper(item) = same.value OR upper(item) LIKE same.value || ' %' WHERE asked.value = 'RED RING'),
ok AS (SELECT *, coalesce(group_id, id) AS k FROM rate_card WHERE is_deleted <> 'YES' AND lower(product) = 'small' AND coalesce(from_date <= DATE '1998-12-31', true)
  AND coalesce(to_date >= DATE '1998-12-31', true) AND coalesce(cc_min <= 22, true) AND coalesce(cc_max >= 22, true) AND is_ncb IN ('YES', 'NA') AND new_rto_list IN ('zone_2')
  AND list_has_any(string_split(new_vehicle_makes, ', '), (SELECT list(name) FROM meant)))"""
_SEARCH = S.MotorSearch(target_date="1998-12-31", product="small", cc="22", rto_code="NA07", make_name="red ring", codes={"is_ncb": "yes"})


def eligible(s: Source) -> DataFrame:
    return S.eligible(s.rate_card, _SEARCH, rto_master(s), make_master(s), s.spelling)


@query("eligible_motor_rates", _ELIGIBLE + "SELECT id, k AS group_key FROM ok")
def eligible_motor_rates(s: Source) -> DataFrame:
    return eligible(s).select("id", R.group_key().alias("group_key"))


_FIRST = f"first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {{r}}) AS p FROM ok) x WHERE p = 1)"
_ALL = "WITH ok AS (SELECT *, coalesce(group_id, id) AS k FROM rate_card WHERE is_deleted <> 'YES')"


@query("motor_search_page", f"{_ALL}, {_FIRST.replace('{r}', _RANK)} SELECT k AS display_group_id, id, pi_net_rate, make_model_class AS display_class FROM first ORDER BY {_RANK} LIMIT 50 OFFSET 50")
def motor_search_page(s: Source) -> DataFrame:
    page, _ = S.motor_page(s.rate_card.where("is_deleted <> 'YES'"), skip=50, limit=50)
    return page.select("display_group_id", "id", "pi_net_rate", "display_class")


@query("motor_search_has_more", f"{_ALL} SELECT count(DISTINCT k) > 100 AS has_more FROM ok")
def motor_search_has_more(s: Source) -> DataFrame:
    return S.motor_page(s.rate_card.where("is_deleted <> 'YES'"), skip=50, limit=50)[1]


@query("first_row_per_group", f"{_ALL}, {_FIRST.replace('{r}', _RANK)} SELECT k AS display_group_id, id FROM first")
def first_row_per_group(s: Source) -> DataFrame:
    return S.best_of_group(s.rate_card.where("is_deleted <> 'YES'"), S.MOTOR_ORDER).select("display_group_id", "id")


_LOCK_EFF = """CASE WHEN po_type = 'On OD and TP' THEN coalesce(po_od_rate, 0) + coalesce(po_tp_rate, 0) WHEN po_net_rate > 0 THEN po_net_rate WHEN po_od_rate > 0 THEN po_od_rate
  WHEN po_tp_rate > 0 THEN po_tp_rate ELSE 0 END"""


@query("near_duplicate_collapse", f"""{_ALL} SELECT id, eff AS effective_rate FROM (SELECT *, row_number() OVER (PARTITION BY insurance_company, tariff_min, tariff_max, po_type, po_flat_amount, add_tnc
  ORDER BY eff, {_LOCK_RANK}) AS p FROM (SELECT *, {_LOCK_EFF} AS eff FROM ok) e) x WHERE p = 1""")
def near_duplicate_collapse(s: Source) -> DataFrame:
    return S.lowest_per_offer(s.rate_card.where("is_deleted <> 'YES'")).select("id", "effective_rate")


@query("lock_checker_search", f"""{_ALL}, {_FIRST.replace('{r}', _LOCK_RANK)},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insurance_company, tariff_min, tariff_max, po_type, po_flat_amount, add_tnc ORDER BY eff, {_LOCK_RANK}) AS q
  FROM (SELECT *, {_LOCK_EFF} AS eff FROM first) e) x WHERE q = 1), shown AS (SELECT * FROM one),
mine AS (SELECT rate_id, max_by(status, id) AS st FROM locks WHERE lower(vehicle_no) = 'mh03ab3' AND lower(policy_holder_name) = 'holder 3' GROUP BY 1)
SELECT id, eff AS effective_rate, coalesce(st, 'UNLOCKED') AS lock_status FROM shown LEFT JOIN mine ON rate_id = id""")
def lock_checker_search(s: Source) -> DataFrame:
    return S.lock_search(s.rate_card.where("is_deleted <> 'YES'"), s.locks, "MH03AB3", "Holder 3").select("id", "effective_rate", "lock_status")


@query("lock_status_lookup", """WITH mine AS (SELECT rate_id, max_by(status, id) AS st FROM locks WHERE lower(vehicle_no) = 'mh03ab3' AND lower(policy_holder_name) = 'holder 3' GROUP BY 1)
SELECT id, coalesce(st, 'UNLOCKED') AS lock_status FROM rate_card LEFT JOIN mine ON rate_id = id""")
def lock_status_lookup(s: Source) -> DataFrame:
    return S.lock_status(s.rate_card.select("id"), s.locks, "mh03ab3", "holder 3")


_HEALTH = """WITH ok AS (SELECT * FROM health_card WHERE status = 'ACTIVE' AND coalesce(is_deleted, 'NO') <> 'YES' AND coalesce(from_date <= DATE '1998-01-01', true) AND coalesce(to_date >= DATE '1998-01-01', true)
  AND coalesce(min_age <= 30, true) AND coalesce(max_age >= 30, true) AND pincode_zone IN ('pz_2'))"""
_HSEARCH = S.HealthSearch(target_date="1998-01-01", age="30", pincode="400007")


@query("health_payout_search", _HEALTH + "SELECT id, coalesce(one_year_rate, payin_rate) AS applicable_rate FROM ok ORDER BY one_year_rate DESC NULLS LAST, payin_rate DESC NULLS LAST, id DESC")
def health_payout_search(s: Source) -> DataFrame:
    return S.health_search(S.health_eligible(s.health_card, _HSEARCH, pin_master(s)))[0].select("id", "applicable_rate")


@query("health_search_total", _HEALTH + "SELECT count(*) AS total_found, count(*) > 200 AS has_more FROM ok")
def health_search_total(s: Source) -> DataFrame:
    return S.health_search(S.health_eligible(s.health_card, _HSEARCH, pin_master(s)), limit=200)[1]


@query("zone_search_fallback", "SELECT id FROM health_card WHERE status = 'ACTIVE' AND coalesce(is_deleted, 'NO') <> 'YES' AND pincode_zone LIKE '%z\\_4%' ESCAPE '\\'")
def zone_search_fallback(s: Source) -> DataFrame:
    return S.health_eligible(s.health_card, S.HealthSearch(pincode="Z_4"), pin_master(s)).select("id")


@query("cluster_search_fallback", "SELECT id FROM rate_card WHERE new_rto_list LIKE '%one\\_1%' ESCAPE '\\'")
def cluster_search_fallback(s: Source) -> DataFrame:
    from ratecraft.operators.resolve import resolve_codes

    names = resolve_codes(s.nation.select(F.lit("one_1").alias("term")), rto_master(s)).select("name")
    return S.listed_by(s.rate_card, "new_rto_list", "one_1", names, "contains").select("id")


@query("paged_group_listing", """
WITH k AS (SELECT coalesce(group_id, id) AS k, max(id) AS newest FROM rate_card WHERE product = 'LARGE' GROUP BY 1 ORDER BY newest DESC LIMIT 20 OFFSET 20),
r AS (SELECT k.k, newest, rc.* FROM k JOIN rate_card rc ON coalesce(rc.group_id, rc.id) = k.k)
SELECT k AS display_group_id, string_agg(new_rto_list, ', ' ORDER BY id) AS display_rto_list, min(fuel_type) AS display_fuel_types, count(*) AS "rows" FROM r GROUP BY 1""")
def paged_group_listing(s: Source) -> DataFrame:
    page = S.group_page(s.rate_card.withColumn("matches", F.col("product") == "LARGE"), 2, 20)
    return page.select("display_group_id", "display_rto_list", "display_fuel_types", "rows")


@query("group_display", """SELECT coalesce(group_id, id) AS display_group_id, string_agg(new_rto_list, ', ' ORDER BY id) AS display_rto_list, count(*) AS "rows" FROM rate_card GROUP BY 1""")
def group_display(s: Source) -> DataFrame:
    keyed = s.rate_card.withColumn("display_group_id", R.group_key()).withColumn("_newest", F.lit(0))
    return S.group_display(keyed).select("display_group_id", "display_rto_list", "rows")


# ---- quality --------------------------------------------------------------------------------------
def _stray(t: str) -> str:
    others = [f for f in K.PI_RATE_FIELDS if f not in K.PI_TYPE_FIELDS[t]]
    return f"pi_type = '{t}' AND (" + " OR ".join(f"coalesce({f}, 0) <> 0" for f in others) + ")"


def _margin(leg: str) -> str:
    pi, po = f"pi_{leg}_rate", f"po_{leg}_rate"
    return f"{pi} IS NOT NULL AND {po} IS NOT NULL AND NOT ({pi} <= 7 AND {po} = 0) AND round(greatest({pi} - {po}, 0), 2) <> 7"


_RULES = {**{t: _stray(t) for t in K.PI_TYPE_FIELDS}, "Invalid Vehicle Age Range": "vehicle_age_min >= vehicle_age_max", "Invalid CC Range": "cc_min >= cc_max",
          "Invalid Seating Capacity Range": "sc_min >= sc_max", "Invalid Tariff Range": "tariff_min >= tariff_max OR (lower(sub_product) = 'stp' AND tariff_max <> 100.01)",
          "Vehicle Age Equality": "vehicle_age_min = vehicle_age_max", "CC Equality": "cc_min = cc_max", "SC Equality": "sc_min = sc_max", "Tariff Equality": "tariff_min = tariff_max",
          "Validity Date Equality": "from_date = to_date", "Invalid OD Rate": _margin("od"), "Invalid TP Rate": _margin("tp"), "Invalid NET Rate": _margin("net"),
          "Pi/Po Type Mismatch": "pi_type <> po_type"}


def _violating(name: str, labels: list[str]) -> None:
    @query(name, " UNION ALL ".join(f"SELECT id, '{x}' AS rule FROM rate_card WHERE is_deleted = 'NO' AND ({_RULES[x]})" for x in labels))
    def run(s: Source) -> DataFrame:
        return Q.violations(s.rate_card).where(F.col("rule").isin(*labels))


_violating("payin_type_purity", list(K.PI_TYPE_FIELDS))
_violating("range_order_and_tariff_rule", ["Invalid Vehicle Age Range", "Invalid CC Range", "Invalid Seating Capacity Range", "Invalid Tariff Range"])
_violating("bound_equality", ["Vehicle Age Equality", "CC Equality", "SC Equality", "Tariff Equality", "Validity Date Equality"])
_violating("payin_payout_margin", ["Invalid OD Rate", "Invalid TP Rate", "Invalid NET Rate"])
_violating("payin_payout_type_mismatch", ["Pi/Po Type Mismatch"])


@query("rule_dashboard", " UNION ALL ".join(f"SELECT '{x}' AS rule, count(*) AS violations FROM rate_card WHERE is_deleted = 'NO' AND ({r})" for x, r in _RULES.items()))
def rule_dashboard(s: Source) -> DataFrame:
    return Q.rule_counts(s.rate_card).select("rule", "violations")


@query("tariff_violation_rows", f"SELECT id, sub_product, tariff_min, tariff_max FROM rate_card WHERE is_deleted = 'NO' AND ({_RULES['Invalid Tariff Range']})")
def tariff_violation_rows(s: Source) -> DataFrame:
    return Q.violating_rows(s.rate_card, "Invalid Tariff Range").select("id", "sub_product", "tariff_min", "tariff_max")


@query("payin_violations_by_group", f"SELECT group_id, insurance_company, count(*) AS \"rows\" FROM rate_card WHERE is_deleted = 'NO' AND group_id IS NOT NULL AND ({_RULES['On Net']}) GROUP BY 1, 2")
def payin_violations_by_group(s: Source) -> DataFrame:
    return Q.type_violation_groups(s.rate_card, "On Net")[0]


@query("payin_violations_ungrouped", f"SELECT count(*) AS ungrouped FROM rate_card WHERE is_deleted = 'NO' AND group_id IS NULL AND ({_RULES['On OD and TP']})")
def payin_violations_ungrouped(s: Source) -> DataFrame:
    return Q.type_violation_groups(s.rate_card, "On OD and TP")[1]


@query("post_match_review_flags", """
WITH f AS (SELECT id, document_name, regexp_matches(answer, '"vehicle_make": ""') AS no_make, NOT regexp_matches(answer, '"insurance_company"') AS no_company FROM extracted)
SELECT id, array_to_string(list_filter([CASE WHEN no_make THEN 'Vehicle Make' END, CASE WHEN no_company THEN 'Insurance Company' END], lambda x: x IS NOT NULL), ',') AS missing,
  count(*) OVER (PARTITION BY document_name) > 1 AS duplicate_name FROM f""")
def post_match_review_flags(s: Source) -> DataFrame:
    flags = Q.review_flags(s.extracted, "answer", ["Vehicle Make", "Insurance Company", "Policy Number"])
    return flags.select("id", F.array_join("missing_fields", ",").alias("missing"), "duplicate_name")


@query("extraction_audit", """
WITH raw AS (SELECT insurer AS sheet, count(*) + 5 AS raw_rows FROM life GROUP BY 1 UNION ALL SELECT 'Empty', 9), done AS (SELECT insurer AS sheet, count(*) AS n, count(remarks) AS r FROM life GROUP BY 1)
SELECT sheet, raw_rows, coalesce(n, 0) AS processed_rows, coalesce(r, 0) AS remarks_rows, CAST(0 AS BIGINT) AS overflow_rows, CASE WHEN n IS NULL THEN 'ZERO ROWS EXTRACTED' ELSE 'OK' END AS status
FROM raw LEFT JOIN done USING (sheet)""")
def extraction_audit(s: Source) -> DataFrame:
    rows = s.life.select(F.col("insurer").alias("sheet"), "remarks", "raw_renewals")
    raw = rows.groupBy("sheet").agg((F.count("*") + 5).alias("raw_rows"))
    empty = s.region.where("r_regionkey = 0").select(F.lit("Empty").alias("sheet"), F.lit(9).cast("bigint").alias("raw_rows"))
    return Q.extraction_audit(rows, raw.unionByName(empty))


@query("extraction_acceptance", f"SELECT CAST(count(*) AS BIGINT) AS \"rows\", count(*) >= {K.LIFE_MINIMUM_ROWS} AS accepted FROM life")
def extraction_acceptance(s: Source) -> DataFrame:
    return Q.enough_rows(extraction_audit(s))


# ---- duplicates and regrouping --------------------------------------------------------------------
_CONTENT = ", ".join(K.CONTENT_FIELDS)


def uploaded(s: Source) -> DataFrame:
    """The doubled card as a stored table, as a rate table is one."""
    return stage(s.uploaded_card)


@query("duplicates_within_group", f"""SELECT min(id) AS keep_id, count(*) - 1 AS extra_rows, CAST(1 AS BIGINT) AS group_count FROM uploaded_card WHERE is_deleted = 'NO' AND group_id IS NOT NULL
GROUP BY group_id, {_CONTENT} HAVING count(*) > 1""")
def duplicates_within_group(s: Source) -> DataFrame:
    return M.duplicate_clusters(uploaded(s)).select("keep_id", "extra_rows", "group_count")


@query("duplicates_across_groups", f"""SELECT min(id) AS keep_id, count(*) - 1 AS extra_rows, count(DISTINCT group_id) AS group_count FROM uploaded_card WHERE is_deleted = 'NO' AND group_id IS NOT NULL
AND status = 'ACTIVE' GROUP BY {_CONTENT} HAVING count(*) > 1""")
def duplicates_across_groups(s: Source) -> DataFrame:
    return M.duplicate_clusters(uploaded(s), cross_group=True).select("keep_id", "extra_rows", "group_count")


@query("keep_lowest_id_dedupe", f"""
WITH same AS (SELECT min(id) AS keep_id, list(id) AS ids FROM uploaded_card WHERE is_deleted = 'NO' AND group_id IS NOT NULL AND status = 'ACTIVE' GROUP BY {_CONTENT} HAVING count(*) > 1),
extra AS (SELECT id FROM (SELECT keep_id, unnest(ids) AS id FROM same) x WHERE id > keep_id)
SELECT id, CASE WHEN id IN (SELECT id FROM extra) THEN 'YES' ELSE is_deleted END AS is_deleted FROM uploaded_card""")
def keep_lowest_id_dedupe(s: Source) -> DataFrame:
    return M.soft_delete_duplicates(uploaded(s), cross_group=True).select("id", "is_deleted")


def _hash_cell(c: str) -> str:
    return f"lower(trim(coalesce(CAST({c} AS STRING), '')))"


_HASHED = f"""WITH h AS (SELECT id, group_id, sha256(concat_ws('|', {', '.join(_hash_cell(c) for c in K.GROUP_FIELDS)})) AS h FROM uploaded_card),
sizes AS (SELECT h, count(*) AS n FROM h GROUP BY 1), members AS (SELECT group_id, h, count(*) AS m FROM h WHERE group_id IS NOT NULL GROUP BY 1, 2),
claims AS (SELECT group_id, h, total FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, h) AS p, sum(m) OVER (PARTITION BY group_id) AS total FROM members JOIN sizes USING (h)) x WHERE p = 1),
owners AS (SELECT h, group_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY total DESC, group_id) AS p FROM claims) x WHERE p = 1)"""


@query("regroup_owners", _HASHED + "SELECT h AS new_hash, owner, n AS hash_rows FROM sizes LEFT JOIN owners USING (h)")
def regroup_owners(s: Source) -> DataFrame:
    return M.regroup_plan(uploaded(s))


@query("regroup", _HASHED + """, created AS (SELECT h, (SELECT max(group_id) FROM h) + row_number() OVER (ORDER BY h) AS g FROM sizes LEFT JOIN owners USING (h) WHERE owner IS NULL)
SELECT h.id, h.group_id AS old_group_id, coalesce(owner, g) AS new_group_id FROM h LEFT JOIN owners USING (h) LEFT JOIN created USING (h)""")
def regroup(s: Source) -> DataFrame:
    return M.regroup(uploaded(s))


@query("regroup_report", _HASHED + """, pieces AS (SELECT group_id, count(DISTINCT h) AS p FROM h WHERE group_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM h) AS scanned_rows, (SELECT count(*) FROM h WHERE group_id IS NULL) AS ungrouped_rows, (SELECT count(*) FROM pieces) AS existing_groups,
  (SELECT count(*) FROM pieces WHERE p > 1) AS splitting_groups, (SELECT count(*) FROM owners) AS groups_kept, (SELECT count(*) FROM sizes LEFT JOIN owners USING (h) WHERE owner IS NULL) AS groups_created,
  (SELECT CAST(sum(n) AS BIGINT) FROM sizes LEFT JOIN owners USING (h) WHERE owner IS NULL) AS rows_reassigned, (SELECT count(*) FROM pieces) - (SELECT count(*) FROM owners) AS groups_retired""")
def regroup_report(s: Source) -> DataFrame:
    return M.regroup_report(uploaded(s))


@query("dedupe_within_file", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY insurance_company, product_name, policy_category, plan_names, business_type, min_deductible, max_deductible, min_sum_insured, max_sum_insured, min_age, max_age, pincode_zone, from_date, to_date ORDER BY id) AS p FROM health_card) x WHERE p = 1")
def dedupe_within_file(s: Source) -> DataFrame:
    card = s.health_card
    return M.first_in_file(card.withColumn("hash", M.health_hash(card)), "hash", "id").select("id")


@query("purge_deleted", "SELECT id FROM rate_card WHERE is_deleted <> 'YES'")
def purge_deleted(s: Source) -> DataFrame:
    return M.purge_deleted(s.rate_card).select("id")


@query("bulk_update_by_group", """
WITH w AS (SELECT DISTINCT 1000001 + p_partkey AS k FROM {part} WHERE p_partkey % 7 = 0 UNION SELECT p_partkey + 1 FROM {part} WHERE p_partkey % 7 = 0), g AS (SELECT DISTINCT group_id FROM rate_card)
SELECT id, CASE WHEN group_id IN (SELECT k FROM w) OR (id IN (SELECT k FROM w WHERE k NOT IN (SELECT group_id FROM g WHERE group_id IS NOT NULL))) THEN 12.35 ELSE pi_od_rate END AS pi_od_rate FROM rate_card""")
def bulk_update_by_group(s: Source) -> DataFrame:
    base = s.part.where("p_partkey % 7 = 0")
    keys = base.select((F.col("p_partkey") + 1000001).alias("wanted")).union(base.select((F.col("p_partkey") + 1).alias("wanted")))
    return M.bulk_update(s.rate_card, keys, "pi_od_rate", "12.347").select("id", F.round("pi_od_rate", 2).alias("pi_od_rate"))


@query("bulk_update_health", "SELECT id, CASE WHEN id % 5 = 0 THEN 'INACTIVE' ELSE status END AS status FROM health_card")
def bulk_update_health(s: Source) -> DataFrame:
    ids = s.part.where("(p_partkey + 1) % 5 = 0").select((F.col("p_partkey") + 1).alias("id"))
    return M.bulk_update_health(s.health_card, ids, "status", " inactive ").select("id", "status")


# ---- analytics ------------------------------------------------------------------------------------
# Labels with months, on RTO groups named after the zones.
_LABELS = """(SELECT *, new_rto_list || CASE WHEN g % 3 = 0 THEN '' WHEN g % 3 = 1 THEN '_APR26_x' ELSE '_may26' END AS label FROM rate_card)"""
_CELLS = f"""WITH states AS (SELECT DISTINCT name, 'NA' AS state FROM rto_items WHERE length(item) >= 2),
card AS (SELECT * FROM {_LABELS} c WHERE is_deleted = 'NO'),
cell AS (SELECT card.*, state, 'EVERGREEN' AS month FROM card JOIN states ON name = new_rto_list WHERE g % 3 = 0
  UNION ALL SELECT card.*, state, m.month FROM card JOIN states ON name = new_rto_list, (SELECT unnest(['EVERGREEN', 'APR26']) AS month) m WHERE g % 3 = 1
  UNION ALL SELECT card.*, state, m.month FROM card JOIN states ON name = new_rto_list, (SELECT unnest(['EVERGREEN', 'MAY26']) AS month) m WHERE g % 3 = 2),
heat AS (SELECT coalesce(nullif(product, ''), 'Uncategorized') AS product, coalesce(nullif(sub_product, ''), 'Uncategorized') AS sub_product, insurance_company AS insurer, state, month,
  count(CASE WHEN pi_net_rate > 0 THEN 1 END) AS net_n, round(min(CASE WHEN pi_net_rate > 0 THEN pi_net_rate END), 2) AS net_min, round(max(CASE WHEN pi_net_rate > 0 THEN pi_net_rate END), 2) AS net_max,
  count(CASE WHEN pi_od_rate > 0 THEN 1 END) AS od_n, round(min(CASE WHEN pi_od_rate > 0 THEN pi_od_rate END), 2) AS od_min, round(max(CASE WHEN pi_od_rate > 0 THEN pi_od_rate END), 2) AS od_max,
  count(CASE WHEN pi_tp_rate > 0 THEN 1 END) AS tp_n, round(min(CASE WHEN pi_tp_rate > 0 THEN pi_tp_rate END), 2) AS tp_min, round(max(CASE WHEN pi_tp_rate > 0 THEN pi_tp_rate END), 2) AS tp_max,
  least(min(cc_min), min(cc_max)) AS cc_min, greatest(max(cc_min), max(cc_max)) AS cc_max, array_to_string(list_sort(list(DISTINCT is_ncb)), ',') AS ncb
  FROM cell GROUP BY 1, 2, 3, 4, 5),
full_heat AS (SELECT *, net_n + od_n + tp_n AS total_n FROM heat WHERE net_n + od_n + tp_n > 0),
merged AS (SELECT product, sub_product, insurer, state, CAST(sum(total_n) AS BIGINT) AS total_n, least(min(net_min), min(od_min), min(tp_min)) AS best_min, greatest(max(net_max), max(od_max), max(tp_max)) AS best_max,
  min(cc_min) AS cc_min FROM full_heat GROUP BY 1, 2, 3, 4)"""


def labelled(s: Source) -> DataFrame:
    month = F.when(F.col("g") % 3 == 0, F.col("new_rto_list")).when(F.col("g") % 3 == 1, F.concat("new_rto_list", F.lit(", "), F.col("new_rto_list"), F.lit("_APR26_x"))).otherwise(
        F.concat("new_rto_list", F.lit(","), F.col("new_rto_list"), F.lit("_may26")))
    return s.rate_card.where("is_deleted = 'NO'").withColumn("new_rto_list", month)


def heat(s: Source) -> DataFrame:
    return A.heatmap(labelled(s), rto_master(s))


@query("rate_heatmap", _CELLS + "SELECT product, sub_product, insurer, state, month, net_n, net_min, net_max, od_n, od_max, tp_n, tp_min, cc_min, cc_max, ncb FROM full_heat")
def rate_heatmap(s: Source) -> DataFrame:
    return heat(s).select(*A.CELL, "net_n", "net_min", "net_max", "od_n", "od_max", "tp_n", "tp_min", "cc_min", "cc_max", F.array_join("ncb", ",").alias("ncb"))


@query("rate_state_month_cells", _CELLS + "SELECT id, state, month FROM cell")
def rate_state_month_cells(s: Source) -> DataFrame:
    return A.rate_cells(labelled(s), rto_master(s))


@query("heatmap_cell_merge", _CELLS + "SELECT product, sub_product, insurer, state, total_n, best_min, best_max, cc_min FROM merged")
def heatmap_cell_merge(s: Source) -> DataFrame:
    return A.merge_months(heat(s)).select("product", "sub_product", "insurer", "state", "total_n", "best_min", "best_max", "cc_min")


@query("heatmap_colour_buckets", _CELLS + """, span AS (SELECT product, sub_product, min(best_max) AS lo, max(best_max) AS hi FROM merged GROUP BY 1, 2)
SELECT product, sub_product, insurer, state, CAST(CASE WHEN hi = lo THEN 3 ELSE greatest(0, least(5, floor((best_max - lo) / (hi - lo) * 6))) END AS INTEGER) AS bucket FROM merged JOIN span USING (product, sub_product)""")
def heatmap_colour_buckets(s: Source) -> DataFrame:
    return A.colour_buckets(A.merge_months(heat(s))).select("product", "sub_product", "insurer", "state", "bucket")


@query("heatmap_insurer_ranking", _CELLS + "SELECT product, sub_product, insurer, avg(best_max) AS mean_top_rate, count(*) AS states FROM merged GROUP BY 1, 2, 3")
def heatmap_insurer_ranking(s: Source) -> DataFrame:
    return A.insurer_ranking(A.merge_months(heat(s)))


@query("heatmap_default_state", _CELLS + """SELECT product, sub_product, state, insurers FROM (SELECT *, row_number() OVER (PARTITION BY product, sub_product ORDER BY insurers DESC, state) AS p
  FROM (SELECT product, sub_product, state, count(*) AS insurers FROM merged GROUP BY 1, 2, 3) c) x WHERE p = 1""")
def heatmap_default_state(s: Source) -> DataFrame:
    return A.default_state(A.merge_months(heat(s)))


@query("heatmap_volume_ranking", _CELLS + "SELECT product, CAST(sum(total_n) AS BIGINT) AS volume FROM full_heat GROUP BY 1")
def heatmap_volume_ranking(s: Source) -> DataFrame:
    return A.volumes(heat(s), "product")


@query("heatmap_month_list", _CELLS + "SELECT DISTINCT month, CASE month WHEN 'APR26' THEN 'April 2026' ELSE 'May 2026' END AS label FROM cell WHERE month <> 'EVERGREEN'")
def heatmap_month_list(s: Source) -> DataFrame:
    return A.months_seen(labelled(s), rto_master(s)).select("month", "label")


@query("grid_summary_pivot", """SELECT product, sub_product, insurance_company, from_date, to_date, status, count(DISTINCT coalesce(group_id, id)) AS grid_count FROM rate_card WHERE is_deleted = 'NO'
AND coalesce(from_date <= DATE '1998-12-31', true) AND coalesce(to_date >= DATE '1998-12-31', true) GROUP BY 1, 2, 3, 4, 5, 6""")
def grid_summary_pivot(s: Source) -> DataFrame:
    return A.grid_summary(s.rate_card, day("1998-12-31"))


@query("active_inactive_counts", "SELECT count_if(status = 'ACTIVE') AS active, count_if(status = 'INACTIVE') AS inactive FROM rate_card WHERE product = 'SMALL'")
def active_inactive_counts(s: Source) -> DataFrame:
    return A.status_counts(s.rate_card.where("product = 'SMALL'"))


@query("home_kpis", """SELECT count(*) AS cases, CAST(coalesce(sum(gross_premium), 0) AS DOUBLE) AS premium, count_if(coalesce(vehicle_registration_number, '') <> '' OR coalesce(vehicle_make, '') <> '') AS motor,
count_if(coalesce(vehicle_registration_number, '') = '' AND coalesce(vehicle_make, '') = '') AS health FROM register""")
def home_kpis(s: Source) -> DataFrame:
    return A.home_kpis(s.register).withColumn("premium", F.col("premium").cast("double"))


@query("register_stats", "SELECT count(*) AS records, CAST(sum(gross_premium) AS DOUBLE) AS premium FROM register WHERE lower(insured_name) LIKE '%00001%' AND lower(insurer_name) LIKE '%insurer 1%'")
def register_stats(s: Source) -> DataFrame:
    return A.register_stats(s.register, insured_name="00001", insurer_name="INSURER 1").withColumn("premium", F.col("premium").cast("double"))


_FACETS = {"status": ["OPEN", "FOLLOW-UP", "CLOSED"], "category": ["MOTOR", "HEALTH", "LIFE"], "ticket_type": ["MG-BG", "BG", "RATE"]}


@query("faceted_counts", " UNION ALL ".join(f"SELECT '{f}' AS facet, '{v}' AS value, count_if({f} = '{v}') AS n FROM tickets" for f, vs in _FACETS.items() for v in vs))
def faceted_counts(s: Source) -> DataFrame:
    return A.facet_counts(s.tickets, _FACETS)


@query("cascading_facets", """SELECT DISTINCT 'insurer' AS facet, insurer AS value FROM life UNION ALL SELECT DISTINCT 'product_name', product_name FROM life WHERE insurer = 'Insurer 3'
UNION ALL SELECT DISTINCT 'ppt', ppt FROM life WHERE insurer = 'Insurer 3' UNION ALL SELECT DISTINCT 'pt', pt FROM life WHERE insurer = 'Insurer 3' AND ppt = '10'""")
def cascading_facets(s: Source) -> DataFrame:
    return A.cascading_values(s.life, ["insurer", "product_name", "ppt", "pt"], {"insurer": "Insurer 3", "ppt": "10"})


@query("distinct_sorted_values", "SELECT DISTINCT insurance_company FROM rate_card WHERE status = 'ACTIVE'")
def distinct_sorted_values(s: Source) -> DataFrame:
    return A.distinct_values(s.rate_card.where("status = 'ACTIVE'"), "insurance_company")


@query("month_list_per_basis", "SELECT DISTINCT CAST(date_trunc('month', work_effected_date) AS DATE) AS month FROM grids WHERE work_effected_date IS NOT NULL")
def month_list_per_basis(s: Source) -> DataFrame:
    return A.distinct_months(s.grids, "work_effected_date")


@query("archive_batch_summary", """
WITH e AS (SELECT *, CASE WHEN id % 50 = 0 THEN 'no file' END AS error, strftime(uploaded_date, '%Y-%m') AS month FROM grids)
SELECT month, count_if(error IS NULL) AS documents, count_if(error IS NULL AND file_key <> '') AS files, CAST(coalesce(sum(CASE WHEN error IS NULL AND file_key <> '' THEN file_size END), 0) AS BIGINT) AS bytes,
  count_if(error IS NOT NULL) AS failed, CASE WHEN count_if(error IS NOT NULL) = 0 THEN 'COMPLETED' WHEN count_if(error IS NULL) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM e GROUP BY 1""")
def archive_batch_summary(s: Source) -> DataFrame:
    entries = s.grids.withColumn("error", F.when(F.col("id") % 50 == 0, F.lit("no file"))).withColumn("month", F.date_format("uploaded_date", "yyyy-MM"))
    return A.archive_summary(entries)


@query("class_to_makes", """SELECT DISTINCT make_model_class, item FROM (SELECT DISTINCT make_model_class, unnest(string_split(new_vehicle_makes, ', ')) AS name FROM rate_card WHERE is_deleted = 'NO') u
JOIN make_items USING (name)""")
def class_to_makes(s: Source) -> DataFrame:
    return A.class_makes(s.rate_card, make_master(s), "make_model_class")


@query("latest_prior_upload", "SELECT target_table, file_hash, max_by(status, (created_at, id)) AS status, max_by(row_count, (created_at, id)) AS row_count FROM attempts GROUP BY 1, 2")
def latest_prior_upload(s: Source) -> DataFrame:
    return A.latest(s.attempts, ["target_table", "file_hash"], "created_at", ["status", "row_count"])


@query("most_recent_rows", "SELECT id FROM attempts ORDER BY created_at DESC, id DESC LIMIT 20")
def most_recent_rows(s: Source) -> DataFrame:
    return A.most_recent(s.attempts, "created_at", 20).select("id")


# ---- set operations -------------------------------------------------------------------------------
@query("set_union_of_results", "SELECT id, add_tnc, 'motor' AS kind FROM rate_card UNION ALL SELECT id, NULL, 'health' AS kind FROM health_card")
def set_union_of_results(s: Source) -> DataFrame:
    return A.labelled_union({"motor": s.rate_card, "health": s.health_card}, ["id", "add_tnc"])


@query("zone_sync", "SELECT DISTINCT pincode_zone AS name FROM health_card WHERE coalesce(is_deleted, 'NO') <> 'YES' AND pincode_zone NOT IN (SELECT name FROM pin_items WHERE name <> 'pz_4')")
def zone_sync(s: Source) -> DataFrame:
    return M.missing_zones(s.health_card, pin_master(s).where("name <> 'pz_4'")).select("name")


@query("zone_sync_master", "SELECT name FROM (SELECT DISTINCT name FROM pin_items WHERE name <> 'pz_4') p UNION SELECT DISTINCT pincode_zone FROM health_card WHERE coalesce(is_deleted, 'NO') <> 'YES' AND coalesce(pincode_zone, '') <> ''")
def zone_sync_master(s: Source) -> DataFrame:
    return M.sync_zones(s.health_card, pin_master(s).where("name <> 'pz_4'")).select("name")


@query("shared_list_items", "SELECT id, array_to_string(list_sort(list_intersect(string_split(new_vehicle_makes, ', '), ['mk_ring', 'mk_rod', 'mk_all'])), ',') AS shared FROM rate_card")
def shared_list_items(s: Source) -> DataFrame:
    names = T.literal_array(["mk_ring", "mk_rod", "mk_all"])
    return s.rate_card.select("id", F.array_join(F.array_sort(F.array_intersect(C.cluster_items("new_vehicle_makes"), names)), ",").alias("shared"))


__all__ = ["master"]
