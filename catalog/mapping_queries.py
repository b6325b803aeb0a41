"""Mapping: routing, resolution, the rule joins, results and amounts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalog.bridge import RUN_YEAR, master
from catalog import fuzzy_sql as Z
from catalog.registry import Source, query
from ratecraft import constants as K
from ratecraft.functions import text as T
from ratecraft.operators import gaps as G, rulejoin as J, resolve as R
from ratecraft.plans import mapping as M
from ratecraft.session import shared_folder, stage
from ratecraft.sources import policies as P, rates as S
from ratecraft.sources.reports import write_csv


def rto_master(s: Source) -> DataFrame:
    return master(s.spark, s.sf_dir, "rto_items")


def make_master(s: Source) -> DataFrame:
    return master(s.spark, s.sf_dir, "make_items")


def pin_master(s: Source) -> DataFrame:
    return master(s.spark, s.sf_dir, "pin_items")


def motor_features(s: Source, policies: DataFrame | None = None) -> DataFrame:
    motor = (s.mis if policies is None else policies).where(M.route() == "motor")
    features = P.motor_features(motor, RUN_YEAR)
    return M.resolve_motor(features, S.motor_rate_rows(s.rate_card), rto_master(s), make_master(s))


def motor_results(s: Source, policies: DataFrame | None = None, all_ids: bool = False) -> DataFrame:
    return M.map_motor(motor_features(s, policies), S.motor_rate_rows(s.rate_card), all_ids)


# The motor chain in SQL: every policy against every active rate of its insurer, a bit per rule, the greatest mask.
_FEATURES = f"""
WITH cell AS (
  SELECT *, coalesce(lower(trim(vehproduct)), '') AS f_product, coalesce(lower(sub_product), '') AS f_sub,
    coalesce(lower(fuel), '') AS f_fuel, coalesce(lower(vehicle_class), '') AS f_class,
    cc LIKE '% / %' AS f_combined, TRY_CAST(regexp_replace(cc, '[^0-9.]', '', 'g') AS DOUBLE) AS f_cc,
    CAST(seating AS DOUBLE) AS f_sc, CAST(tariff AS DOUBLE) AS f_tariff,
    {RUN_YEAR + 1} - CASE WHEN sub_product IN ('1+3', '1+5')
      THEN TRY_CAST(regexp_extract(inception, '(19|20)[0-9][0-9]') AS INTEGER)
      ELSE TRY_CAST(right(registration, 4) AS INTEGER) END AS f_age,
    CASE WHEN inception <> '' THEN inception_date END AS f_date,
    lower(trim(make || ' ' || coalesce(model, ''))) AS f_make,
    CASE WHEN rto IS NULL THEN '' ELSE clean_rto END AS f_rto,
    TRY_CAST(ncb AS DOUBLE) AS f_ncb, TRY_CAST(cpa AS DOUBLE) AS f_cpa, upper(nil_dep) AS f_zd,
    CASE WHEN insurer IS NOT NULL AND insurer_no < 10
      THEN 'supplier ' || lpad(CAST(insurer_no AS STRING), 2, '0') || ' general insurance co ltd' END AS f_insurer
  FROM mis WHERE lower(trim(product)) = 'motor'
), model_word AS (
  SELECT DISTINCT f_make, upper(w) AS w FROM (
    SELECT f_make, unnest(string_split(regexp_replace(replace(f_make, '-', ' '), '([a-z])([0-9])', '\\1 \\2', 'g'), ' ')) AS w
    FROM (SELECT DISTINCT f_make FROM cell)) words WHERE w <> ''
), item_word AS (
  SELECT DISTINCT name, item, upper(w) AS w FROM (SELECT name, item, unnest(string_split(item, ' ')) AS w FROM make_items) words
), make_name AS (
  SELECT f_make, list(DISTINCT name ORDER BY name) AS makes FROM (
    SELECT f_make, name, item FROM model_word JOIN item_word USING (w) GROUP BY 1, 2, 3 HAVING count(*) >= 2) hits GROUP BY 1
), rto_name AS (
  SELECT lower(item) AS f_rto, list(DISTINCT name ORDER BY name) AS rtos FROM rto_items GROUP BY 1
), feature AS (
  SELECT cell.*, coalesce(makes, []) AS makes, coalesce(rtos, []) AS rtos FROM cell
  LEFT JOIN make_name USING (f_make) LEFT JOIN rto_name USING (f_rto)
), active AS (
  SELECT *, lower(insurance_company) AS r_insurer, string_split(new_vehicle_makes, ', ') AS r_makes,
    [new_rto_list] AS r_rtos, coalesce(is_cpa, 'NA') AS r_cpa FROM rate_card WHERE status = 'ACTIVE' AND is_deleted = 'NO'
), tested AS (
  SELECT f.row_id, r.id, coalesce(r.group_id, r.id) AS group_key, r.po_type, r.pi_type, r.po_od_rate, r.po_tp_rate,
    r.po_net_rate, r.pi_od_rate, r.pi_tp_rate, r.pi_net_rate,
    8192 * CAST(r.product = '' OR lower(r.product) = f_product AS INTEGER)
    + 4096 * CAST(r.sub_product = '' OR lower(r.sub_product) = f_sub AS INTEGER)
    + 2048 * CAST(r.fuel_type = '' OR lower(r.fuel_type) = f_fuel AS INTEGER)
    + 1024 * CAST(r.make_model_class = 'NA' OR (f_class <> '' AND lower(r.make_model_class) = f_class) AS INTEGER)
    + 512 * CAST(f_combined OR CASE WHEN f_cc IS NULL THEN r.cc_min IS NULL AND r.cc_max IS NULL
        ELSE coalesce(r.cc_min <= f_cc, true) AND coalesce(r.cc_max >= f_cc, true) END AS INTEGER)
    + 256 * CAST(coalesce(r.sc_min <= f_sc, true) AND coalesce(r.sc_max >= f_sc, true) AS INTEGER)
    + 128 * CAST(CASE WHEN f_age IS NULL THEN r.vehicle_age_min IS NULL AND r.vehicle_age_max IS NULL
        ELSE coalesce(r.vehicle_age_min < f_age, true) AND coalesce(r.vehicle_age_max >= f_age, true) END AS INTEGER)
    + 64 * CAST(coalesce(r.tariff_min <= f_tariff, true) AND coalesce(r.tariff_max >= f_tariff, true) AS INTEGER)
    + 32 * CAST(CASE WHEN f_date IS NULL THEN r.from_date IS NULL AND r.to_date IS NULL
        ELSE coalesce(r.from_date <= f_date, true) AND coalesce(r.to_date >= f_date, true) END AS INTEGER)
    + 16 * CAST(list_has_any(makes, r_makes) AS INTEGER)
    + 8 * CAST(f_rto <> '' AND list_has_any(rtos, r_rtos) AS INTEGER)
    + 4 * CAST(r.is_ncb = 'NA' OR coalesce(r.is_ncb = 'YES' AND f_ncb BETWEEN 1 AND 99, false)
        OR coalesce(r.is_ncb = 'NO' AND f_ncb = 0, false) AS INTEGER)
    + 2 * CAST(r_cpa = 'NA' OR coalesce(r_cpa = 'YES' AND f_cpa BETWEEN 1 AND 1000, false)
        OR coalesce(r_cpa = 'NO' AND f_cpa = 0, false) AS INTEGER)
    + CAST(r.is_zd = 'NA' OR (r.is_zd = 'YES' AND f_zd IN ('1', 'YES', 'Y', 'TRUE'))
        OR (r.is_zd = 'NO' AND f_zd IN ('0', 'NO', 'N', 'FALSE')) AS INTEGER) AS mask
  FROM feature f JOIN active r ON r.r_insurer = f.f_insurer
)
"""

_SIDE = """CASE {s}_type WHEN 'On OD and TP' THEN coalesce({s}_od_rate, 0) + coalesce({s}_tp_rate, 0) WHEN 'On TP' THEN {s}_tp_rate
  WHEN 'On OD' THEN {s}_od_rate WHEN 'On Net' THEN {s}_net_rate END"""
_SIGN = """{s}_type || ':' || coalesce(CAST(round(""" + _SIDE + """, 6) AS STRING), '-') || ':' || CASE WHEN {s}_type = 'On OD and TP'
  THEN CAST(coalesce({s}_od_rate, 0) AS STRING) || '+' || CAST(coalesce({s}_tp_rate, 0) AS STRING) ELSE '' END"""
_EFFECTIVE = """CASE WHEN po_type = 'On OD and TP' THEN coalesce(po_od_rate, 0) + coalesce(po_tp_rate, 0)
  WHEN po_net_rate > 0 THEN po_net_rate WHEN po_od_rate > 0 THEN po_od_rate WHEN po_tp_rate > 0 THEN po_tp_rate ELSE 0 END"""
_DECIDED = _FEATURES + f""", hit AS (
  SELECT *, {_SIGN.format(s='po')} || '/' || {_SIGN.format(s='pi')} AS signature, {_EFFECTIVE} AS effective
  FROM tested WHERE mask = 16383
), found AS (
  SELECT row_id, count(DISTINCT group_key) AS groups, count(*) AS row_total, count(DISTINCT signature) AS payouts,
    min(group_key) AS low_key FROM hit GROUP BY 1
), used AS (
  SELECT * FROM (SELECT hit.*, row_number() OVER (PARTITION BY hit.row_id ORDER BY effective, id) AS place
    FROM hit JOIN found ON found.row_id = hit.row_id AND hit.group_key = found.low_key) ranked WHERE place = 1
), best AS (SELECT row_id, max(mask) AS mask FROM tested GROUP BY 1)
"""


@query("motor_rule_join", _DECIDED + f"""
SELECT found.row_id, groups AS group_count, CAST(row_total AS BIGINT) AS row_count, payouts = 1 AS same_payout,
  low_key AS group_key, {_SIDE.format(s='po')} AS po_rate, {_SIDE.format(s='pi')} AS pi_rate
FROM found JOIN used USING (row_id)""")
def motor_rule_join(s: Source) -> DataFrame:
    rates = J.with_group_places(S.motor_rate_rows(s.rate_card))
    found = J.matched_groups(stage(motor_features(s)), rates, J.motor_chain(), J.motor_payload(), 0).where("group_count > 0")
    return found.select(
        "row_id", "group_count", "row_count", "same_payout", "group_key", J.chosen_rate("po").alias("po_rate"),
        J.chosen_rate("pi").alias("pi_rate"),
    )


@query("keep_on_fail_masks", _DECIDED + "SELECT row_id, CAST(mask AS BIGINT) AS mask FROM best")
def keep_on_fail_masks(s: Source) -> DataFrame:
    return J.indexed_masks(stage(motor_features(s)), S.motor_rate_rows(s.rate_card), J.motor_chain())


# ---- whole motor results --------------------------------------------------------------------------
def _amount(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'null', 'nul', 'nill', 'na') THEN 0.0 "
            f"ELSE TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE) END")


def _shown_amount(c: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{{{:,.2f}}}}', {c}), '0+$', ''), '\\.$', '')"


_OD, _TP, _NCB = "Policy: total od", "Policy: tp premium", "Policy: no claim bonus"
_BOTH = f"upper(sub) || ' policies must carry premium in both {_OD} and {_TP}.'"
_VALIDATION = f"""checked AS (
  SELECT *, list_filter([
    CASE WHEN od IS NULL THEN '{_OD} value ''' || trim(total_od) || ''' is not a valid number, so the premium split of this ' || upper(sub) || ' policy could not be checked.' END,
    CASE WHEN tp IS NULL THEN '{_TP} value ''' || trim(tp_premium) || ''' is not a valid number, so the premium split of this ' || upper(sub) || ' policy could not be checked.' END,
    CASE WHEN sub = 'stp' AND tp = 0 THEN '{_TP} is zero/blank, but STP policies must carry their premium there.' END,
    CASE WHEN sub = 'stp' AND od <> 0 THEN '{_OD} is ' || {_shown_amount('od')} || ', but STP policies must have it zero/blank (the premium belongs in {_TP} only).' END,
    CASE WHEN sub = 'saod' AND od = 0 THEN '{_OD} is zero/blank, but SAOD policies must carry their premium there.' END,
    CASE WHEN sub = 'saod' AND tp <> 0 THEN '{_TP} is ' || {_shown_amount('tp')} || ', but SAOD policies must have it zero/blank (the premium belongs in {_OD} only).' END,
    CASE WHEN sub LIKE '1+%' AND car AND od = 0 THEN '{_OD} is zero/blank, but Private Car ' || upper(sub) || ' policies must carry premium in {_OD} ({_TP} is optional).' END,
    CASE WHEN sub LIKE '1+%' AND NOT car AND od = 0 AND tp = 0 THEN '{_OD} and {_TP} are both zero/blank, but ' || {_BOTH} END,
    CASE WHEN sub LIKE '1+%' AND NOT car AND od = 0 AND (tp <> 0 OR tp IS NULL) THEN '{_OD} is zero/blank, but ' || {_BOTH} END,
    CASE WHEN sub LIKE '1+%' AND NOT car AND tp = 0 AND (od <> 0 OR od IS NULL) THEN '{_TP} is zero/blank, but ' || {_BOTH} END,
    CASE WHEN sub IN ('1+3', '1+5') AND bonus IS NULL THEN '{_NCB} value ''' || trim(ncb) || ''' is not a valid number, so it could not be checked against the '
      || upper(sub) || ' rule (zero/blank required).' END,
    CASE WHEN sub IN ('1+3', '1+5') AND bonus <> 0 THEN '{_NCB} is ' || {_shown_amount('bonus')} || ', but ' || upper(sub) || ' policies must have it zero/blank.' END
  ], lambda x: x IS NOT NULL) AS problems
  FROM (SELECT *, lower(trim(sub_product)) AS sub, coalesce(lower(trim(vehproduct)) = 'private car', false) AS car, {_amount('total_od')} AS od,
    {_amount('tp_premium')} AS tp, {_amount('ncb')} AS bonus FROM {{source}}) amounts
), validated AS (
  SELECT row_id, CASE WHEN sub IN ('stp', 'saod', '1+1', '1+3', '1+5') AND len(problems) > 0 THEN 'Validation error — ' || array_to_string(problems, ' ')
    || ' Correct the source MIS data and re-run mapping for this row.' END AS problem FROM checked
)"""
_CARS = "(SELECT * REPLACE (CASE WHEN row_id % 4 = 0 THEN 'Private Car' ELSE vehproduct END AS vehproduct) FROM mis)"


@query("premium_split_validation", f"WITH {_VALIDATION.replace('{source}', _CARS)} SELECT row_id, problem FROM validated")
def premium_split_validation(s: Source) -> DataFrame:
    from ratecraft.operators.amounts import premium_validation

    cars = F.when(F.col("row_id") % 4 == 0, F.lit("Private Car")).otherwise(F.col("vehproduct"))
    problem = premium_validation(F.col("sub_product"), cars, F.col("total_od"), F.col("tp_premium"), F.col("ncb"))
    return s.mis.select("row_id", problem.alias("problem"))


_RANGE_OPEN = " is blank/unparseable on this policy, and no remaining candidate rate row has an open (blank) range."
_RANGE_OUT = " falls outside the range configured on every remaining candidate rate row."
_DETAILS = f"""[
  CASE WHEN NOT bit13 THEN 'Policy: vehproduct — Value ''' || coalesce(nullif(f_product, ''), 'nan') || ''' did not match any remaining candidate Rate Master row''s product (after the previous rules narrowed the field).' END,
  CASE WHEN NOT bit12 THEN 'Policy: sub product — Value ''' || coalesce(nullif(f_sub, ''), 'nan') || ''' did not match any remaining candidate Rate Master row''s sub product (after the previous rules narrowed the field).' END,
  CASE WHEN NOT bit11 THEN 'Policy: fuel — Value ''' || coalesce(nullif(f_fuel, ''), 'nan') || ''' did not match any remaining candidate Rate Master row''s fuel type (after the previous rules narrowed the field).' END,
  CASE WHEN NOT bit10 THEN 'Policy: vehicle class — Vehicle class ''' || coalesce(nullif(f_class, ''), 'nan') || ''' has no exact match among remaining candidate rate rows, and none of them has an NA-wildcard class.' END,
  CASE WHEN NOT bit9 THEN 'Policy: cc cubic capacity — Policy: cc cubic capacity' || coalesce(' value ' || CAST(f_cc AS STRING) || '{_RANGE_OUT}', '{_RANGE_OPEN}') END,
  CASE WHEN NOT bit8 THEN 'Policy: seating capacity — Policy: seating capacity value ' || CAST(f_sc AS STRING) || '{_RANGE_OUT}' END,
  CASE WHEN NOT bit7 THEN age_label || ' — ' || coalesce('Calculated vehicle age ''' || CAST(f_age AS STRING) || ''' ((current year + 1) - the year in ' || age_label
    || ') falls outside the age band (lower bound exclusive, upper bound inclusive) configured on every remaining candidate rate row.', age_label || '{_RANGE_OPEN}') END,
  CASE WHEN NOT bit6 THEN 'Policy: tariff rate — Policy: tariff rate value ' || CAST(f_tariff AS STRING) || '{_RANGE_OUT}' END,
  CASE WHEN NOT bit5 THEN 'Policy: inception date — ' || coalesce('Inception date ' || CAST(f_date AS STRING) || ' falls outside the active date window on every remaining candidate rate row.',
    'Inception date is blank/unparseable on this policy, and no remaining candidate rate row has an open (blank) date window.') END,
  CASE WHEN NOT bit4 THEN 'Policy: vehicle make / model — Vehicle make/model ''' || f_make || CASE WHEN len(makes) = 0 THEN ''' did not share at least 2 words with any MakeModelMaster cluster entry — add it to MakeModelMaster or check the MIS value.'
    ELSE ''' resolved to master group(s) [' || array_to_string(makes[1:5], ', ') || '], but no remaining candidate rate row lists that group in its vehicle-make cluster.' END END,
  CASE WHEN NOT bit3 THEN 'Policy: rto no — ' || CASE WHEN f_rto = '' THEN 'RTO is blank on this policy, and no remaining candidate rate row allows a blank RTO cluster.'
    ELSE 'RTO ''' || rto || ''' (normalized to ''' || upper(f_rto) || ''')' || CASE WHEN len(rtos) = 0 THEN ' was not found in any RTOMaster cluster — add it to RTOMaster or check the MIS value.'
      ELSE ' resolved to master group(s) [' || array_to_string(rtos[1:5], ', ') || '], but no remaining candidate rate row lists that group in its RTO cluster.' END END END,
  CASE WHEN NOT bit2 THEN 'Policy: no claim bonus — NCB value ' || coalesce(CAST(f_ncb AS STRING), 'nan') || ' doesn''t satisfy the YES/NO/NA requirement on any remaining candidate rate row.' END,
  CASE WHEN NOT bit1 THEN 'Policy: cpa — CPA value ' || coalesce(CAST(f_cpa AS STRING), 'nan') || ' doesn''t satisfy the YES/NO/NA requirement on any remaining candidate rate row.' END,
  CASE WHEN NOT bit0 THEN 'Policy: nil dep — Nil Dep value ''' || f_zd || ''' doesn''t satisfy the YES/NO/NA requirement on any remaining candidate rate row.' END]"""
_BITS = ", ".join(f"(best.mask >> {i}) & 1 = 1 AS bit{i}" for i in range(14))
_MAPPED = _DECIDED + f""", {_VALIDATION.replace('{source}', 'cell')}, judged AS (
  SELECT f.*, best.mask, {_BITS}, found.groups, found.row_total, found.payouts, found.low_key, validated.problem,
    CASE WHEN sub_product IN ('1+3', '1+5') THEN 'Policy: inception date' ELSE 'Policy: date of registration' END AS age_label
  FROM feature f LEFT JOIN best USING (row_id) LEFT JOIN found USING (row_id) LEFT JOIN validated USING (row_id)
), spoken AS (
  SELECT *, CASE WHEN mask IS NULL THEN ['Policy: insurance company — Insurer ''' || coalesce(insurer, '(blank)') || ''' did not fuzzy-match any active Rate Master insurer (threshold=55). '
      || 'Either no active rate is configured for this insurer, or the name on file differs too much to match.']
    ELSE list_filter({_DETAILS}, lambda x: x IS NOT NULL) END AS failed,
    list_filter([CASE WHEN f_combined THEN 'Policy: cc cubic capacity value ''' || cc || ''' looks like a combined CC/GVW figure (two numbers separated by ''/''). Not auto-parsed — correct the source MIS data and re-run mapping for this row.' END,
      problem], lambda x: x IS NOT NULL) AS errors
  FROM judged
), keys AS (
  SELECT row_id, array_to_string(list_sort(list(DISTINCT group_key))[1:10], ', ') AS ids FROM hit GROUP BY 1
), result AS (
  SELECT row_id, CASE WHEN len(errors) > 0 THEN 'FAILED - BAD DATA' WHEN groups = 1 OR payouts = 1 THEN '✅ MATCH' WHEN groups > 1 THEN '⚠️ MULTIPLE MATCHES' ELSE '❌ NO MATCH' END AS mapping_status,
    CASE WHEN len(errors) > 0 THEN array_to_string(list_concat(errors, list_transform(failed, lambda x: 'Also failed on: ' || x)), ' | ')
      WHEN groups = 1 THEN 'Matched Successfully'
      WHEN payouts = 1 THEN 'Matched Successfully — ' || CAST(groups AS STRING) || ' Rate Master groups matched with identical payout and payin rates; used Group ' || CAST(low_key AS STRING) || ' (lowest Group ID).'
      WHEN groups > 1 THEN 'Multiple Rate Master groups matched (' || CAST(groups AS STRING) || ' groups, ' || CAST(row_total AS STRING) || ' rows total). Please refine Rate Master so only one group applies. Matching Group IDs: '
        || ids || CASE WHEN groups > 10 THEN ' … (+' || CAST(groups - 10 AS STRING) || ' more)' ELSE '' END
      ELSE 'Failed on: ' || array_to_string(failed, ' | Also failed on: ') END AS failure_reason,
    CASE WHEN len(errors) = 0 AND (groups = 1 OR payouts = 1) THEN low_key END AS display_group_id, groups, f_combined
  FROM spoken LEFT JOIN keys USING (row_id)
)
"""


@query("motor_mapping", _MAPPED + f"""
SELECT result.row_id, mapping_status, failure_reason, display_group_id, CASE WHEN display_group_id IS NOT NULL THEN {_SIDE.format(s='po')} END AS po_rate,
  CASE WHEN display_group_id IS NOT NULL THEN {_SIDE.format(s='pi')} END AS pi_rate, CASE WHEN display_group_id IS NOT NULL THEN po_type END AS po_type
FROM result LEFT JOIN used USING (row_id)""")
def motor_mapping(s: Source) -> DataFrame:
    return motor_results(s).select("row_id", "mapping_status", "failure_reason", "display_group_id", "po_rate", "pi_rate", "po_type")


def mapped_policies(s: Source, all_ids: bool = False) -> DataFrame:
    """The whole mapped file of the ``mis`` view: motor, health and unroutable policies, with amounts."""
    return M.map_policies(s.mis, S.motor_rate_rows(s.rate_card), S.health_rate_rows(s.health_card), rto_master(s), make_master(s), pin_master(s), RUN_YEAR, all_ids)


_ROUTED = "CASE lower(trim(coalesce(product, ''))) WHEN 'motor' THEN 'motor' WHEN 'health' THEN 'health' ELSE 'none' END"


@query("product_routing", f"SELECT row_id, {_ROUTED} AS route FROM mis")
def product_routing(s: Source) -> DataFrame:
    return s.mis.select("row_id", M.route().alias("route"))


@query("unroutable_results", """SELECT row_id, '❌ NO MATCH' AS mapping_status, 'Failed on: Product — Product ''' || coalesce(product, '(blank)') || ''' is neither ''motor'' nor ''health'', so no '
  || 'Rate Master applies and the row was not matched. Correct the Product column and re-run mapping for this row.' AS failure_reason
FROM mis WHERE lower(trim(coalesce(product, ''))) NOT IN ('motor', 'health')""")
def unroutable_results(s: Source) -> DataFrame:
    return M.unroutable(s.mis.where(M.route() == "none")).select("row_id", "mapping_status", "failure_reason")


_BASE = f"""CASE WHEN policy_category = 'Private Car' AND lower(sub_product) IN ('1+1', '1+3', 'saod') THEN {_amount('total_od')}
  ELSE {_amount('gwp_net')} END"""


@query("base_premium", f"""
SELECT row_id, {_BASE} AS general, CASE WHEN policy_category = 'Private Car' AND lower(sub_product) IN ('1+1', '1+3', 'saod') THEN {_amount('total_od')}
  ELSE {_amount('gwp_net')} - {_amount('tp_terrorism')} END AS non_motor FROM mis""")
def base_premium(s: Source) -> DataFrame:
    from ratecraft.operators.amounts import base_premium as premium

    cells = [F.col(c) for c in ("policy_category", "sub_product", "total_od", "gwp_net", "tp_terrorism")]
    return s.mis.select("row_id", premium(F.lit("motor"), *cells).alias("general"), premium(F.lit("Non_Motor"), *cells).alias("non_motor"))


# ---- the whole file: motor, health and unroutable policies --------------------------------------------
_LEGS = ("po_od_rate", "po_tp_rate", "pi_od_rate", "pi_tp_rate")
_OK = "CASE WHEN result.display_group_id IS NOT NULL THEN {} END"
_WHOLE = _MAPPED + f""", {Z.HEALTH}, every_result AS (
  SELECT result.row_id, mapping_status, failure_reason, result.display_group_id, {_OK.format('po_type')} AS po_type, {_OK.format('pi_type')} AS pi_type,
    {', '.join(f"{_OK.format(leg)} AS {leg}" for leg in _LEGS)}, {_OK.format(_SIDE.format(s='po'))} AS po_one, {_OK.format(_SIDE.format(s='pi'))} AS pi_one, coalesce(result.groups, 0) AS groups,
    CASE WHEN mapping_status = '⚠️ MULTIPLE MATCHES' THEN all_keys END AS all_ids, CASE WHEN mapping_status = '❌ NO MATCH' THEN failed ELSE [] END AS failed
  FROM result LEFT JOIN used USING (row_id) LEFT JOIN (SELECT row_id, failed FROM spoken) said USING (row_id)
    LEFT JOIN (SELECT row_id, list_sort(list(DISTINCT group_key)) AS all_keys FROM hit GROUP BY 1) every_key USING (row_id)
  UNION ALL
  SELECT row_id, mapping_status, failure_reason, display_group_id, CASE WHEN display_group_id IS NOT NULL THEN 'ON Net 1 Year' END, CASE WHEN display_group_id IS NOT NULL THEN 'ON Net 1 Year' END,
    NULL, NULL, NULL, NULL, po_rate, pi_rate, groups, CASE WHEN mapping_status = '⚠️ MULTIPLE MATCHES' THEN all_ids END, CASE WHEN mapping_status = '❌ NO MATCH' THEN failed ELSE [] END FROM health_result
  UNION ALL
  SELECT row_id, '❌ NO MATCH', 'Failed on: ' || said, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, [said] FROM (
    SELECT row_id, 'Product — Product ''' || coalesce(product, '(blank)') || ''' is neither ''motor'' nor ''health'', so no Rate Master applies and the row was not matched. '
      || 'Correct the Product column and re-run mapping for this row.' AS said FROM mis WHERE lower(trim(coalesce(product, ''))) NOT IN ('motor', 'health')) unrouted
), every_row AS (
  SELECT every_result.*, mis.* EXCLUDE (row_id), CASE WHEN lower(trim(product)) = 'motor' AND pi_type = 'On OD' THEN {_amount('total_od')} WHEN lower(trim(product)) = 'motor' AND pi_type = 'On TP' THEN {_amount('tp_premium')}
    WHEN lower(trim(product)) = 'motor' AND pi_type = 'On Net' THEN {_amount('gwp_net')} ELSE {_BASE} END AS cp FROM every_result JOIN mis USING (row_id)
), every_amount AS (
  SELECT *, {', '.join(f"""CASE WHEN {side}_type = 'On OD and TP' THEN {_amount('total_od')} * (coalesce({side}_od_rate, 0) / 100) + {_amount('tp_premium')} * (coalesce({side}_tp_rate, 0) / 100)
      ELSE {side}_one / 100 * cp END AS {side}_pay, CASE WHEN {side}_type = 'On OD and TP' THEN regexp_replace(CAST({side}_od_rate AS STRING), '\\.0$', '') || '+' || regexp_replace(CAST({side}_tp_rate AS STRING), '\\.0$', '')
      ELSE CAST({side}_one AS STRING) END AS {side}_text""" for side in ("po", "pi"))} FROM every_row
)
"""


def _milli(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


@query("payout_amounts", _WHOLE + f"""
SELECT row_id, {_milli('cp')} AS cp_premium, {_milli('pi_pay')} AS pay_in, {_milli('po_pay')} AS pay_out, {_milli('pi_pay - po_pay')} AS margin, po_text AS po_rate_text FROM every_amount""")
def payout_amounts(s: Source) -> DataFrame:
    shown = {"cp_premium": "cp_premium", "pay_in_amount": "pay_in", "pay_out_amount": "pay_out", "margin_amount": "margin"}
    return mapped_policies(s).select("row_id", *[(F.floor(F.col(a) * 1000 + 0.5) / 1000).alias(b) for a, b in shown.items()], "po_rate_text")


@query("run_summary", _WHOLE + """, n AS (
SELECT count(*) AS processed, count_if(mapping_status = '✅ MATCH') AS matched, count_if(mapping_status = '✅ MATCH' AND groups > 1) AS collapsed,
  count_if(mapping_status = '⚠️ MULTIPLE MATCHES') AS multiple, count_if(mapping_status = 'FAILED - BAD DATA') AS bad_data FROM every_result)
SELECT *, 'Processed ' || processed || ' rows successfully. Mapped ' || matched || ' rates. ' || CASE WHEN collapsed > 0 THEN collapsed || ' of them matched several Rate Master groups/rows with identical payout and payin rates and used the lowest Group ID. ' ELSE '' END
  || multiple || ' rows skipped — multiple Rate Master groups matched (refine Rate Master to get a single match). ' || bad_data || ' rows flagged FAILED - BAD DATA (invalid source values — see Failure Reason).' AS sentence FROM n""")
def run_summary(s: Source) -> DataFrame:
    return M.run_summary(mapped_policies(s)).withColumn("sentence", M.summary_text())


@query("multiple_match_message", _MAPPED + "SELECT row_id, failure_reason FROM result WHERE mapping_status = '⚠️ MULTIPLE MATCHES'")
def multiple_match_message(s: Source) -> DataFrame:
    return motor_results(s).where("mapping_status = '⚠️ MULTIPLE MATCHES'").select("row_id", "failure_reason")


_STATUS_KEY = "CASE mapping_status WHEN '⚠️ MULTIPLE MATCHES' THEN 'MULTIPLE_MATCHES' WHEN '❌ NO MATCH' THEN 'NO_MATCH' ELSE 'BAD_DATA' END"


@query("failed_rows_by_status", _WHOLE + f"SELECT {_STATUS_KEY} AS status_key, count(*) AS n FROM every_result WHERE mapping_status <> '✅ MATCH' GROUP BY 1")
def failed_rows_by_status(s: Source) -> DataFrame:
    return G.status_totals(G.failed_rows(mapped_policies(s), F.col("file_id")))


@query("ambiguous_group_ids", _WHOLE + "SELECT row_id, array_to_string(all_ids, ',') AS group_ids FROM every_result WHERE mapping_status = '⚠️ MULTIPLE MATCHES'")
def ambiguous_group_ids(s: Source) -> DataFrame:
    """Every group id of an ambiguous policy as its failed row keeps them, those beyond the ten of the text too."""
    failed = G.failed_rows(mapped_policies(s, all_ids=True), F.col("file_id")).where("status_key = 'MULTIPLE_MATCHES'")
    return failed.select("row_id", F.array_join("group_ids", ",").alias("group_ids"))


@query("failed_row_sink", _WHOLE + f"""
SELECT row_id, CAST(file_id AS BIGINT) AS mis_file_id, {_STATUS_KEY} AS status_key, failure_reason, coalesce(array_to_string(all_ids, ','), '') AS group_ids
FROM every_row WHERE mapping_status <> '✅ MATCH'""")
def failed_row_sink(s: Source) -> DataFrame:
    """A processed file written as CSV and read back: its failed rows rebuilt and stored, one file's twice; each is there once."""
    raw = s.mis.select(F.col("row_id").alias(P.ROW_ID), F.col("file_id").alias("MIS File"), *[F.col(short).alias(header) for short, header in K.POLICY_FILE_COLUMNS.items()])
    folder = f"{shared_folder(s.spark)}/processed-{uuid.uuid4().hex}"
    write_csv(M.mapped_file(raw, mapped_policies(s, all_ids=True), all_ids=True), f"{folder}/file")
    processed = s.spark.read.csv(f"{folder}/file", header=True, escape='"')
    failed = stage(G.failed_from_file(processed, F.col("MIS File").cast("bigint")))
    G.write_failed_rows(failed, f"{folder}/failed")
    G.write_failed_rows(failed.where("mis_file_id = 2"), f"{folder}/failed")
    stored = s.spark.read.parquet(f"{folder}/failed")
    return stored.select("row_id", F.col("mis_file_id").cast("bigint").alias("mis_file_id"), "status_key", "failure_reason", F.array_join("group_ids", ",").alias("group_ids"))


@query("coverage_gaps", _WHOLE + """, gap AS (
  SELECT 'no_match' AS kind, trim(split_part(x, ' — ', 1)) AS rule, trim(substring(x, strpos(x, ' — ') + 3)) AS detail
  FROM (SELECT unnest(failed) AS x FROM every_result) named
), keyed AS (
  SELECT kind, rule, coalesce(nullif(trim(regexp_extract(detail, '''([^'']*)''', 1)), ''), trim(detail)) AS value, '' AS group_ids FROM gap
  UNION ALL SELECT 'multiple_matches', '', trim(split_part(failure_reason, 'Matching Group IDs: ', 2)), array_to_string(all_ids, ',') FROM every_result WHERE mapping_status = '⚠️ MULTIPLE MATCHES'
), counted AS (SELECT kind, rule, value, group_ids, count(*) AS n FROM keyed GROUP BY 1, 2, 3, 4)
SELECT kind, rule, value, group_ids, n FROM counted""")
def coverage_gaps(s: Source) -> DataFrame:
    mapped, lists = M.map_policies_apart(s.mis, S.motor_rate_rows(s.rate_card), S.health_rate_rows(s.health_card), rto_master(s), make_master(s), pin_master(s), RUN_YEAR)
    return G.coverage_gaps(mapped, lists=lists).withColumn("group_ids", F.array_join("group_ids", ","))


@query("mapped_policies", _WHOLE + f"""
SELECT row_id, mapping_status, failure_reason, display_group_id, po_text AS po_rate_text, pi_text AS pi_rate_text, {_milli('cp')} AS cp_premium, {_milli('pi_pay')} AS pay_in_amount,
  {_milli('po_pay')} AS pay_out_amount, {_milli('pi_pay - po_pay')} AS margin_amount FROM every_amount""")
def mapped_policies_query(s: Source) -> DataFrame:
    amounts = [(F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) for c in ("cp_premium", "pay_in_amount", "pay_out_amount", "margin_amount")]
    return mapped_policies(s).select("row_id", "mapping_status", "failure_reason", "display_group_id", "po_rate_text", "pi_rate_text", *amounts)


@query("health_mapping", f"WITH {Z.HEALTH} SELECT row_id, mapping_status, failure_reason, display_group_id, po_rate, pi_rate FROM health_result")
def health_mapping(s: Source) -> DataFrame:
    from ratecraft.operators.healthjoin import map_health

    health = s.mis.where(M.route() == "health")
    return map_health(health, S.health_rate_rows(s.health_card), pin_master(s), all_ids=False).select(
        "row_id", "mapping_status", "failure_reason", "display_group_id", "po_rate", "pi_rate")


# ---- resolvers ------------------------------------------------------------------------------------
@query("insurer_token_jaccard", """
WITH stop AS (SELECT unnest(['general', 'insurance', 'company', 'limited', 'ltd', 'co', 'the', 'of', 'and', 'an', 'a', 'in']) AS w),
src AS (SELECT source, unnest(string_split(regexp_replace(source, '[^a-z0-9 ]', ' ', 'g'), ' ')) AS w FROM (SELECT DISTINCT lower(insurer) AS source FROM mis WHERE insurer IS NOT NULL) s),
tgt AS (SELECT target, unnest(string_split(target, ' ')) AS w FROM (SELECT DISTINCT lower(insurance_company) AS target FROM rate_card) t),
s AS (SELECT DISTINCT source, w FROM src WHERE w <> '' AND w NOT IN (SELECT w FROM stop)), t AS (SELECT DISTINCT target, w FROM tgt WHERE w NOT IN (SELECT w FROM stop)),
sn AS (SELECT source, count(*) AS n FROM s GROUP BY 1), tn AS (SELECT target, count(*) AS n FROM t GROUP BY 1),
pairs AS (SELECT source, target, count(*) AS c FROM s JOIN t USING (w) GROUP BY 1, 2)
SELECT source, target, c / (sn.n + tn.n - c) AS jaccard FROM pairs JOIN sn USING (source) JOIN tn USING (target)""")
def insurer_token_jaccard(s: Source) -> DataFrame:
    return R.insurer_pairs(s.mis.select(F.col("insurer").alias("name")), s.rate_card.select(F.col("insurance_company").alias("name")))


@query("insurer_fuzzy_join", """SELECT DISTINCT lower(insurer) AS source, 'supplier ' || lpad(CAST(insurer_no AS STRING), 2, '0') || ' general insurance co ltd' AS insurer
FROM mis WHERE insurer IS NOT NULL AND insurer_no < 10""")
def insurer_fuzzy_join(s: Source) -> DataFrame:
    names = R.resolve_insurers(s.mis.select(F.col("insurer").alias("name")), s.rate_card.select(F.col("insurance_company").alias("name")))
    return names.select("source", "insurer")


@query("rto_cluster_resolve", "SELECT DISTINCT upper(clean_rto) AS term, name FROM mis JOIN rto_items ON item = upper(clean_rto) WHERE rto IS NOT NULL")
def rto_cluster_resolve(s: Source) -> DataFrame:
    return R.resolve_codes(s.mis.select(T.normalize_rto_code("rto").alias("term")), rto_master(s))


@query("model_word_overlap", _FEATURES + "SELECT upper(f_make) AS term, unnest(makes) AS name FROM make_name")
def model_word_overlap(s: Source) -> DataFrame:
    motor = s.mis.where(M.route() == "motor")
    return R.resolve_models(P.motor_features(motor, RUN_YEAR).select(F.col("make_model").alias("term")), make_master(s))


@query("pincode_zone_resolve", "SELECT DISTINCT regexp_replace(pin_code, '\\.0$', '') AS term, name FROM mis JOIN pin_items ON item = regexp_replace(pin_code, '\\.0$', '')")
def pincode_zone_resolve(s: Source) -> DataFrame:
    return R.resolve_codes(s.mis.select(T.normalize_pincode("pin_code").alias("term")), pin_master(s))


@query("resolved_name_membership", """
WITH t AS (SELECT DISTINCT name FROM make_items WHERE item LIKE '%ring%')
SELECT id FROM rate_card WHERE list_has_any(string_split(new_vehicle_makes, ', '), (SELECT list(name) FROM t))""")
def resolved_name_membership(s: Source) -> DataFrame:
    from ratecraft.operators.search import listed_by

    terms = s.part.where("p_name LIKE '% ring'").select(F.col("p_name").alias("term"))
    return listed_by(s.rate_card, "new_vehicle_makes", "ring", R.resolve_models(terms, make_master(s)).select("name"), "none").select("id")


@query("spelling_expansion_lookup", """
WITH own AS (SELECT DISTINCT value AS term, mapping_id FROM spelling), linked AS (SELECT DISTINCT o.term, s.value FROM own o JOIN spelling s USING (mapping_id))
SELECT DISTINCT term, name FROM linked JOIN make_items ON upper(item) = value OR upper(item) LIKE value || ' %'""")
def spelling_expansion_lookup(s: Source) -> DataFrame:
    return R.resolve_search_terms(s.part.select(F.col("p_name").alias("term")), s.spelling, make_master(s))


@query("plan_name_fuzzy_join", f"""
WITH plans AS (SELECT DISTINCT plan_name AS a FROM mis WHERE plan_name <> ''), lists AS (SELECT DISTINCT plan_names AS b FROM health_card WHERE plan_names <> ''),
pairs AS (SELECT a, b, {Z.plan_key('a')} AS a_key, {Z.plan_key('item')} AS b_key FROM plans, (SELECT b, unnest(string_split(b, ',')) AS item FROM lists) items)
SELECT DISTINCT a, b FROM pairs WHERE a_key <> '' AND {Z.ratio('a_key', 'b_key')} >= 80""")
def plan_name_fuzzy_join(s: Source) -> DataFrame:
    one = F.lit("all").alias("block")
    plans = s.mis.select(one, F.col("plan_name").alias("a")).where("a <> ''").distinct()
    lists = s.health_card.select(one, F.col("plan_names").alias("b")).where("b <> ''").distinct()
    return R.fuzzy_plan_pairs(plans, lists, "block").select("a", "b")


@query("fuzzy_category_pairs", f"""
SELECT a, b FROM (SELECT DISTINCT lower(product_name) AS a FROM mis WHERE product_name <> '') x, (SELECT DISTINCT lower(product_name) AS b FROM health_card WHERE product_name <> '') y WHERE {Z.alike('a', 'b')}""")
def fuzzy_category_pairs(s: Source) -> DataFrame:
    one = F.lit("all").alias("block")
    left = s.mis.select(one, F.lower("product_name").alias("a")).where("a <> ''").distinct()
    right = s.health_card.select(one, F.lower("product_name").alias("b")).where("b <> ''").distinct()
    return R.fuzzy_category_pairs(left, right, "block").select("a", "b")


@query("spelling_suggestions", f"""
WITH pairs AS (SELECT value, item, trim(regexp_replace(lower(value), '[^a-z0-9]', ' ', 'g')) AS a, trim(regexp_replace(lower(item), '[^a-z0-9]', ' ', 'g')) AS b
  FROM (SELECT DISTINCT upper(p_name) AS value FROM {{part}}) v, (SELECT DISTINCT upper(item) AS item FROM make_items) i WHERE value <> item),
scores AS ({Z.scored('pairs', 'a', 'b')})
SELECT value, item, by_set AS score, by_sort AS tie FROM scores WHERE by_set >= 90 AND len(w2) >= 2""")
def spelling_suggestions(s: Source) -> DataFrame:
    return R.suggest_spellings(s.part.select(F.upper("p_name").alias("value")).distinct(), make_master(s))


@query("cluster_item_index", "SELECT upper(item) AS item, string_agg(name, ',' ORDER BY name) AS groups FROM make_items GROUP BY 1")
def cluster_item_index(s: Source) -> DataFrame:
    return R.item_index(make_master(s)).select("item", F.array_join("groups", ",").alias("groups"))


@query("mapped_to_lookup", "SELECT DISTINCT upper(p_name) AS value, mapping_id, mapping_name FROM {part} LEFT JOIN spelling ON value = upper(p_name)")
def mapped_to_lookup(s: Source) -> DataFrame:
    return R.with_mapping(s.part.select(F.col("p_name").alias("value")), s.spelling)


@query("configured_rule_join", """
WITH p AS (SELECT row_id, insurer_no, lower(trim(coalesce(vehproduct, ''))) AS product, TRY_CAST(regexp_replace(cc, '[^0-9.]', '', 'g') AS DOUBLE) AS cc_value,
  CASE WHEN inception <> '' THEN inception_date END AS day, CAST(seating AS DOUBLE) AS seats, clean_model, lower(trim(coalesce(sub_product, ''))) AS sub, CAST(custkey % 12 AS DOUBLE) AS years FROM mis WHERE insurer IS NOT NULL AND insurer_no < 10),
r AS (SELECT *, g % 10 AS no FROM rate_card WHERE status = 'ACTIVE' AND is_deleted = 'NO'),
t AS (SELECT row_id, max(64 * CAST(r.product = '' OR lower(r.product) = p.product AS INTEGER)
  + 32 * CAST(CASE WHEN cc_value IS NULL THEN cc_min IS NULL AND cc_max IS NULL ELSE coalesce(cc_min <= cc_value, true) AND coalesce(cc_max >= cc_value, true) END AS INTEGER)
  + 16 * CAST(len(list_intersect(string_split(upper(clean_model), ' '), string_split(upper(model_name), ' '))) >= 2 AS INTEGER)
  + 8 * CAST(CASE WHEN day IS NULL THEN from_date IS NULL AND to_date IS NULL ELSE coalesce(from_date <= day, true) AND coalesce(to_date >= day, true) END AS INTEGER)
  + 4 * CAST(r.sub_product = '' OR (p.sub <> '' AND (contains(lower(r.sub_product), p.sub) OR contains(p.sub, lower(r.sub_product)))) AS INTEGER)
  + 2 * CAST(coalesce(vehicle_age_min < years, true) AND coalesce(vehicle_age_max >= years, true) AS INTEGER)
  + CAST(coalesce(sc_min <= seats, true) AND coalesce(sc_max >= seats, true) AS INTEGER)) AS mask FROM p JOIN r ON r.no = p.insurer_no GROUP BY 1)
SELECT row_id, CAST(mask AS BIGINT) AS mask, CAST(7 - bit_count(mask) AS INTEGER) AS failed FROM t""")
def configured_rule_join(s: Source) -> DataFrame:
    """A table of rules with every operator, one of them switched off."""
    specs = [
        {"source": "vehproduct", "operator": "EXACT", "target": "product", "order": 1, "active": True},
        {"source": "fuel", "operator": "EXACT", "target": "fuel_type", "order": 2, "active": False},
        {"source": "cc_value", "operator": "RANGE_CC", "target": "cc", "order": 3, "active": True},
        {"source": "clean_model", "operator": "WORD_MATCH", "target": "model_name", "order": 4, "active": True},
        {"source": "day", "operator": "RANGE_DATE", "target": "validity", "order": 5, "active": True},
        {"source": "sub_product", "operator": "CONTAINS", "target": "sub_product", "order": 6, "active": True},
        {"source": "years", "operator": "RANGE_AGE", "target": "vehicle_age", "order": 7, "active": True},
        {"source": "seats", "operator": "RANGE_SC", "target": "sc", "order": 8, "active": True},
    ]
    from ratecraft.functions import dates as D, numbers as N

    policies = s.mis.where("insurer IS NOT NULL AND insurer_no < 10").select(
        "row_id", F.col("insurer_no").alias("insurer"), "vehproduct", "clean_model", "sub_product", N.digits_number("cc").alias("cc_value"), D.policy_date("inception").alias("day"),
        (F.col("custkey") % 12).cast("double").alias("years"), N.digits_number("seating").alias("seats"))
    live = s.rate_card.where("status = 'ACTIVE' AND is_deleted = 'NO'")
    number = F.substring("insurance_company", 10, 2).cast("bigint")
    targets = ["cc_min", "cc_max", "model_name", "from_date", "to_date", "sub_product", "vehicle_age_min", "vehicle_age_max", "sc_min", "sc_max"]
    rates = live.select(number.alias("r_insurer"), *[F.col(c).alias(f"r_{c}") for c in ("product", *targets)])
    joined = J.configured_join(stage(policies), rates, J.configured_rules(specs), "insurer", "row_id").where("mask IS NOT NULL")
    return joined.select("row_id", "mask", F.size("failed").alias("failed"))


@query("result_join_defaults", """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '✅ MATCH' ELSE '❌ NO MATCH' END AS mapping_status, CASE WHEN row_id % 3 = 0 THEN ncb END AS po_rate FROM policy""")
def result_join_defaults(s: Source) -> DataFrame:
    """Policies without a result row are NO MATCH, with no payout."""
    results = s.policy.where("row_id % 3 = 0").select("row_id", F.lit("✅ MATCH").alias("mapping_status"), F.col("ncb").alias("po_rate"))
    return M.with_results(s.policy.select("row_id"), results)
