"""Column functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from catalog.bridge import RUN_YEAR
from catalog.registry import Source, query
from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, documents as J, life as L, numbers as N, rates as R, reasons as E, text as T
from ratecraft.operators import maintain as M
from ratecraft.operators.life import has_overflow
from ratecraft.sources import policies as P


def project(name: str, view: str, columns: Callable[[], dict[str, Column]], sql: str, key: str = "row_id") -> None:
    """A query of one key and some expressions over a view; ``sql`` is the select list of its oracle."""
    @query(name, f"SELECT {key}, {sql} FROM {view}")
    def build(s: Source) -> DataFrame:
        return getattr(s, view).select(key, *[c.alias(n) for n, c in columns().items()])


def _clean(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'null', 'nul', 'nill', 'na') THEN 0.0 "
            f"ELSE TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE) END")


def _digits(c: str) -> str:
    return f"TRY_CAST(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE)"


_AMOUNTS = ["total_od", "tp_premium", "gwp_net", "tp_terrorism"]
project("clean_cp_numeric", "mis", lambda: {f"n_{c}": N.clean_amount(c) for c in _AMOUNTS},
        ", ".join(f"{_clean(c)} AS n_{c}" for c in _AMOUNTS))
_DIGITS = ["cc", "seating", "tariff", "age", "deductible", "sum_assured"]
project("digits_only_parse", "mis", lambda: {f"n_{c}": N.digits_number(c) for c in _DIGITS},
        ", ".join(f"{_digits(c)} AS n_{c}" for c in _DIGITS))
project("combined_cc_gvw_flag", "mis", lambda: {"combined": T.is_combined_cc_gvw("cc")},
        "coalesce(regexp_matches(cc, '[0-9]+\\s*/\\s*[0-9]+'), false) AS combined")


@query("cc_or_gvw_source", """
SELECT row_id, CASE WHEN row_id % 3 < 2 THEN trim(gvw) ELSE trim(cc) END AS cc_raw,
  CASE WHEN row_id % 3 < 2 THEN 'Policy: gvw gross vehicle weight' ELSE 'Policy: cc cubic capacity' END AS cc_label FROM mis""")
def cc_or_gvw_source(s: Source) -> DataFrame:
    weighed = F.when(F.col("row_id") % 3 == 0, F.lit("GCV 3W")).when(F.col("row_id") % 3 == 1, F.lit(" gcv 4w")).otherwise(F.col("vehproduct"))
    return P.motor_features(s.mis.withColumn("vehproduct", weighed), RUN_YEAR).select("row_id", "cc_raw", "cc_label")


def _year(c: str) -> str:
    return (f"CAST(list_filter(regexp_extract_all({c}, '[0-9]+'), lambda y: length(y) = 4 AND y >= '1900' AND y <= '2099')[1] AS INTEGER)")


project("extract_year", "mis", lambda: {"reg_year": D.extract_year("registration"), "inc_year": D.extract_year("inception")},
        f"{_year('registration')} AS reg_year, {_year('inception')} AS inc_year")
_AGE = f"""CAST({RUN_YEAR + 1} - CASE WHEN lower(trim(sub_product)) IN ('1+3', '1+5') THEN {_year('inception')} ELSE {_year('registration')} END AS DOUBLE)"""
project("vehicle_age", "mis", lambda: {"vehicle_age": D.vehicle_age(
    F.col("registration"), F.col("inception"), T.norm_text("sub_product").isin(*K.NEW_VEHICLE_SUB_PRODUCTS), RUN_YEAR)},
    f"{_AGE} AS vehicle_age")
project("normalize_rto_code", "mis", lambda: {"code": T.normalize_rto_code("rto")},
        "coalesce(substring(regexp_replace(trim(rto), '[\\s\\-]', '', 'g'), 1, 4), '') AS code")
project("normalize_pincode", "mis", lambda: {"pincode": T.normalize_pincode("pin_code")},
        "regexp_replace(trim(pin_code), '\\.0$', '') AS pincode")
project("plan_name_normaliser", "mis", lambda: {"plan": T.normalize_plan_name("plan_name")},
        "trim(regexp_replace(regexp_replace(replace(lower(trim(plan_name)), '+', ' plus'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plan")
project("business_type_synonyms", "mis", lambda: {"business_type": T.fold_business_type("policy_type")},
        """CASE WHEN trim(regexp_replace(lower(policy_type), '[\\s_\\-]+', ' ', 'g')) IN ('rollover', 'roll over', 'portability', 'port')
           THEN 'port' ELSE trim(regexp_replace(lower(policy_type), '[\\s_\\-]+', ' ', 'g')) END AS business_type""")
project("model_word_tokeniser", "mis", lambda: {"words": F.array_join(F.array_sort(T.model_words(F.concat_ws(" ", "make", "model"))), "|")},
        """array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(replace(upper(concat_ws(' ', make, model)), '-', ' '),
           '([A-Z])([0-9])', '\\1 \\2', 'g'), ' '), lambda w: w <> ''))), '|') AS words""")
project("insurer_key_tokens", "mis", lambda: {"tokens": F.array_join(F.array_sort(T.insurer_key_tokens("insurer")), "|")},
        """array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(insurer, '')), '[^a-z0-9\\s]', ' ', 'g'), ' '),
           lambda w: w <> '' AND w NOT IN ('general', 'insurance', 'company', 'limited', 'ltd', 'co', 'the', 'of', 'and', 'an', 'a', 'in')))), '|') AS tokens""")


def _side(side: str) -> list[Column]:
    return [F.col(f"{side}_{f}") for f in ("type", "od_rate", "tp_rate", "net_rate")]


def _consolidated(s: str) -> str:
    return (f"CASE {s}_type WHEN 'On OD and TP' THEN coalesce({s}_od_rate, 0) + coalesce({s}_tp_rate, 0) WHEN 'On TP' THEN {s}_tp_rate "
            f"WHEN 'On OD' THEN {s}_od_rate WHEN 'On Net' THEN {s}_net_rate ELSE coalesce(nullif({s}_net_rate, 0), nullif({s}_od_rate, 0), nullif({s}_tp_rate, 0)) END")


def _positive(s: str) -> str:
    return f"CASE WHEN {s}_net_rate > 0 THEN {s}_net_rate WHEN {s}_od_rate > 0 THEN {s}_od_rate WHEN {s}_tp_rate > 0 THEN {s}_tp_rate ELSE 0.0 END"


def _trimmed(x: str) -> str:
    return f"regexp_replace(CAST(coalesce({x}, 0.0) AS STRING), '\\.0$', '')"


# One type in five blanked, so the fallback order shows.
_CARD = "(SELECT * REPLACE (CASE WHEN g % 5 = 0 THEN NULL ELSE po_type END AS po_type) FROM rate_card)"


def rated(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    @query(name, f"SELECT id, {sql} FROM {_CARD} card")
    def build(s: Source) -> DataFrame:
        card = s.rate_card.withColumn("po_type", F.when(F.col("g") % 5 != 0, F.col("po_type")))
        return card.select("id", *[c.alias(n) for n, c in columns().items()])


rated("consolidated_rate", lambda: {f"{s}_rate": R.consolidated_rate(*_side(s)) for s in ("po", "pi")},
      ", ".join(f"{_consolidated(s)} AS {s}_rate" for s in ("po", "pi")))
rated("effective_rate", lambda: {"effective": R.effective_rate(*_side("po"))},
      f"CASE WHEN po_type = 'On OD and TP' THEN coalesce(po_od_rate, 0) + coalesce(po_tp_rate, 0) ELSE {_positive('po')} END AS effective")
rated("search_display_rate", lambda: {f"{s}_rate": R.search_rate_text(*_side(s)) for s in ("po", "pi")},
      ", ".join(f"CASE WHEN {s}_type = 'On OD and TP' THEN printf('%.2f', coalesce({s}_od_rate, 0)) || '+' || printf('%.2f', coalesce({s}_tp_rate, 0)) "
                f"ELSE CAST({_positive(s)} AS STRING) END AS {s}_rate" for s in ("po", "pi")))
rated("od_tp_display", lambda: {"shown": R.split_rate_text(F.col("po_od_rate"), F.col("po_tp_rate"))},
      f"{_trimmed('po_od_rate')} || '+' || {_trimmed('po_tp_rate')} AS shown")


def _sign(s: str) -> str:
    return (f"coalesce({s}_type, '-') || '|' || coalesce(CAST(round({_consolidated(s)}, 6) AS STRING), '-') || '|' || CASE WHEN {s}_type = 'On OD and TP' "
            f"THEN CAST(coalesce({s}_od_rate, 0) AS STRING) || '+' || CAST(coalesce({s}_tp_rate, 0) AS STRING) ELSE '' END")


rated("payout_signature", lambda: {"signature": R.payout_signature()}, f"{_sign('po')} || '|' || {_sign('pi')} AS signature")
project("amount_text", "policy", lambda: {"shown": N.amount_text("total_od")},
        "regexp_replace(regexp_replace(format('{{:,.2f}}', total_od), '0+$', ''), '\\.$', '') AS shown")
project("health_tenure", "mis", lambda: {"years": D.tenure_years(D.policy_date("inception"), D.policy_date("expiry"))},
        """CASE WHEN inception <> '' AND CAST(try_strptime(expiry, '%d/%m/%Y') AS DATE) - inception_date > 0
           THEN CAST(round_even((CAST(try_strptime(expiry, '%d/%m/%Y') AS DATE) - inception_date) / 365.25, 0) AS INTEGER) END AS years""")
project("safe_decimal", "mis", lambda: {f"d_{c}": N.safe_decimal(c) for c in ("total_od", "tp_premium")},
        ", ".join(f"TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DECIMAL(12, 2)) AS d_{c}" for c in ("total_od", "tp_premium")))
project("policy_date_formats", "mis", lambda: {"policy": D.policy_date("inception"), "upload": D.upload_date("inception"), "grid": D.grid_date("inception")},
        """CASE WHEN inception <> '' THEN inception_date END AS policy,
           CASE WHEN row_id % 3 = 1 AND inception <> '' THEN inception_date END AS upload,
           CASE WHEN row_id % 3 > 0 AND inception <> '' THEN inception_date END AS grid""")
project("document_date_formats", "cells", lambda: {"day": D.document_date("written_date")}, "day", key="id")


@query("tolerant_json", """
WITH cleaned AS (SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(answer, '^```json\\s*', ''), '^```\\s*', ''), '\\s*```$', '')),
  ',\\s*([}}\\]])', '\\1', 'g') AS doc FROM extracted)
SELECT id, doc ->> '$.policy_number' AS policy_number, doc ->> '$.insured_name' AS insured_name, doc ->> '$.net_premium' AS net_premium,
  doc ->> '$.insurance_company' AS company FROM cleaned""")
def tolerant_json(s: Source) -> DataFrame:
    fields = J.json_fields("answer")
    return s.extracted.select("id", fields["policy_number"].alias("policy_number"), fields["insured_name"].alias("insured_name"),
                              fields["net_premium"].alias("net_premium"), fields["insurance_company"].alias("company"))


project("parse_number_percent", "cells", lambda: {"number": N.parse_number("cell"), "percent": N.parse_percent("cell"), "amount_percent": N.parse_percent("amount")},
        """CASE WHEN regexp_full_match(trim(cell), '-+') THEN 0.0 ELSE TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE) END AS number,
           TRY_CAST(trim(rtrim(trim(cell), '%')) AS DOUBLE) AS percent, TRY_CAST(rtrim(amount, '%') AS DOUBLE) AS amount_percent""", key="id")
project("yes_no_na_parser", "mis", lambda: {"code": T.parse_yes_no_na("nil_dep")},
        "CASE WHEN lower(nil_dep) IN ('yes', 'y', 'true', '1') THEN 'YES' WHEN lower(nil_dep) IN ('no', 'n', 'false', '0') THEN 'NO' ELSE 'NA' END AS code")
project("nil_dep_class", "mis", lambda: {"zd": T.nil_dep_class("nil_dep")},
        "CASE WHEN upper(nil_dep) IN ('1', 'YES', 'Y', 'TRUE') THEN 'YES' WHEN upper(nil_dep) IN ('0', 'NO', 'N', 'FALSE') THEN 'NO' END AS zd")
project("text_normalisers", "mis", lambda: {"product_text": T.norm_text("vehproduct"), "code": T.norm_code("fuel"), "squashed": T.squash_whitespace(F.concat("insurer", F.lit("  x \n y ")))},
        """lower(trim(coalesce(vehproduct, ''))) AS product_text, CASE WHEN coalesce(fuel, '') = '' THEN 'NA' ELSE upper(fuel) END AS code,
           CASE WHEN insurer IS NULL THEN '' ELSE trim(insurer) || ' x y' END AS squashed""")
project("cluster_split", "rate_card", lambda: {"makes": F.array_join(C.cluster_items("new_vehicle_makes"), "|"), "n": F.size(C.cluster_items("new_vehicle_makes"))},
        "array_to_string(list_sort(list_distinct(string_split(lower(new_vehicle_makes), ', '))), '|') AS makes, CAST(len(list_distinct(string_split(lower(new_vehicle_makes), ', '))) AS INTEGER) AS n", key="id")
project("cluster_join", "rate_card", lambda: {"joined": C.unique_join(F.concat(
    C.split_list("new_vehicle_makes"), F.array(F.upper("new_rto_list"), F.lit(" "), F.col("new_rto_list"), F.lit("MK_RING"))))},
    """new_vehicle_makes || ', ' || upper(new_rto_list) || CASE WHEN list_contains(string_split(new_vehicle_makes, ', '), 'mk_ring') THEN '' ELSE ', MK_RING' END AS joined""", key="id")


@query("cluster_preview", """
WITH lists AS (SELECT o_custkey AS custkey, list_sort(list('order_' || CAST(o_orderkey AS STRING))) AS l FROM {orders} GROUP BY 1),
shown AS (SELECT custkey, l, len(list_filter(range(1, least(len(l), 8) + 1),
  lambda i: i = 1 OR list_sum(list_transform(l[1:i], lambda x: length(x) + 2)) <= 80)) AS n FROM lists)
SELECT custkey, array_to_string(l[1:n], ', ') || CASE WHEN len(l) > n THEN ' +' || CAST(len(l) - n AS STRING) || ' more' ELSE '' END AS preview FROM shown""")
def cluster_preview(s: Source) -> DataFrame:
    items = F.collect_list(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")))
    return s.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(items.alias("items")).select("custkey", C.cluster_preview(F.col("items")).alias("preview"))


@query("failure_text_split", """
WITH part AS (SELECT id, unnest(string_split(reason, ' | Also failed on: ')) AS part, generate_subscripts(string_split(reason, ' | Also failed on: '), 1) AS n
  FROM reason WHERE reason LIKE 'Failed on:%')
SELECT id, CAST(n AS BIGINT) AS place, trim(split_part(replace(part, 'Failed on: ', ''), '—', 1)) AS label,
  trim(substring(part, strpos(part, '—') + 1)) AS detail FROM part""")
def failure_text_split(s: Source) -> DataFrame:
    pairs = s.reason.select("id", F.posexplode(E.split_failed_on("reason")).alias("n", "pair"))
    return pairs.select("id", (F.col("n") + 1).cast("bigint").alias("place"), "pair.label", "pair.detail")


@query("failure_text_compose", "SELECT id, reason FROM reason WHERE reason LIKE 'Failed on:%'")
def failure_text_compose(s: Source) -> DataFrame:
    """Split texts put together again are the stored texts."""
    pairs = E.split_failed_on("reason")
    again = E.failed_on(F.transform(pairs, lambda p: E.segment(p["label"], p["detail"])))
    return s.reason.where(F.size(pairs) > 0).select("id", again.alias("reason"))


_QUOTED = "nullif(trim(regexp_extract(reason, '''([^'']*)''', 1)), '')"
project("gap_key", "reason", lambda: {"gap": E.gap_key("reason"), "shown": E.shown_gap("reason")},
        f"coalesce({_QUOTED}, trim(reason)) AS gap, coalesce({_QUOTED}, trim(substring(reason, 1, {K.GAP_SHOWN_CHARS}))) AS shown", key="id")
project("group_ids_in_reason", "reason", lambda: {"ids": F.array_join(E.group_ids("reason").cast("array<string>"), "|")},
        """CASE WHEN reason LIKE '%Matching Group IDs:%' THEN array_to_string(regexp_extract_all(split_part(split_part(reason, 'Group IDs:', 2), '…', 1),
           '[0-9]+'), '|') ELSE '' END AS ids""", key="id")
project("unresolved_make_value", "reason", lambda: {"value": E.unresolved_make_value("reason")},
        "CASE WHEN reason LIKE 'Failed on: Policy: vehicle make / model —%' THEN make_model END AS value", key="id")
_CLASSES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PRODUCT_CLASSES.items())
project("product_class_translation", "cells", lambda: {"shown": T.display_class("vehicle_class", "product")},
        f"CASE WHEN coalesce(vehicle_class, 'NA') IN ('NA', '') THEN coalesce(CASE upper(trim(product)) {_CLASSES} END, 'NA') ELSE vehicle_class END AS shown", key="id")
project("decimal_year_age", "cells", lambda: {"age": D.decimal_age(F.col("day"), F.col("made_year").cast("int"))},
        "round_even((day - make_date(made_year, 1, 1)) / 365.25, 2) AS age", key="id")
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.MONTH_NAMES.items())
_TOKEN = "CASE WHEN label = 'ALLINDIA' THEN 'EVERGREEN' ELSE upper(substring(label, 7, 5)) END"
project("month_token_label", "cells", lambda: {"token": T.month_token("label"), "month": T.month_label(T.month_token("label"))},
        f"""{_TOKEN} AS token, CASE WHEN label = 'ALLINDIA' THEN 'No specific month' ELSE CASE upper(substring(label, 7, 3)) {_NAMES} END || ' 20'
            || substring(label, 10, 2) END AS month""", key="id")
project("state_code", "cells", lambda: {"state": T.state_code("code")},
        "CASE upper(substring(code, 1, 2)) WHEN 'TG' THEN 'TS' WHEN 'OR' THEN 'OD' WHEN 'GC' THEN 'CG' WHEN 'MH' THEN 'MH' END AS state", key="id")
project("canonical_plan_type", "life", lambda: {"plan_type": L.canonical_type("category")},
        """CASE category WHEN 'Non Par' THEN 'Non-Par' WHEN 'PAR(Trad)' THEN 'Par' WHEN 'ULIP' THEN 'ULIP' WHEN 'Term Plan' THEN 'Term'
           WHEN 'Pension' THEN 'Pension' WHEN 'Non- PAR' THEN 'Non-Par' WHEN 'Annuity' THEN 'Annuity' ELSE category END AS plan_type""")


@query("renewal_label_years", """
SELECT id, label LIKE '%Yr-1' AND label NOT LIKE '%+%' AS year_one_only,
  CASE label WHEN 'Year 2' THEN '2' WHEN 'Yr-3 Total' THEN '3' WHEN 'Year 4 & 5 Onwards' THEN '4,5' WHEN 'Year 2 TO 5' THEN '2,3,4,5'
    WHEN 'Renewal at 6th year' THEN '6' WHEN 'Comm. Yr-1 + Bonus' THEN '' WHEN '3rd year' THEN '3' WHEN 'Beyond' THEN ''
    WHEN 'Year 2 and 3' THEN '2,3' WHEN 'Yr. 10' THEN '10' END AS years,
  CASE label WHEN 'Year 2' THEN '0' WHEN 'Yr-3 Total' THEN '1' WHEN 'Year 4 & 5 Onwards' THEN '2,3,4' WHEN 'Year 2 TO 5' THEN '0,1,2,3'
    WHEN 'Renewal at 6th year' THEN '4' WHEN 'Comm. Yr-1 + Bonus' THEN '4' WHEN '3rd year' THEN '1' WHEN 'Beyond' THEN '4'
    WHEN 'Year 2 and 3' THEN '0,1' WHEN 'Yr. 10' THEN '4' ELSE '' END AS slots
FROM life_label""")
def renewal_label_years(s: Source) -> DataFrame:
    parsed = s.life_label.withColumn("p", L.renewal_years("label"))
    return parsed.select("id", "p.year_one_only", F.array_join(F.col("p.years").cast("array<string>"), ",").alias("years"),
                         F.array_join(L.renewal_slots(F.col("p")).cast("array<string>"), ",").alias("slots"))


project("ppt_from_product_name", "life", lambda: {"term": L.ppt_from_name("product_name"), "name": L.name_without_ppt("product_name")},
        """CASE row_id % 4 WHEN 1 THEN regexp_extract(product_name, '([0-9]+) Pay', 1) WHEN 2 THEN 'SP' END AS term,
           CASE row_id % 4 WHEN 1 THEN trim(split_part(product_name, regexp_extract(product_name, '([0-9]+) Pay', 1) || ' Pay', 1)) || ' - Life Option'
             WHEN 2 THEN replace(product_name, 'SP Pay ', '') ELSE product_name END AS name""")


@query("raw_renewal_parse", """
WITH part AS (SELECT row_id, unnest(string_split(raw_renewals, ';')) AS part FROM life)
SELECT row_id, trim(split_part(part, ':', 1)) AS label, trim(split_part(part, ':', 2)) AS value FROM part
WHERE trim(split_part(part, ':', 2)) NOT IN ('', '—')""")
def raw_renewal_parse(s: Source) -> DataFrame:
    entries = s.life.select("row_id", F.explode(L.raw_renewals("raw_renewals", filled_only=True)).alias("e"))
    return entries.select("row_id", "e.label", "e.value")


@query("search_params_parse", """
SELECT id, CASE WHEN action = 'MOTOR_POINTS_SEARCH' THEN CAST(id % 7 AS STRING) END AS product,
  CASE WHEN action = 'MOTOR_POINTS_SEARCH' THEN 'O''Brien ' || CAST(user_id % 9 AS STRING) END AS holder,
  CASE WHEN action = 'MOTOR_POINTS_SEARCH' THEN CASE WHEN id % 2 = 0 THEN 'YES' ELSE 'NA' END END AS ncb,
  CASE WHEN action = 'HEALTH_POINTS_SEARCH' THEN 'Fresh' END AS business_type FROM audit""")
def search_params_parse(s: Source) -> DataFrame:
    p = J.search_params("details")
    return s.audit.select("id", p["product"].alias("product"), p["policy_holder_name"].alias("holder"), p["is_ncb"].alias("ncb"), p["business_type"].alias("business_type"))


project("rate_rounding", "cells", lambda: {"rate": N.round_rate(F.col("price") / 7)}, "round_even(price / 7, 2) AS rate", key="id")


def _hash_cell(c: str, blank: str) -> str:
    return f"lower(trim(coalesce(CAST({c} AS STRING), '{blank}')))"


@query("group_hash", f"SELECT id, sha256(concat_ws('|', {', '.join(_hash_cell(c, '') for c in K.GROUP_FIELDS)})) AS hash FROM rate_card")
def group_hash(s: Source) -> DataFrame:
    card = s.rate_card
    return card.select("id", M.group_hash(card).alias("hash"))


@query("health_identity_hash", f"SELECT id, sha256(concat_ws('|', {', '.join(_hash_cell(c, 'none') for c in K.HEALTH_HASH_FIELDS)})) AS hash FROM health_card")
def health_identity_hash(s: Source) -> DataFrame:
    card = s.health_card
    return card.select("id", M.health_hash(card).alias("hash"))


@query("insurer_from_file_name", """
WITH insurer AS (SELECT DISTINCT insurer_name, split_part(insurer_name, ' ', 2) AS no FROM grids),
named AS (SELECT DISTINCT file_key, regexp_extract_all(string_split(file_key, '/')[-1], '[a-z0-9]+') AS words FROM grids WHERE file_key <> ''),
hit AS (SELECT file_key, count(*) AS n, min(insurer_name) AS insurer FROM named JOIN insurer ON list_contains(words, no) GROUP BY 1)
SELECT file_key, CASE WHEN n = 1 THEN insurer END AS insurer FROM named LEFT JOIN hit USING (file_key)""")
def insurer_from_file_name(s: Source) -> DataFrame:
    files = s.grids.where("file_key <> ''").select("file_key").distinct()
    return M.guess_insurers(files, s.grids.select(F.col("insurer_name").alias("insurer")).distinct())


def _payload(s: Source) -> DataFrame:
    cells = {"Policy: Vehicle Make ": "make", " Policy: model": "model", "Policy Type": "policy_type", "Policy: sub product": "sub_product", "Policy: rto no": "rto"}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in cells.items()])
    return s.mis.select("row_id", F.map_from_entries(entries).alias("payload"))


@query("normalised_payload_map", """
WITH cell AS (SELECT row_id, unnest([{{'k': 'policy: vehicle make', 'v': make}}, {{'k': 'policy: model', 'v': model}}, {{'k': 'policy type', 'v': policy_type}},
  {{'k': 'policy: sub product', 'v': sub_product}}, {{'k': 'policy: rto no', 'v': rto}}]) AS c FROM mis)
SELECT row_id, c.k AS key, trim(c.v) AS value FROM cell WHERE c.v IS NOT NULL""")
def normalised_payload_map(s: Source) -> DataFrame:
    return _payload(s).select("row_id", F.explode(E.normalized_payload("payload")).alias("key", "value"))


@query("payload_summary", """
WITH pick AS (SELECT row_id, make, model, policy_type, sub_product, rto, list_filter([make, model, policy_type, sub_product], lambda v: v IS NOT NULL AND v <> '') AS p FROM mis)
SELECT row_id, array_to_string(p[1:3], '|') AS summary,
  array_to_string(list_filter([CASE WHEN len(p) = 4 THEN sub_product END, rto], lambda v: v IS NOT NULL AND v <> ''), '|') AS rest FROM pick""")
def payload_summary(s: Source) -> DataFrame:
    split = _payload(s).withColumn("s", E.payload_summary("payload"))
    return split.select("row_id", *[F.array_join(F.transform(F.col(f"s.{part}"), lambda e: e["value"]), "|").alias(part) for part in ("summary", "rest")])


@query("renewal_overflow_flag", """
SELECT row_id, CAST(1 + CAST((row_id - 1) % 3 = 0 AS INTEGER) + CAST((row_id - 1) % 6 = 0 AS INTEGER) > CAST(renewal_2 IS NOT NULL AS INTEGER) + CAST(renewal_3 IS NOT NULL AS INTEGER)
  + CAST(renewal_4 IS NOT NULL AS INTEGER) + CAST(renewal_5 IS NOT NULL AS INTEGER) + CAST(renewal_6 IS NOT NULL AS INTEGER) AS BOOLEAN) AS overflow FROM life""")
def renewal_overflow_flag(s: Source) -> DataFrame:
    rows = s.life.select("row_id", F.col("raw_renewals").alias("All_Renewal_Years_Raw"),
                         *[F.col(f"renewal_{i + 2}").alias(slot) for i, slot in enumerate(K.RENEWAL_SLOTS)])
    return rows.select("row_id", has_overflow().alias("overflow"))
