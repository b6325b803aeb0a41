"""Sources, ingest, retention, worklists, life grids, logs and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalog.card_queries import life_rows
from catalog.mapping_queries import make_master, motor_results, rto_master
from catalog.registry import ORACLES, Source, query
from ratecraft import constants as K
from ratecraft.functions import documents as J
from ratecraft.operators import documents as DOC, gaps as G, life as L, logs as LOG, maintain as M
from ratecraft.session import dealt, shared_folder, stage
from ratecraft.sources import life as LS, policies as P, registry as REG, stored as STORED
from ratecraft.streaming import ingest as ST_INGEST, jobs as ST


def scratch(s: Source) -> str:
    return f"{shared_folder(s.spark)}/run-{uuid.uuid4().hex}"


# ---- sources --------------------------------------------------------------------------------------
@query("policy_file_scan", """SELECT 'P' || CAST(row_id AS STRING) AS policy, row_number() OVER (ORDER BY row_id) - 1 AS id, row_number() OVER (ORDER BY row_id) - 1 AS id_by_small_blocks FROM policy""")
def policy_file_scan(s: Source) -> DataFrame:
    """Policies written in order as several CSV files and read back twice, in whole files and in blocks of 64 kB: every row has the
    number of its line both times."""
    path = scratch(s)
    s.policy.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").select(F.concat(F.lit("P"), F.col("row_id").cast("string")).alias(" Policy: insurance company "), F.col("cc").alias("Policy: cc cubic capacity")).write.csv(path, header=True)
    key, ids = F.col("`Policy: insurance company`").alias("policy"), F.col(P.ROW_ID)
    whole = P.read_policy_file(s.spark, path).select(key, ids.alias("id"))
    limit = "spark.sql.files.maxPartitionBytes"
    before = s.spark.conf.get(limit)
    s.spark.conf.set(limit, "64k")
    try:
        cut = P.read_policy_file(s.spark, path).select(key, ids.alias("id_by_small_blocks"))
    finally:
        s.spark.conf.set(limit, before)
    return whole.join(cut, "policy")


@query("tolerant_column_lookup", "SELECT row_id, insurer_raw AS insurer, CAST(NULL AS STRING) AS rto FROM policy")
def tolerant_column_lookup(s: Source) -> DataFrame:
    raw = s.policy.select("row_id", F.col("insurer_raw").alias(" Policy: insurance company "))
    return P.policy_columns(raw, key="row_id").select("row_id", "insurer", "rto")


@query("mapped_file_columns", "SELECT row_id AS original_row_id, insurer_raw AS insurer, CASE WHEN row_id % 2 = 0 THEN '✅ MATCH' ELSE '❌ NO MATCH' END AS mapping_status FROM policy")
def mapped_file_columns(s: Source) -> DataFrame:
    from ratecraft.plans.mapping import mapped_file

    raw = s.policy.select(F.col("row_id").alias(P.ROW_ID), F.col("insurer_raw").alias("Insurer"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("failure_reason", "display_group_id", "po_type", "po_rate_text", "po_flat_amount", "pi_type", "pi_rate_text", "pi_flat_amount",
                                                           "add_tnc", "cp_premium", "pay_in_amount", "pay_out_amount", "margin_rate", "margin_amount")]
    mapped = s.policy.select("row_id", F.when(F.col("row_id") % 2 == 0, F.lit(K.MATCH)).otherwise(F.lit(K.NO_MATCH)).alias("mapping_status"), *blank)
    out = mapped_file(raw, mapped)
    return out.select(F.col(P.ROW_ID).alias("original_row_id"), F.col("Insurer").alias("insurer"), F.col("Mapping Status").alias("mapping_status"))


_FILES = """WITH f AS (SELECT s_suppkey % 20 AS bucket, string_agg('S' || CAST(s_suppkey AS STRING) || chr(10), '' ORDER BY s_suppkey) AS content FROM {supplier} GROUP BY 1)"""


def written_files(s: Source) -> str:
    """Suppliers written as text, one file for each of twenty buckets."""
    path = scratch(s)
    lines = s.supplier.select((F.col("s_suppkey") % 20).alias("bucket"), "s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("line"))
    lines.repartition("bucket").sortWithinPartitions("bucket", "s_suppkey").select("bucket", "line").write.partitionBy("bucket").text(path)
    return path


@query("file_hash_scan", _FILES + "SELECT CAST(strlen(content) AS BIGINT) AS file_size, sha256(content) AS file_hash FROM f")
def file_hash_scan(s: Source) -> DataFrame:
    return REG.file_hashes(s.spark, written_files(s)).select("file_size", "file_hash")


@query("stored_file_scan", _FILES + "SELECT CAST(bucket AS BIGINT) AS bucket, CAST(strlen(content) AS BIGINT) AS file_size FROM f")
def stored_file_scan(s: Source) -> DataFrame:
    files = REG.stored_files(s.spark, written_files(s))
    return files.select(F.regexp_extract("file_key", "bucket=([0-9]+)", 1).cast("bigint").alias("bucket"), "file_size")


@query("file_hash_registry", """WITH last AS (SELECT target_table, file_hash, max_by(status, (created_at, id)) AS prior_status FROM attempts WHERE id % 2 = 0 GROUP BY 1, 2)
SELECT DISTINCT a.target_table, a.file_hash, prior_status FROM attempts a LEFT JOIN last USING (target_table, file_hash)""")
def file_hash_registry(s: Source) -> DataFrame:
    files = s.attempts.select("target_table", "file_hash").distinct()
    return REG.prior_attempts(files, s.attempts.where("id % 2 = 0")).select("target_table", "file_hash", "prior_status")


@query("upload_outcome", "SELECT id, CASE WHEN id % 4 = 0 THEN 'COMPLETED' WHEN id % 4 = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN id % 4 < 2 THEN user_no ELSE row_count END AS row_count FROM (SELECT *, id * 2 AS user_no FROM attempts) a")
def upload_outcome(s: Source) -> DataFrame:
    outcomes = s.attempts.where("id % 4 < 2").select("id", (F.col("id") % 4 == 0).alias("success"), (F.col("id") * 2).alias("rows"))
    return REG.completed(s.attempts, outcomes).select("id", "status", "row_count")


@query("life_grid_load", "SELECT row_id, insurer, base_rate, base_text FROM life")
def life_grid_load(s: Source) -> DataFrame:
    """Rows written as one grid file per insurer, row by row between an opening and a closing line, and read back."""
    path = scratch(s)
    row = F.to_json(F.struct(F.col("row_id").alias("Row_ID"), F.col("insurer").alias("InsurerDisplay"), F.coalesce(F.col("base_rate").cast("string"), "base_text").alias("Base_Payout_Yr1")))
    ends = stage(s.life.groupBy("insurer").agg(F.min("row_id").alias("first")))
    comma = F.when(F.col("row_id") == F.col("first"), F.lit("")).otherwise(F.lit(", "))
    lines = s.life.join(ends, "insurer").select("insurer", F.lit(1).alias("part"), "row_id", F.concat(comma, row).alias("line"))
    for part, text in ((0, '{"meta": {"source": "grid"}, "rows": ['), (2, "]}")):
        lines = lines.unionByName(ends.select("insurer", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("row_id"), F.lit(text).alias("line")))
    lines.repartition("insurer").sortWithinPartitions("insurer", "part", "row_id").select("insurer", "line").write.partitionBy("insurer").text(path)
    return LS.read_life_grid(s.spark, path).select(F.col("Row_ID").alias("row_id"), F.col("InsurerDisplay").alias("insurer"), F.col("Base_Payout_Yr1").alias("base_rate"),
                                                  F.col("Base_Payout_Yr1_text").alias("base_text"))


@query("document_register", """
WITH c AS (SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(answer, '^```json\\s*', ''), '^```\\s*', ''), '\\s*```$', '')), ',\\s*([}}\\]])', '\\1', 'g') AS doc FROM extracted)
SELECT id, coalesce(doc ->> '$.insurance_company', doc ->> '$.insurer_name') AS insurer_name, doc ->> '$.policy_number' AS policy_number,
  CAST(TRY_CAST(regexp_replace(doc ->> '$.gross_premium', '[^0-9.\\-]', '', 'g') AS DECIMAL(12, 2)) AS DOUBLE) AS gross_premium, DATE '1998-03-05' AS policy_start_date FROM c""")
def document_register(s: Source) -> DataFrame:
    return DOC.policy_register(s.extracted).select("id", "insurer_name", "policy_number", F.col("gross_premium").cast("double").alias("gross_premium"), "policy_start_date")


# ---- ingest ---------------------------------------------------------------------------------------
_UPLOAD = {"pi_net_rate": "pi_net_rate", "po_net_rate": "po_net_rate", "cc_min": "cc_min", "cc_max": "cc_max", "po_flat_amount": "po_flat_amount"}


def upload(s: Source) -> DataFrame:
    """The card as an all-text upload, every row twice (a replayed chunk)."""
    text = {c: F.lit("") for c in [*M.TEXT_FIELDS, *M.NUMBER_FIELDS, *M.CODE_FIELDS]}
    text.update({c: F.col(v).cast("string") for c, v in _UPLOAD.items()})
    text.update({c: F.col(c) for c in ("product", "fuel_type", "new_vehicle_makes", "is_ncb")})
    rows = s.rate_card.select(F.col("id").alias("line"), F.concat(F.lit(" "), "insurance_company").alias("insurance_company"), "new_rto_list", F.date_format("from_date", "dd/MM/yyyy").alias("from_date"),
                              F.date_format("to_date", "dd/MM/yyyy").alias("to_date"), F.lit("").alias("user_id"), F.lit("b1").alias("upload_batch_id"), *[v.alias(k) for k, v in text.items()])
    return rows.unionByName(rows.withColumn("line", F.col("line") + 10000000))


_INGEST = """WITH typed AS (SELECT id AS line, insurance_company, new_rto_list, new_vehicle_makes, product, fuel_type, CASE WHEN is_ncb IN ('YES', 'NO') THEN is_ncb ELSE 'NA' END AS is_ncb, from_date, to_date,
  coalesce(pi_net_rate, 0) AS pi_net_rate, coalesce(cc_min, 0) AS cc_min, coalesce(cc_max, 0) AS cc_max FROM rate_card)"""


@query("rate_upload_typed", _INGEST + "SELECT line, insurance_company, is_ncb, from_date, pi_net_rate, cc_max, 'INACTIVE' AS status FROM typed")
def rate_upload_typed(s: Source) -> DataFrame:
    return M.typed_upload(upload(s).where("line < 10000000")).select("line", "insurance_company", "is_ncb", "from_date", "pi_net_rate", "cc_max", "status")


@query("rate_ingest", _INGEST + """SELECT min(line) AS line, new_rto_list FROM typed GROUP BY insurance_company, new_rto_list, new_vehicle_makes, nullif(product, ''), nullif(fuel_type, ''), is_ncb, from_date, to_date, pi_net_rate, cc_min, cc_max""")
def rate_ingest(s: Source) -> DataFrame:
    typed = stage(M.typed_upload(dealt(upload(s), "line")))
    empty = typed.limit(0)
    return M.new_rates(typed, empty).select("line", "new_rto_list")


_KEY = "insurance_company, new_vehicle_makes, nullif(product, ''), nullif(fuel_type, ''), is_ncb, from_date, to_date, pi_net_rate, cc_min, cc_max"


@query("rate_ingest_job", _INGEST + f""", counts AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT new_rto_list, {_KEY} FROM typed) a) AS all_rows, (SELECT count(*) FROM (SELECT DISTINCT {_KEY} FROM typed) b) AS all_groups,
  (SELECT count(*) FROM (SELECT DISTINCT new_rto_list, {_KEY} FROM typed WHERE line % 3 = 0) c) AS third_rows, (SELECT count(*) FROM (SELECT DISTINCT {_KEY} FROM typed WHERE line % 3 = 0) d) AS third_groups)
SELECT 'first' AS upload, true AS success, all_rows AS "rows", all_groups AS new_groups, CAST(NULL AS STRING) AS problem FROM counts UNION ALL SELECT 'again, products by id', true, 0, 0, NULL FROM counts
UNION ALL SELECT 'a third with another rate', true, third_rows, third_groups, NULL FROM counts UNION ALL SELECT 'an unknown RTO', false, 0, 0, 'RTO ''nowhere'' does not exist in RTOMaster. Please add it first.' FROM counts""")
def rate_ingest_job(s: Source) -> DataFrame:
    """Four uploads into one table: the card twice over, again with product ids, a third with changed rates, and one to reject."""
    from ratecraft.plans.ingest import DIMENSIONS, ingest_rates

    card = upload(s)
    masters = {d: stage(card.select(F.lower(d).alias("_k"), F.col(d).alias("name")).where("name <> ''").groupBy("_k").agg(F.min("name").alias("name")).select(F.xxhash64("_k").alias("id"), "name")) for d in DIMENSIONS}
    masters["product"] = masters["product"].withColumn("id", F.abs("id"))
    ids = masters["product"].select(F.lower("name").alias("_k"), F.col("id").cast("string").alias("_id"))
    by_id = card.withColumn("_k", F.lower(F.trim("product"))).join(ids, "_k", "left").withColumn("product", F.coalesce("_id", "product")).drop("_k", "_id")
    changed = card.where("line % 3 = 0 AND line < 10000000").withColumn("pi_net_rate", (F.coalesce(F.col("pi_net_rate").cast("double"), F.lit(0.0)) + 0.25).cast("string"))
    unknown = card.withColumn("new_rto_list", F.when(F.col("line") == F.lit(card.agg(F.max("line").alias("m")).scalar()), F.lit("nowhere")).otherwise(F.col("new_rto_list")))
    uploads = {"first": card, "again, products by id": by_id, "a third with another rate": changed, "an unknown RTO": unknown}
    table, groups, out = None, s.spark.createDataFrame([], "group_id bigint, key_hash string"), None
    for name, rows in uploads.items():
        existing = M.typed_upload(rows.limit(0)) if table is None else table.drop("group_id")
        done = ingest_rates(rows, existing, groups, masters, rto_master(s), make_master(s))
        fresh = stage(done.inserted.select("group_id", "key_hash").distinct().join(groups, ["group_id", "key_hash"], "left_anti"))
        line = done.outcome.select(F.lit(name).alias("upload"), "success", "rows", fresh.agg(F.count("*").alias("n")).scalar().alias("new_groups"), "problem")
        table = done.inserted if table is None else table.unionByName(done.inserted)
        groups, out = groups.unionByName(fresh), line if out is None else out.unionByName(line)
    return out


@query("cross_upload_anti_join", _INGEST + """SELECT DISTINCT line FROM (SELECT min(line) AS line FROM typed GROUP BY insurance_company, new_rto_list, new_vehicle_makes, nullif(product, ''), nullif(fuel_type, ''), is_ncb, from_date, to_date, pi_net_rate, cc_min, cc_max) u
WHERE line NOT IN (SELECT t.line FROM typed t JOIN typed v ON v.line % 3 = 0 AND t.insurance_company = v.insurance_company AND t.new_rto_list = v.new_rto_list AND t.new_vehicle_makes = v.new_vehicle_makes AND t.product = v.product
  AND t.fuel_type = v.fuel_type AND t.is_ncb = v.is_ncb AND t.from_date IS NOT DISTINCT FROM v.from_date AND t.to_date IS NOT DISTINCT FROM v.to_date AND t.pi_net_rate = v.pi_net_rate AND t.cc_min = v.cc_min AND t.cc_max = v.cc_max)""")
def cross_upload_anti_join(s: Source) -> DataFrame:
    """A third of the rows is live already, under another batch."""
    typed = stage(M.typed_upload(dealt(upload(s), "line")))
    live = typed.where("line % 3 = 0 AND line < 10000000").withColumns({"status": F.lit("ACTIVE"), "key_hash": F.lit("another batch")})
    return M.new_rates(typed, live).select("line")


@query("unknown_member_check", "SELECT id AS line, 'new_rto_list' AS field, new_rto_list AS item FROM rate_card WHERE new_rto_list = 'zone_2' UNION ALL SELECT id, 'new_vehicle_makes', u FROM (SELECT id, unnest(string_split(new_vehicle_makes, ', ')) AS u FROM rate_card) x WHERE u = 'mk_ring'")
def unknown_member_check(s: Source) -> DataFrame:
    rows = upload(s).where("line < 10000000")
    return M.unknown_members(rows, rto_master(s).where("name <> 'zone_2'"), make_master(s).where("name <> 'mk_ring'"))


@query("group_id_assignment", """WITH h AS (SELECT DISTINCT sha256(CAST(p_partkey % 500 AS STRING)) AS key_hash, p_partkey % 500 AS n FROM {part}), known AS (SELECT key_hash, n + 1 AS group_id FROM h WHERE n % 2 = 0),
fresh AS (SELECT key_hash, (SELECT max(group_id) FROM known) + row_number() OVER (ORDER BY key_hash) AS group_id FROM h WHERE n % 2 = 1)
SELECT p_partkey AS line, group_id FROM {part} JOIN (SELECT * FROM known UNION ALL SELECT * FROM fresh) g ON key_hash = sha256(CAST(p_partkey % 500 AS STRING))""")
def group_id_assignment(s: Source) -> DataFrame:
    rows = s.part.select(F.col("p_partkey").alias("line"), (F.col("p_partkey") % 500).alias("n"), F.sha2((F.col("p_partkey") % 500).cast("string"), 256).alias("key_hash"))
    known = rows.where("n % 2 = 0").select("key_hash", (F.col("n") + 1).alias("group_id")).distinct()
    return M.assign_groups(rows.select("line", "key_hash"), known).select("line", "group_id")


@query("master_upsert", """WITH up AS (SELECT lower(n_name) AS k, max_by('C' || CAST(n_nationkey AS STRING), n_nationkey) AS c FROM (SELECT 'Zone_' || CAST(n_regionkey AS STRING) AS n_name, n_nationkey FROM {nation}) x GROUP BY 1),
old AS (SELECT name, string_agg(item, ',' ORDER BY item) AS cluster FROM rto_items GROUP BY 1)
SELECT coalesce(name, 'Zone_' || substring(k, 6)) AS name, coalesce(c, cluster) AS cluster FROM old FULL JOIN up ON k = name""")
def master_upsert(s: Source) -> DataFrame:
    up = s.nation.select(F.col("n_nationkey").alias("line"), F.concat(F.lit("Zone_"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("name"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cluster"))
    return M.upsert_master(rto_master(s), up)


@query("health_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN 99.5 ELSE one_year_rate END AS one_year_rate, CASE WHEN id % 6 = 0 THEN 'INACTIVE' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY insurance_company, product_name, policy_category, plan_names, business_type, min_deductible, max_deductible, min_sum_insured, max_sum_insured, min_age, max_age, pincode_zone, from_date, to_date ORDER BY id) AS p FROM health_card) x WHERE p = 1")
def health_upsert(s: Source) -> DataFrame:
    card = s.health_card
    unique = stage(M.first_in_file(card.withColumn("source_row_hash", M.health_hash(card)), "source_row_hash", "id"))
    changed = unique.where("id % 3 = 0").select(F.col("id").alias("line"), *M.HEALTH_TEXT, *M.HEALTH_NUMBERS, *[c for c in M.HEALTH_PERCENTS if c != "one_year_rate"], "from_date", "to_date", "source_row_hash",
                                                F.lit(99.5).alias("one_year_rate"), F.when(F.col("id") % 6 == 0, F.lit("INACTIVE")).alias("status"), F.lit(None).cast("string").alias("is_deleted"), F.lit(None).cast("string").alias("remarks"))
    return M.upsert_health(unique, changed).select("id", "one_year_rate", "status")


def health_upload(s: Source) -> DataFrame:
    """The health card as an uploaded sheet: text cells, some of them no good."""
    text = [F.when(F.col("id") % 50 == 0, F.lit("  ")).otherwise(F.col(c)).alias(c) if c == "insurance_company" else F.concat(F.lit(" "), F.col(c)).alias(c) for c in M.HEALTH_TEXT]
    numbers = [F.when(F.col("id") % 9 == 0, F.lit("--")).otherwise(F.format_number(c, 0)).alias(c) for c in M.HEALTH_NUMBERS]
    status = F.when(F.col("id") % 40 == 0, F.lit("PAUSED")).otherwise(F.lower("status"))
    deleted = F.when(F.col("id") % 60 == 0, F.lit("MAYBE")).otherwise(F.col("is_deleted"))
    return s.health_card.select(
        F.col("id").alias("line"), *text, *numbers, *[F.concat(F.col(c).cast("string"), F.lit("%")).alias(c) for c in M.HEALTH_PERCENTS],
        *[F.date_format(c, "dd/MM/yyyy").alias(c) for c in ("from_date", "to_date")], status.alias("status"), deleted.alias("is_deleted"), "remarks")


@query("health_upload_typed", """SELECT id AS line, CASE WHEN id % 50 <> 0 THEN insurance_company END AS insurance_company, nullif(product_name, '') AS product_name, CASE WHEN id % 9 = 0 THEN 0.0 ELSE min_sum_insured END AS min_sum_insured,
  payin_rate, multi_year_3_rate, from_date, to_date, CASE WHEN id % 40 = 0 THEN 'PAUSED' ELSE status END AS status, CASE WHEN id % 60 = 0 THEN 'MAYBE' ELSE is_deleted END AS is_deleted FROM health_card""")
def health_upload_typed(s: Source) -> DataFrame:
    return M.typed_health_upload(health_upload(s)).select("line", "insurance_company", "product_name", "min_sum_insured", "payin_rate", "multi_year_3_rate", "from_date", "to_date", "status", "is_deleted")


@query("health_upload_rejected", """SELECT line, problem FROM (SELECT id AS line, CASE WHEN id % 50 = 0 THEN 'insurance_company is blank' WHEN id % 40 = 0 THEN '''PAUSED'' is not a valid Status (ACTIVE or INACTIVE).'
  WHEN id % 60 = 0 THEN '''MAYBE'' is not a valid Is Deleted value (YES or NO).' END AS problem FROM health_card) x WHERE problem IS NOT NULL""")
def health_upload_rejected(s: Source) -> DataFrame:
    return M.invalid_health_rows(M.typed_health_upload(health_upload(s)))


# ---- stored tables --------------------------------------------------------------------------------
def kinds_of(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)


_HEALTH_CHANGES = """WITH card AS (SELECT *, row_number() OVER (PARTITION BY insurance_company, product_name, policy_category, plan_names, business_type, min_deductible, max_deductible, min_sum_insured, max_sum_insured, min_age, max_age, pincode_zone, from_date, to_date ORDER BY id) AS p FROM health_card)"""


@query("stored_health_upsert", _HEALTH_CHANGES + " SELECT id, CASE WHEN id % 3 = 0 THEN 99.5 ELSE one_year_rate END AS one_year_rate, CASE WHEN id % 6 = 0 THEN 'INACTIVE' ELSE status END AS status FROM card WHERE p = 1")
def stored_health_upsert(s: Source) -> DataFrame:
    """The health card as a stored table, an upload applied to it by identity, and the same upload again as a retry."""
    card = s.health_card
    unique = stage(M.first_in_file(card.withColumn("source_row_hash", M.health_hash(card)), "source_row_hash", "id"))
    own = ["id", "source_row_hash", *M.HEALTH_TEXT, *M.HEALTH_NUMBERS, *M.HEALTH_PERCENTS, "from_date", "to_date", "status", "is_deleted", "remarks"]
    rows = unique.select(*own)
    fields = [F.lit(99.5).alias("one_year_rate") if c == "one_year_rate" else F.when(F.col("id") % 6 == 0, F.lit("INACTIVE")).alias("status") if c == "status"
              else F.lit(None).cast("string").alias(c) if c in ("is_deleted", "remarks") else F.col(c) for c in own if c != "id"]
    changed = rows.where("id % 3 = 0").select(F.col("id").alias("line"), *fields)
    table = STORED.StoredTable(s.spark, scratch(s), kinds_of(rows), key="source_row_hash")
    table.insert("load", rows)
    for _ in range(2):
        table.upsert("upload 1", changed, M.upsert_health)
    return table.read().select("id", "one_year_rate", "status")


@query("stored_rate_changes", """WITH hit AS (SELECT DISTINCT group_id FROM rate_card WHERE group_id % 7 = 0)
SELECT id, CASE WHEN group_id IN (SELECT group_id FROM hit) THEN 12.35 ELSE pi_od_rate END AS pi_od_rate FROM rate_card WHERE is_deleted <> 'YES'""")
def stored_rate_changes(s: Source) -> DataFrame:
    """The rate card as a stored table; a bulk update of some groups and a purge, each applied twice as a retry would."""
    card = stage(s.rate_card)
    table = STORED.StoredTable(s.spark, scratch(s), kinds_of(card))
    table.insert("load", card)
    keys = card.where("group_id % 7 = 0").select(F.col("group_id").alias("wanted")).distinct()
    for _ in range(2):
        table.set_field("edit", keys, "pi_od_rate", "12.347")
        table.purge("purge", F.col("is_deleted") == "YES")
    return table.read().select("id", F.round("pi_od_rate", 2).alias("pi_od_rate"))


# ---- retention ------------------------------------------------------------------------------------
@query("log_retention", "SELECT id FROM audit WHERE action = 'LOGIN' OR ts >= TIMESTAMP '2024-01-13 00:00:00'")
def log_retention(s: Source) -> DataFrame:
    return M.retained_log(s.audit, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id")


@query("monthly_retention_manifest", "SELECT strftime(uploaded_date, '%Y-%m') AS month, count(*) AS documents, count_if(file_key <> '') AS files, CAST(coalesce(sum(CASE WHEN file_key <> '' THEN file_size END), 0) AS BIGINT) AS bytes FROM grids WHERE uploaded_date < DATE '2000-01-01' GROUP BY 1")
def monthly_retention_manifest(s: Source) -> DataFrame:
    _, expired = M.split_retention(s.grids, F.to_date(F.lit("2000-03-15")), 3)
    return M.manifest(expired).select("month", "documents", "files", "bytes")


@query("archive_verified_months", "SELECT DISTINCT strftime(uploaded_date, '%Y-%m') AS month FROM grids WHERE uploaded_date < DATE '2000-01-01'")
def archive_verified_months(s: Source) -> DataFrame:
    """Expired months written as an archive, read back and compared before any purge."""
    path = scratch(s)
    _, expired = M.split_retention(s.grids, F.to_date(F.lit("2000-03-15")), 3)
    expired.write.partitionBy("month").parquet(path)
    return M.verified_months(expired, s.spark.read.schema(expired.schema).parquet(path))


@query("restore_from_archive", """WITH e AS (SELECT *, id % 3 AS manifest_no FROM grids WHERE file_key <> ''), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY manifest_no DESC, id DESC) AS p FROM e) x WHERE p = 1)
SELECT id, file_key FROM newest WHERE file_key NOT IN (SELECT file_key FROM grids WHERE uploaded_date >= DATE '2000-01-01')""")
def restore_from_archive(s: Source) -> DataFrame:
    entries = s.grids.withColumn("manifest_no", F.col("id") % 3)
    return M.restorable(entries, s.grids.where("uploaded_date >= '2000-01-01'")).select("id", "file_key")


@query("orphan_detection", "SELECT id FROM grids WHERE file_key NOT IN (SELECT file_key FROM grids WHERE id % 2 = 0) AND uploaded_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def orphan_detection(s: Source) -> DataFrame:
    files = s.grids.select("id", "file_key", F.col("uploaded_date").alias("modified"))
    return M.orphans(files, s.grids.where("id % 2 = 0"), F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1999-12-31"))).select("id")


@query("spelling_map_problems", """WITH batch AS (SELECT upper(p_brand) || CASE WHEN p_partkey % 50 = 0 THEN ' ' || CAST(p_partkey AS STRING) ELSE '' END AS name,
  CASE WHEN p_partkey % 50 = 0 THEN upper(p_brand) || ' ' || CAST(p_partkey AS STRING) WHEN p_partkey % 7 = 0 THEN upper(p_name) || ', OLD' ELSE upper(p_name) END AS value FROM {part}),
r AS (SELECT DISTINCT name, value FROM (SELECT name, value FROM batch UNION ALL SELECT name, name FROM batch) b)
SELECT name, value, 'contains a comma' AS problem FROM r WHERE contains(value, ',')
UNION ALL SELECT name, name, 'needs another spelling' FROM r GROUP BY name HAVING count(DISTINCT value) < 2
UNION ALL SELECT min(name), value, 'is in several mappings of the batch' FROM r GROUP BY value HAVING count(DISTINCT name) > 1
UNION ALL SELECT DISTINCT name, value, 'is already mapped under "' || mapping_name || '"' FROM r JOIN spelling USING (value)""")
def spelling_map_problems(s: Source) -> DataFrame:
    """One new mapping per brand, and one of its own name alone for each fiftieth part, checked against the known spellings."""
    alone, number = F.col("p_partkey") % 50 == 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))
    name = F.concat(F.col("p_brand"), F.when(alone, number).otherwise(F.lit("")))
    value = F.when(alone, name).when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(", old"))).otherwise(F.col("p_name"))
    batch = s.part.select(F.lit(None).cast("bigint").alias("mapping_id"), name.alias("name"), value.alias("value"))
    return M.mapping_problems(batch, s.spelling)


@query("spelling_map_changes", "SELECT mapping_id, 'removed' AS change, count(*) AS n FROM spelling WHERE value LIKE 'RED%' GROUP BY 1 UNION ALL SELECT mapping_id, 'added', 1 FROM (SELECT DISTINCT mapping_id FROM spelling) x")
def spelling_map_changes(s: Source) -> DataFrame:
    kept = s.spelling.where("value NOT LIKE 'RED%'").select("mapping_id", F.col("mapping_name").alias("name"), "value")
    own = s.spelling.select("mapping_id", F.col("mapping_name").alias("name"), F.col("mapping_name").alias("value"))
    return M.mapping_changes(kept.unionByName(own), s.spelling).groupBy("mapping_id", "change").agg(F.count("*").alias("n"))


# ---- worklist -------------------------------------------------------------------------------------
def failed_texts(s: Source) -> DataFrame:
    payload = F.create_map(F.lit(" Policy: VehProduct"), F.col("product"), F.lit("Policy: vehicle make"), F.split_part("make_model", F.lit(" "), F.lit(1)))
    return s.reason.select("id", F.col("file_id").alias("mis_file_id"), F.lit("NO_MATCH").alias("status_key"), F.col("reason").alias("failure_reason"), F.col("insurer_raw").alias("insurer"), payload.alias("payload"))


def files(s: Source) -> DataFrame:
    return s.reason.groupBy(F.col("file_id").alias("mis_file_id")).agg(F.min("seen_on").alias("uploaded_on"))


_MISSING = """WITH f AS (SELECT file_id, min(seen_on) AS up FROM reason GROUP BY 1), m AS (SELECT make_model AS value, product, insurer_raw AS insurer, count(*) AS policy_count, count(DISTINCT file_id) AS file_count, min(up) AS first_seen, max(up) AS last_seen
FROM reason JOIN f USING (file_id) WHERE reason LIKE 'Failed on: Policy: vehicle make / model —%' GROUP BY 1, 2, 3)"""


@query("missing_make_model_groups", _MISSING + "SELECT value, split_part(value, ' ', 1) AS make, product, insurer, policy_count, file_count, first_seen, last_seen FROM m")
def missing_make_model_groups(s: Source) -> DataFrame:
    return G.missing_models(failed_texts(s), files(s)).select("value", "make", "product", "insurer", "policy_count", "file_count", "first_seen", "last_seen")


_SCOPE = """, scope AS (SELECT DISTINCT lower(insurance_company) AS ins, lower(product) AS product, name FROM (SELECT insurance_company, product, unnest(string_split(new_vehicle_makes, ', ')) AS name FROM rate_card
  WHERE status = 'ACTIVE' AND is_deleted = 'NO' AND sub_product = '' AND make_model_class = 'NA') u),
hit AS (SELECT value, m.product, insurer, list(DISTINCT name ORDER BY name) AS names FROM m JOIN scope s ON s.product = lower(m.product) AND s.ins = lower(m.insurer) AND (name = 'mk_all' OR name = 'mk_' || split_part(value, ' ', 2)) GROUP BY 1, 2, 3)"""


@query("resolution_scope", _MISSING.replace("insurer_raw AS insurer", "'Supplier ' || substring(insurer_raw, 10, 2) || ' General Insurance Co Ltd' AS insurer") + _SCOPE + """
SELECT value, m.product, insurer, coalesce(array_to_string(names, ','), '') AS resolved_names, names IS NOT NULL OR value = 'red ring' AS resolved FROM m LEFT JOIN hit USING (value, product, insurer)""")
def resolution_scope(s: Source) -> DataFrame:
    named = F.concat(F.lit("Supplier "), F.substring("insurer", 10, 2), F.lit(" General Insurance Co Ltd"))
    groups = stage(G.missing_models(failed_texts(s).withColumn("insurer", named), files(s)))
    manual = groups.where("value = 'red ring'").select(*G.GROUP)
    marked = G.with_resolution(groups, make_master(s), s.rate_card, manual)
    return marked.select("value", "product", "insurer", F.array_join("resolved_names", ",").alias("resolved_names"), "resolved")


@query("worklist_filter", _MISSING + "SELECT value, product FROM m WHERE insurer = 'supplier 03 gen. insurance' AND value LIKE '%ring%'")
def worklist_filter(s: Source) -> DataFrame:
    groups = G.missing_models(failed_texts(s), files(s)).withColumn("resolved", F.lit(False))
    return G.filter_worklist(groups, insurer="supplier 03 gen. insurance", q="RING").select("value", "product")


@query("failed_row_filter", "SELECT id FROM reason JOIN (SELECT file_id, min(seen_on) AS up FROM reason GROUP BY 1) f USING (file_id) WHERE insurer_raw = 'supplier 04 gen. insurance' AND up <= DATE '1995-01-31'")
def failed_row_filter(s: Source) -> DataFrame:
    return G.filter_failed(failed_texts(s), files(s), status_key="NO_MATCH", insurer="supplier 04 gen. insurance", date_to="1995-01-31").select("id")


@query("duplicate_name_guard", """WITH w AS (SELECT DISTINCT upper(item) AS item, name, unnest(string_split(upper(item), ' ')) AS word FROM make_items),
v AS (SELECT DISTINCT item AS value, word FROM w), hit AS (SELECT DISTINCT value, name FROM (SELECT value, name, item FROM v JOIN w USING (word) GROUP BY 1, 2, 3 HAVING count(*) > 1) pairs)
SELECT value, string_agg(name, ',' ORDER BY name) AS names FROM hit GROUP BY 1""")
def duplicate_name_guard(s: Source) -> DataFrame:
    values = make_master(s).select(F.explode(F.split("cluster", ",")).alias("value"))
    return G.already_listed(values, make_master(s)).select("value", F.array_join("names", ",").alias("names"))


@query("bulk_cluster_append", "SELECT name, CAST(count(*) AS BIGINT) + CASE WHEN name = 'mk_all' THEN (SELECT count(DISTINCT s_nationkey) FROM {supplier}) ELSE 0 END AS items FROM make_items GROUP BY 1")
def bulk_cluster_append(s: Source) -> DataFrame:
    approved = s.supplier.select(F.lit("mk_all").alias("name"), F.concat(F.lit("cycle,n"), F.col("s_nationkey").cast("string")).alias("value"))
    out = G.append_to_clusters(make_master(s), approved)
    return out.select("name", F.size(F.split("cluster", ",")).cast("bigint").alias("items"))


# ---- life -----------------------------------------------------------------------------------------
@query("life_search_grid", "SELECT row_id FROM life WHERE insurer = 'Insurer 5' AND ppt = '10' AND (lower(product_name) LIKE '%ring%' OR lower(coalesce(variant, '')) LIKE '%ring%')")
def life_search_grid(s: Source) -> DataFrame:
    return L.search_grid(life_rows(s), insurer="Insurer 5", ppt="10", query="RING").select(F.col("Row_ID").alias("row_id"))


@query("life_search_grouping", "SELECT insurer, product_name, count(*) AS \"rows\", (SELECT min_by(notes, row_id) FROM life n WHERE n.insurer = l.insurer AND notes IS NOT NULL) AS notes FROM life l GROUP BY 1, 2")
def life_search_grouping(s: Source) -> DataFrame:
    grouped = L.grouped_grid(life_rows(s))
    return grouped.select(F.col("InsurerDisplay").alias("insurer"), F.col("Product_Name").alias("product_name"), "rows", "notes")


@query("life_product_count", "SELECT count(DISTINCT (insurer, product_name)) AS products FROM life")
def life_product_count(s: Source) -> DataFrame:
    return L.product_count(life_rows(s))


@query("life_best_payouts", "SELECT row_id, base_rate FROM life WHERE category IN ('Non Par', 'Non- PAR') AND base_rate IS NOT NULL AND ppt = '10'")
def life_best_payouts(s: Source) -> DataFrame:
    best = L.best_payouts(life_rows(s), plan_type="Non-Par", ppt="10")
    return best.select(F.col("Row_ID").alias("row_id"), F.col("Base_Payout_Yr1").alias("base_rate"))


@query("life_insurer_summary", "SELECT insurer, count(*) AS \"rows\", count(DISTINCT product_name || '|' || coalesce(variant, '<none>')) AS products FROM life GROUP BY 1")
def life_insurer_summary(s: Source) -> DataFrame:
    return L.insurer_summary(life_rows(s)).select(F.col("InsurerDisplay").alias("insurer"), "rows", "products")


@query("renewal_unpivot", " UNION ALL ".join(f"SELECT row_id, {i} AS slot, renewal_{i + 2} AS value FROM life WHERE renewal_{i + 2} IS NOT NULL" for i in range(5)))
def renewal_unpivot(s: Source) -> DataFrame:
    return L.renewal_long(life_rows(s)).select(F.col("Row_ID").alias("row_id"), "slot", "value")


def _percent(c: str) -> str:
    value = f"(floor({c} * 100 * 100 + 0.5) / 100)"
    return f"CASE WHEN {c} IS NOT NULL THEN '{{label}} ' || CASE WHEN {value} = floor({value}) THEN printf('%.1f', {value}) ELSE CAST({value} AS STRING) END || '%' END"


_PARTS = ", ".join(_percent(f"renewal_{i + 2}").replace("{label}", label) for i, label in enumerate(L.SLOT_LABELS))


@query("renewal_summary_text", f"SELECT row_id, nullif(array_to_string(list_filter([{_PARTS}], lambda x: x IS NOT NULL), ' · '), '') AS summary FROM life")
def renewal_summary_text(s: Source) -> DataFrame:
    return life_rows(s).select(F.col("Row_ID").alias("row_id"), L.renewal_summary().alias("summary"))


@query("populated_renewal_years", " UNION ALL ".join(f"SELECT '{slot}' AS slot, count(renewal_{k}) > 0 AS visible FROM life" for k, slot in enumerate(K.RENEWAL_SLOTS, 2)))
def populated_renewal_years(s: Source) -> DataFrame:
    return L.visible_slots(life_rows(s))


def columns_of(s: Source) -> DataFrame:
    return s.life_label.select(F.col("line").alias("table_id"), "position", "label")


# The slots each label names, and whether it is a total; 'Renewal' takes what is free, and 'Reward Yr-1' names none.
_SLOTS = """WITH claim AS (SELECT * FROM (VALUES ('Year 2', 0, false), ('Yr-3 Total', 1, true), ('Year 4 & 5 Onwards', 2, false), ('Year 4 & 5 Onwards', 3, false), ('Year 4 & 5 Onwards', 4, false),
  ('Year 2 TO 5', 0, false), ('Year 2 TO 5', 1, false), ('Year 2 TO 5', 2, false), ('Year 2 TO 5', 3, false), ('Renewal at 6th year', 4, false), ('3rd year', 1, false),
  ('Year 2 and 3', 0, false), ('Year 2 and 3', 1, false), ('Yr. 10', 4, false), ('Comm. Yr-1 + Bonus', 4, false), ('Beyond', 4, false)) c(label, slot, total)),
named AS (SELECT line AS table_id, position, slot, total FROM life_label JOIN claim USING (label)),
rest AS (SELECT line AS table_id, position, row_number() OVER (PARTITION BY line ORDER BY position) AS n FROM life_label WHERE label = 'Renewal'),
free AS (SELECT table_id, slot, row_number() OVER (PARTITION BY table_id ORDER BY slot) AS n FROM (SELECT DISTINCT line AS table_id, slot FROM life_label, (SELECT unnest([0, 1, 2, 3, 4]) AS slot) e) t
  WHERE NOT EXISTS (SELECT 1 FROM named WHERE named.table_id = t.table_id AND named.slot = t.slot)),
every AS (SELECT table_id, slot, position, total FROM named UNION ALL SELECT rest.table_id, coalesce(free.slot, 4), position, false FROM rest LEFT JOIN free ON free.table_id = rest.table_id AND free.n = rest.n),
chosen AS (SELECT table_id, slot, arg_max(position, CAST(total AS INTEGER) * 100 + position) AS position FROM every GROUP BY 1, 2)
"""


@query("renewal_slot_assignment", _SLOTS + "SELECT table_id, slot, position FROM chosen")
def renewal_slot_assignment(s: Source) -> DataFrame:
    return L.slot_columns(columns_of(s)).select("table_id", "slot", F.col("position").cast("int").alias("position"))


@query("wide_payout_records", _SLOTS + ", ".join(["SELECT c.table_id", *(f"max(CASE WHEN slot = {i} THEN value END) AS {y}" for i, y in enumerate(("yr2", "yr3", "yr4", "yr5", "yr6")))]) + """
FROM chosen c JOIN life_label l ON l.line = c.table_id AND l.position = c.position GROUP BY 1""")
def wide_payout_records(s: Source) -> DataFrame:
    cells = s.life_label.select(F.col("line").alias("table_id"), F.lit(0).alias("line"), "position", "value")
    wide = L.wide_records(cells, columns_of(s))
    return wide.select("table_id", *[F.col(c).alias(y) for c, y in zip(K.RENEWAL_SLOTS, ("yr2", "yr3", "yr4", "yr5", "yr6"))])


@query("context_fill_down", """WITH own AS (SELECT p_brand AS sheet, p_partkey % 4 AS block, p_partkey AS line, CASE WHEN p_size % 3 = 0 THEN p_name END AS product, CASE WHEN p_size % 5 = 0 THEN p_type END AS category,
  CASE WHEN p_size % 4 = 0 THEN p_type END AS variant, CASE WHEN p_size % 7 = 0 THEN p_brand END AS pt FROM {part}),
c AS (SELECT * FROM own UNION ALL SELECT 'all', 0, line, product, category, variant, pt FROM own),
named AS (SELECT *, last_value(product IGNORE NULLS) OVER w AS product_name, last_value(category IGNORE NULLS) OVER w AS category_name,
  last_value(product IGNORE NULLS) OVER (PARTITION BY sheet, block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c WINDOW w AS (PARTITION BY sheet, block ORDER BY line)),
runs AS (SELECT *, count_if(product IS NOT NULL AND (prior IS NULL OR product <> prior)) OVER (PARTITION BY sheet, block ORDER BY line) AS run FROM named)
SELECT sheet, block, line, product_name, category_name, last_value(variant IGNORE NULLS) OVER r AS variant_name, last_value(pt IGNORE NULLS) OVER r AS pt_value FROM runs
WINDOW r AS (PARTITION BY sheet, block, run ORDER BY line)""")
def context_fill_down(s: Source) -> DataFrame:
    """Blocks of a few lines, and one block of all lines."""
    filled = {"product": (3, "p_name"), "category": (5, "p_type"), "variant": (4, "p_type"), "pt": (7, "p_brand")}
    cells = s.part.select(F.col("p_brand").alias("sheet"), (F.col("p_partkey") % 4).alias("block"), F.col("p_partkey").alias("line"), *[F.when(F.col("p_size") % n == 0, F.col(c)).alias(out) for out, (n, c) in filled.items()])
    whole = cells.withColumns({"sheet": F.lit("all"), "block": F.lit(0).cast(cells.schema["block"].dataType)})
    return L.fill_down(cells.unionByName(whole))


# ---- logs -----------------------------------------------------------------------------------------
def _dims(s: Source) -> dict[str, DataFrame]:
    names = s.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return {p: names for p in LOG.DIMENSION_PARAMS}


_NOW = "2024-01-31 00:00:00"


@query("points_search_report", """SELECT id, CASE WHEN action = 'HEALTH_POINTS_SEARCH' THEN 'Health' ELSE 'Motor' END AS search_type,
  CASE WHEN action = 'HEALTH_POINTS_SEARCH' THEN 'Plan ' || CAST(id % 5 AS STRING) ELSE coalesce(p.r_name, CAST(id % 7 AS STRING)) END AS product,
  CASE WHEN action = 'HEALTH_POINTS_SEARCH' THEN 'Fresh' ELSE coalesce(q.r_name, CAST(id % 3 AS STRING)) END AS sub_product, CASE WHEN action = 'HEALTH_POINTS_SEARCH' THEN '' ELSE 'R' END AS fuel,
  CASE WHEN action = 'MOTOR_POINTS_SEARCH' AND id % 2 = 0 THEN 'YES' ELSE 'NO' END AS ncb, strftime(ts, '%Y-%m-%d %H:%M:%S') AS search_time
FROM audit LEFT JOIN {region} p ON p.r_regionkey = id % 7 LEFT JOIN {region} q ON q.r_regionkey = id % 3 WHERE action IN ('MOTOR_POINTS_SEARCH', 'HEALTH_POINTS_SEARCH') AND ts >= TIMESTAMP '2024-01-24 00:00:00'""")
def points_search_report(s: Source) -> DataFrame:
    rows = LOG.points_log(s.audit, F.lit(_NOW).cast("timestamp"))
    return LOG.points_report(rows, _dims(s)).select("id", "search_type", "product", "sub_product", "fuel", "ncb", "search_time")


@query("param_name_resolution", "SELECT id, coalesce(r_name, CAST(id % 7 AS STRING)) AS product FROM audit LEFT JOIN {region} ON r_regionkey = id % 7 WHERE action = 'MOTOR_POINTS_SEARCH'")
def param_name_resolution(s: Source) -> DataFrame:
    rows = s.audit.where("action = 'MOTOR_POINTS_SEARCH'").withColumn("params", J.search_params("details"))
    return LOG.with_names(rows, {"product": _dims(s)["product"]}).select("id", F.col("_product").alias("product"))


@query("security_audit_report", "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, username, action, details FROM audit WHERE action IN ('BULK UPDATE', 'MANUAL EDIT') AND ts >= TIMESTAMP '2024-01-24 00:00:00'")
def security_audit_report(s: Source) -> DataFrame:
    return LOG.audit_report(s.audit, F.lit(_NOW).cast("timestamp"))


# ---- streaming ------------------------------------------------------------------------------------
def streamed(s: Source, frame: DataFrame) -> DataFrame:
    """A frame written in several files and read as a stream of them."""
    path = scratch(s)
    frame.repartition(4).write.parquet(path)
    return s.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_policy_mapping", "SELECT row_id, CASE lower(trim(coalesce(product, ''))) WHEN 'motor' THEN 'motor' WHEN 'health' THEN 'health' ELSE 'none' END AS route FROM mis")
def stream_policy_mapping(s: Source) -> DataFrame:
    """The routing step alone as the batch function of a continuous job."""
    from ratecraft.plans.mapping import route

    out, checkpoint = scratch(s), scratch(s)
    policies = streamed(s, s.mis.select("row_id", "product"))
    ST.map_stream(policies, lambda batch: batch.select("row_id", route().alias("route")), out, checkpoint, available_now=True).awaitTermination()
    return s.spark.read.parquet(out).select("row_id", "route")


@query("stream_motor_mapping")
def stream_motor_mapping(s: Source) -> DataFrame:
    """The whole motor chain over policy files that arrive as CSV: the same rows as the batch run."""
    arrived, out, checkpoint = scratch(s), scratch(s), scratch(s)
    s.mis.repartition(2).write.csv(arrived, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.mis.schema.fields)
    policies = ST.policy_stream(s.spark, arrived, kinds, files_per_batch=1).drop("file_name")
    ST.map_stream(policies, lambda batch: motor_results(s, batch), out, checkpoint, available_now=True).awaitTermination()
    return s.spark.read.parquet(out).select("row_id", "mapping_status", "failure_reason", "display_group_id", "po_rate", "pi_rate", "po_type")


ORACLES["stream_motor_mapping"] = ORACLES["motor_mapping"]


_ARRIVED = _INGEST + """, dealt AS (SELECT *, CAST(substring(insurance_company, 10, 2) AS INT) % 3 AS file FROM typed),
rules AS (SELECT DISTINCT file, insurance_company, new_rto_list, new_vehicle_makes, nullif(product, '') AS product, nullif(fuel_type, '') AS fuel_type, is_ncb, from_date, to_date, pi_net_rate, cc_min, cc_max FROM dealt)"""


def ingested(s: Source) -> tuple[str, DataFrame]:
    """The folder of a job to which the card arrives as one file for each third of the insurers, once more with an unknown RTO in
    it, and then all of it again as a replay; and the arrived files with their numbers."""
    from ratecraft.plans.ingest import DIMENSIONS

    arrived, folder = scratch(s), scratch(s)
    file = F.substring("insurance_company", 11, 2).cast("int") % 3
    rows = stage(upload(s).drop("line").withColumn("file", file))
    masters = {d: stage(rows.select(F.lower(d).alias("_k"), F.col(d).alias("name")).where("name <> ''").groupBy("_k").agg(F.min("name").alias("name")).select(F.abs(F.xxhash64("_k")).alias("id"), "name")) for d in DIMENSIONS}
    places = stage(rto_master(s)), stage(make_master(s))
    bad = rows.where("file = 0").withColumns({"file": F.lit(9), "new_rto_list": F.concat("new_rto_list", F.lit(", nowhere"))})
    kinds = ", ".join(f"{c} string" for c in rows.drop("file").columns) + ", file int"
    for uploads in (rows.unionByName(bad), rows):
        uploads.repartition("file").write.partitionBy("file").mode("append").parquet(arrived)
        ST_INGEST.run_ingest(ST_INGEST.rate_uploads(s.spark, arrived, kinds, form="parquet"), folder, lambda: (masters, *places))
    return folder, rows


@query("stream_rate_ingest", _ARRIVED + """SELECT new_rto_list, count(*) AS n, count(DISTINCT (insurance_company, new_vehicle_makes, product, fuel_type, is_ncb, from_date, to_date, pi_net_rate, cc_min, cc_max)) AS groups FROM rules GROUP BY 1""")
def stream_rate_ingest(s: Source) -> DataFrame:
    """Rate rows after three uploads, one to reject and a replay of all: as many rows and groups as one upload gives."""
    folder, rows = ingested(s)
    kind = M.typed_upload(rows.limit(0)).schema.simpleString()
    rates = ST_INGEST.ingested_rates(s.spark, folder, kind)
    return rates.groupBy("new_rto_list").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))


@query("stream_ingest_outcome", _ARRIVED + """, n AS (SELECT file, count(*) AS "rows" FROM rules GROUP BY 1)
SELECT file, true AS success, "rows", CAST(NULL AS STRING) AS problem, false AS replay FROM n UNION ALL SELECT file, true, 0, NULL, true FROM n
UNION ALL SELECT 9, false, 0, 'RTO ''nowhere'' does not exist in RTOMaster. Please add it first.', false WHERE EXISTS (SELECT 1 FROM n WHERE file = 0)""")
def stream_ingest_outcome(s: Source) -> DataFrame:
    """What became of each upload: the rows it brought, why it was rejected, nothing for a replay."""
    folder, _ = ingested(s)
    file = F.regexp_extract("upload_id", "file=([0-9]+)", 1).cast("int")
    done = ST_INGEST.ingest_outcomes(s.spark, folder).withColumn("file", file)
    return done.select("file", "success", "rows", "problem", (F.col("success") & (F.col("rows") == 0)).alias("replay"))


@query("stream_failure_counts", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, action AS status_key, count(*) AS n FROM audit GROUP BY 1, 2")
def stream_failure_counts(s: Source) -> DataFrame:
    out, checkpoint = scratch(s), scratch(s)
    failed = streamed(s, s.audit.select(F.col("ts").cast("timestamp").alias("uploaded_at"), F.col("action").alias("status_key")))
    counts = ST.failure_counts(failed, watermark="60 days")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # a batch writes only the counts it changed; the last one of a window holds
    rows = s.spark.read.parquet(out).groupBy("day", "status_key").agg(F.max_by("n", "batch").alias("n"))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "status_key", "n")
