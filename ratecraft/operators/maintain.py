"""Duplicates, regrouping, upserts, bulk changes and retention. Pure functions: old frame in, new frame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, numbers as N, text as T
from ratecraft.functions.predicates import group_key

CODE_FIELDS = ["is_ncb", "is_cpa", "is_zd"]
NUMBER_FIELDS = [
    "vehicle_age_min", "vehicle_age_max", "pi_od_rate", "pi_tp_rate", "pi_tp_2", "pi_tp_3", "pi_tp_4", "pi_tp_5",
    "pi_net_rate", "pi_flat_amount", "pi_vli", "tariff_min", "tariff_max", "cc_min", "cc_max", "sc_min", "sc_max",
    "po_od_rate", "po_tp_rate", "po_net_rate", "po_flat_amount",
]
TEXT_FIELDS = [
    "new_vehicle_makes", "insurer_vertical", "product", "sub_product", "policy_type", "make_model_class", "fuel_type",
    "pi_type", "veh_use", "add_tnc", "remarks", "po_type",
]
EDITABLE = [*TEXT_FIELDS, *NUMBER_FIELDS, *CODE_FIELDS, "status", "is_deleted", "user_id", "from_date", "to_date", "insurance_company"]
HEALTH_NUMBERS = [
    "min_deductible", "max_deductible", "min_sum_insured", "max_sum_insured", "min_age", "max_age",
]
HEALTH_PERCENTS = ["payin_rate", *K.TENURE_RATES]
HEALTH_TEXT = ["insurance_company", "product_name", "policy_category", "plan_names", "business_type", "pincode_zone"]


# ---- identity -------------------------------------------------------------------------------------
def field_text(df: DataFrame, field: str, blank: str) -> Column:
    """A field as it enters a hash: trimmed lower-case text, numbers with a decimal point, ISO dates."""
    kind = dict(df.dtypes).get(field)
    c = F.col(field) if kind else F.lit(None).cast("string")
    if kind in ("double", "float"):
        c = F.when(c.isNotNull(), N.number_text(c))
    return F.lower(T.strip(F.coalesce(c.cast("string"), F.lit(blank))))


def key_text(df: DataFrame, fields: list[str] | None = None) -> Column:
    return F.concat_ws("|", *[field_text(df, f, "") for f in fields or K.GROUP_FIELDS])


def group_hash(df: DataFrame) -> Column:
    return F.sha2(key_text(df), 256)


def health_hash(df: DataFrame) -> Column:
    """Identity of a health rule; here a missing field enters as the text ``none``."""
    return F.sha2(F.concat_ws("|", *[field_text(df, f, "none") for f in K.HEALTH_HASH_FIELDS]), 256)


def content_hash(df: DataFrame, fields: list[str]) -> Column:
    """Digest of exact content; NULL equals NULL and differs from ''."""
    cells = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")) if f in df.columns else F.lit("\x00") for f in fields]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


# ---- duplicates -----------------------------------------------------------------------------------
def _grouped_live(rates: DataFrame, cross_group: bool, status: str) -> DataFrame:
    rows = rates.where("is_deleted = 'NO' AND group_id IS NOT NULL")
    if cross_group:
        rows = rows.where(F.col("status") == status)
    return rows.withColumn("_content", content_hash(rows, K.CONTENT_FIELDS)).withColumn(
        "_scope", F.lit(0).cast("bigint") if cross_group else F.col("group_id").cast("bigint")
    )


def duplicate_clusters(rates: DataFrame, cross_group: bool = False, status: str = "ACTIVE") -> DataFrame:
    """One row per set of identical rows: how many are extra, the id that stays, how many groups are involved.

    Members of a set are listed by :func:`duplicate_rows`; a set may hold most of the table, so it is never one value.
    """
    rows = _grouped_live(rates, cross_group, status)
    per_group = rows.groupBy("_scope", "_content", "group_id").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    return (
        per_group.groupBy("_scope", "_content")
        .agg((F.sum("n") - 1).alias("extra_rows"), F.min("low").alias("keep_id"), F.count("*").alias("group_count"),
             F.min("group_id").alias("first_group_id"))
        .where("extra_rows > 0")
        .select("keep_id", "extra_rows", "group_count", "first_group_id")
    )


def duplicate_rows(rates: DataFrame, cross_group: bool = False, status: str = "ACTIVE") -> DataFrame:
    """(id, keep_id): every extra copy and the row that stays. The join key is skewed where copies are; the kept side
    has one row per key, so adaptive execution splits the copies."""
    rows = _grouped_live(rates, cross_group, status).select("id", "_scope", "_content")
    keep = rows.groupBy("_scope", "_content").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(keep, ["_scope", "_content"]).where("id > keep_id").select("id", "keep_id")


def soft_delete_duplicates(rates: DataFrame, cross_group: bool = False, status: str = "ACTIVE") -> DataFrame:
    drop = duplicate_rows(rates, cross_group, status).select("id", F.lit(True).alias("_drop"))
    return rates.join(drop, "id", "left").withColumn(
        "is_deleted", F.when(F.col("_drop"), F.lit("YES")).otherwise(F.col("is_deleted"))
    ).drop("_drop")


def first_in_file(rows: DataFrame, hash_column: str, order: str) -> DataFrame:
    """The first row of every identity in a file."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(hash_column).agg(F.min_by(row, order).alias("_row")).select("_row.*")


# ---- regroup --------------------------------------------------------------------------------------
def regroup_plan(rates: DataFrame) -> DataFrame:
    """(new_hash, owner): which group id each recomputed hash keeps; NULL for a hash that needs a new group.

    A group that splits keeps its id on the largest piece (ties: smaller hash). Groups that converge on one hash merge
    into the one with most rows (ties: lower id).
    """
    rows = rates.select("id", "group_id", group_hash(rates).alias("new_hash"))
    # Size of a hash counts all its rows, whatever group they are in now.
    sizes = rows.groupBy("new_hash").agg(F.count("*").alias("hash_rows"))
    members = rows.where("group_id IS NOT NULL").groupBy("group_id", "new_hash").agg(F.count("*").alias("n"))
    claims = members.join(sizes, "new_hash").groupBy("group_id").agg(
        F.min_by("new_hash", F.struct(-F.col("hash_rows"), F.col("new_hash"))).alias("new_hash"),
        F.sum("n").alias("group_rows"),
    )
    owners = claims.groupBy("new_hash").agg(
        F.min_by("group_id", F.struct(-F.col("group_rows"), F.col("group_id"))).alias("owner")
    )
    return sizes.join(owners, "new_hash", "left").select("new_hash", "owner", "hash_rows")


def number_new_hashes(hashes: DataFrame, last_id: Column) -> DataFrame:
    """(new_hash, group_id): ids after ``last_id`` for new hashes, in hash order, without sorting them in one task.

    Hashes are spread over 256 ranges by their first byte; the ranges' sizes give each its offset.
    """
    spread = hashes.select("new_hash", F.substring("new_hash", 1, 2).alias("_range"))
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("new_hash"))
    return spread.withColumn("_place", place).join(offsets, "_range").select(
        "new_hash", (last_id + F.col("_offset") + F.col("_place")).alias("group_id")
    )


def with_last_id(frame: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``_last``, the highest group id so far (a one-row aggregate)."""
    last = groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).cast("bigint").alias("_last")).withColumn("_one", F.lit(1))
    return frame.withColumn("_one", F.lit(1)).join(last, "_one").drop("_one")


def regroup(rates: DataFrame) -> DataFrame:
    """(id, old_group_id, new_group_id) of every row under the recomputed grouping."""
    plan = regroup_plan(rates)
    numbered = number_new_hashes(plan.where("owner IS NULL"), F.lit(0))
    numbered = with_last_id(numbered, rates).select("new_hash", (F.col("group_id") + F.col("_last")).alias("created"))
    target = plan.join(numbered, "new_hash", "left").select("new_hash", F.coalesce("owner", "created").alias("new_group_id"))
    rows = rates.select("id", F.col("group_id").alias("old_group_id"), group_hash(rates).alias("new_hash"))
    return rows.join(target, "new_hash").select("id", "old_group_id", "new_group_id")


def regroup_report(rates: DataFrame) -> DataFrame:
    """One row: scanned, existing groups, kept, splitting, merged away, created, reassigned."""
    rows = rates.select("group_id", group_hash(rates).alias("new_hash"))
    per_group = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count_distinct("new_hash").alias("pieces"))
    plan = regroup_plan(rates)
    parts = [
        rows.agg(F.count("*").alias("scanned_rows"), F.count_if(F.col("group_id").isNull()).alias("ungrouped_rows")),
        per_group.agg(F.count("*").alias("existing_groups"), F.count_if(F.col("pieces") > 1).alias("splitting_groups")),
        plan.agg(
            F.count_if(F.col("owner").isNotNull()).alias("groups_kept"), F.count_if(F.col("owner").isNull()).alias("groups_created"),
            F.coalesce(F.sum(F.when(F.col("owner").isNull(), F.col("hash_rows"))), F.lit(0)).alias("rows_reassigned"),
        ),
    ]
    one = [p.withColumn("_one", F.lit(1)) for p in parts]
    joined = reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")
    # An existing group that owns no hash was merged into another.
    return joined.withColumn("groups_retired", F.col("existing_groups") - F.col("groups_kept"))


# ---- masters --------------------------------------------------------------------------------------
def upsert_master(master: DataFrame, upload: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Master with an upload applied: the last row of a name wins, an existing name keeps its spelling.

    ``upload`` has ``line``, ``name`` and ``cluster``; blank names must have been rejected (see ``blank_names``).
    """
    def key(c: str) -> Column:
        return F.lower(T.strip(c)) if ignore_case else T.strip(c)

    clean = upload.select(key("name").alias("_key"), T.strip("name").alias("name"), T.none_if_empty(T.strip("cluster")).alias("cluster"), "line")
    last = clean.groupBy("_key").agg(
        F.max_by(F.struct("cluster"), "line").alias("_new"), F.min_by("name", "line").alias("_name")
    )
    old = master.select(key("name").alias("_key"), F.col("name").alias("_old_name"), F.col("cluster").alias("_old_cluster"))
    both = old.join(last, "_key", "full_outer")
    return both.select(
        F.coalesce("_old_name", "_name").alias("name"),
        F.when(F.col("_new").isNotNull(), F.col("_new.cluster")).otherwise(F.col("_old_cluster")).alias("cluster"),
    )


def blank_names(upload: DataFrame) -> DataFrame:
    return upload.where(T.strip(F.coalesce("name", F.lit(""))) == "")


def missing_zones(health_rates: DataFrame, pincode_master: DataFrame) -> DataFrame:
    """Zones live health rates use and the master lacks."""
    used = health_rates.where("coalesce(is_deleted, 'NO') <> 'YES' AND coalesce(pincode_zone, '') <> ''")
    return used.select(F.col("pincode_zone").alias("name")).distinct().join(pincode_master.select("name"), "name", "left_anti")


def sync_zones(health_rates: DataFrame, pincode_master: DataFrame) -> DataFrame:
    fresh = missing_zones(health_rates, pincode_master).withColumn("cluster", F.lit(None).cast("string"))
    return pincode_master.select("name", "cluster").unionByName(fresh)


# ---- rate ingest ----------------------------------------------------------------------------------
def typed_upload(upload: DataFrame) -> DataFrame:
    """All-text upload rows as typed rates: missing numbers 0, new rows INACTIVE and not deleted; ``line`` and ``upload_id`` stay."""
    def blank_to_null(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))

    zero = F.lit(0.0)
    typed = upload.select(
        *[c for c in ("line", "upload_id") if c in upload.columns],
        F.col("upload_batch_id").alias("upload_batch"),
        T.strip(F.coalesce("insurance_company", F.lit(""))).alias("insurance_company"),
        blank_to_null("new_rto_list").alias("new_rto_list"),
        *[blank_to_null(c).alias(c) for c in TEXT_FIELDS],
        *[F.coalesce(T.present(c).try_cast("double"), zero).alias(c) for c in NUMBER_FIELDS],
        *[T.parse_yes_no_na(c).alias(c) for c in CODE_FIELDS],
        D.upload_date("from_date").alias("from_date"), D.upload_date("to_date").alias("to_date"),
        T.present("user_id").try_cast("double").cast("bigint").alias("user_id"),
        F.lit("INACTIVE").alias("status"), F.lit("NO").alias("is_deleted"),
    )
    return typed.withColumn("key_hash", group_hash(typed))


def unknown_members(upload: DataFrame, rto_master: DataFrame, make_master: DataFrame, keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """(line, field, item): RTO and make names that no master has. An upload with any is rejected as a whole.

    ``keys`` are the columns that name a row, ``line`` alone where there is one upload.
    """
    parts = []
    for column, master in (("new_rto_list", rto_master), ("new_vehicle_makes", make_master)):
        items = upload.select(*keys, F.lit(column).alias("field"), F.explode(C.split_list(column)).alias("item"))
        known = master.select(F.lower("name").alias("_key")).distinct()
        parts.append(items.withColumn("_key", F.lower("item")).join(known, "_key", "left_anti").drop("_key"))
    return parts[0].unionByName(parts[1])


def unreadable_numbers(upload: DataFrame, keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """(line, field, cell): filled number cells that are no number; ``keys`` as in :func:`unknown_members`."""
    cells = F.array_compact(F.array(*[
        F.when(T.present(c).isNotNull() & T.present(c).try_cast("double").isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("cell")))
        for c in NUMBER_FIELDS
    ]))
    return upload.select(*keys, F.inline(cells))


def new_rates(typed: DataFrame, existing: DataFrame) -> DataFrame:
    """Upload rows to insert: not already live with the same content, and one per (group hash, RTO list).

    ``existing`` is the rate table with ``key_hash`` of its groups; replayed rows fall to the second test.
    """
    live = existing.where("status = 'ACTIVE' AND is_deleted = 'NO'")
    seen = live.select(content_hash(live, K.LIVE_CONTENT_FIELDS).alias("_content")).distinct()
    fresh = typed.withColumn("_content", content_hash(typed, K.LIVE_CONTENT_FIELDS)).join(seen, "_content", "left_anti")
    rto = F.coalesce("new_rto_list", F.lit("\x00"))
    fresh = fresh.withColumn("_rto", rto)
    present = existing.select("key_hash", rto.alias("_rto")).distinct()
    fresh = fresh.join(present, ["key_hash", "_rto"], "left_anti").drop("_content")
    order = F.col("line") if "line" in fresh.columns else F.lit(0)
    first = F.row_number().over(Window.partitionBy("key_hash", "_rto").orderBy(order))
    return fresh.withColumn("_place", first).where("_place = 1").drop("_place", "_rto")


def assign_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with ``group_id``: the id of a known hash, new ids after the highest for the others.

    ``groups`` has ``group_id`` and ``key_hash``.
    """
    known = groups.select("key_hash", "group_id")
    unknown = rows.select("key_hash").distinct().join(known, "key_hash", "left_anti").withColumnRenamed("key_hash", "new_hash")
    created = with_last_id(number_new_hashes(unknown, F.lit(0)), groups).select(
        F.col("new_hash").alias("key_hash"), (F.col("group_id") + F.col("_last")).alias("group_id")
    )
    return rows.join(known.unionByName(created), "key_hash")


# ---- health upsert --------------------------------------------------------------------------------
def typed_health_upload(upload: DataFrame) -> DataFrame:
    typed = upload.select(
        "line",
        *[T.none_if_empty(T.strip(c)).alias(c) for c in HEALTH_TEXT],
        *[N.parse_number(c).alias(c) for c in HEALTH_NUMBERS],
        *[N.parse_percent(c).alias(c) for c in HEALTH_PERCENTS],
        D.grid_date("from_date").alias("from_date"), D.grid_date("to_date").alias("to_date"),
        *[T.none_if_empty(F.upper(T.strip(c))).alias(c) for c in ("status", "is_deleted")],
        T.none_if_empty(T.strip("remarks")).alias("remarks"),
    )
    return typed.withColumn("source_row_hash", health_hash(typed))


def invalid_health_rows(typed: DataFrame) -> DataFrame:
    problem = (
        F.when(F.col("insurance_company").isNull(), F.lit("insurance_company is blank"))
        .when(~F.col("status").isin("ACTIVE", "INACTIVE"), F.concat(F.lit("'"), F.col("status"), F.lit("' is not a valid Status (ACTIVE or INACTIVE).")))
        .when(~F.col("is_deleted").isin("YES", "NO"), F.concat(F.lit("'"), F.col("is_deleted"), F.lit("' is not a valid Is Deleted value (YES or NO).")))
    )
    return typed.select("line", problem.alias("problem")).where("problem IS NOT NULL")


def upsert_health(existing: DataFrame, typed: DataFrame) -> DataFrame:
    """Health rates with an upload applied by identity.

    Rates always take the upload's value; status, deletion flag and remarks only where the upload has one. A rule that
    is new starts ACTIVE and not deleted.
    """
    optional = {"status": "ACTIVE", "is_deleted": "NO", "remarks": None}
    rates = [*HEALTH_TEXT, *HEALTH_NUMBERS, *HEALTH_PERCENTS, "from_date", "to_date"]
    # Later rows of one identity win; an optional field keeps the last value that was given at all.
    last = typed.groupBy("source_row_hash").agg(
        F.max_by(F.struct(*rates), "line").alias("_rates"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(f"_{c}") for c in optional],
    )
    both = existing.join(last, "source_row_hash", "full_outer")
    given = F.col("_rates").isNotNull()
    is_new = F.col("id").isNull()
    return both.select(
        "id", "source_row_hash",
        *[F.when(given, F.col(f"_rates.{c}")).otherwise(F.col(c)).alias(c) for c in rates],
        *[F.coalesce(F.col(f"_{c}"), F.when(is_new, F.lit(default)).otherwise(F.col(c))).alias(c) for c, default in optional.items()],
    )


# ---- bulk changes ---------------------------------------------------------------------------------
def _typed_value(field: str, text: str) -> Column:
    """A new value in the field's type; raises for a value outside the field's domain."""
    text = text.strip()
    domains = {"status": ("ACTIVE", "INACTIVE"), "is_deleted": ("YES", "NO")}
    if field in domains:
        if text.upper() not in domains[field]:
            raise ValueError(f"'{text}' is not a valid {field} (must be one of: {', '.join(domains[field])})")
        return F.lit(text.upper())
    if field in CODE_FIELDS:
        return T.parse_yes_no_na(F.lit(text))
    if field in NUMBER_FIELDS:
        number = float(text) if text else None
        if number is not None and field in K.RATE_FIELDS_2DP:
            number = round(number, 2)
        return F.lit(number).cast("double")
    if field == "user_id":
        return F.lit(int(float(text)) if text else None).cast("bigint")
    if field in ("from_date", "to_date"):
        return F.to_date(F.lit(text or None).cast("string"))
    return F.lit(text or None).cast("string")


def bulk_update(rates: DataFrame, keys: DataFrame, field: str, text: str) -> DataFrame:
    """Sets an allow-listed field on the rows behind selected keys. A key is a group id first, a row id only where no
    group has it. ``keys`` has ``wanted``."""
    if field not in EDITABLE:
        raise ValueError(f"'{field}' is not an editable field")
    value = _typed_value(field, text)
    wanted = keys.select(F.col("wanted").cast("bigint").alias("wanted")).distinct()
    groups = wanted.join(rates.select("group_id"), F.col("wanted") == F.col("group_id"), "left_semi")
    loose = wanted.join(groups, "wanted", "left_anti")
    marked = rates.join(groups.select(F.col("wanted").alias("group_id"), F.lit(True).alias("_by_group")), "group_id", "left")
    marked = marked.join(loose.select(F.col("wanted").alias("id"), F.lit(True).alias("_by_id")), "id", "left")
    hit = F.coalesce("_by_group", "_by_id").isNotNull()
    return marked.withColumn(field, F.when(hit, value).otherwise(F.col(field))).drop("_by_group", "_by_id").select(*rates.columns)


def selected_rows(rates: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct ``id`` of the rows behind selected keys, resolved as in :func:`bulk_update`."""
    wanted = keys.select(F.col("wanted").cast("bigint").alias("wanted")).distinct()
    by_group = rates.join(wanted, F.col("wanted") == F.col("group_id"), "left_semi").select("id")
    loose = wanted.join(rates.select("group_id"), F.col("wanted") == F.col("group_id"), "left_anti")
    return by_group.unionByName(rates.join(loose, F.col("wanted") == F.col("id"), "left_semi").select("id")).distinct()


def set_field(rates: DataFrame, ids: DataFrame, field: str, text: str) -> DataFrame:
    """Sets an allow-listed field on the rows of given ids."""
    if field not in EDITABLE:
        raise ValueError(f"'{field}' is not an editable field")
    marked = rates.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    return marked.withColumn(field, F.when(F.col("_hit"), _typed_value(field, text)).otherwise(F.col(field))).select(*rates.columns)


def bulk_update_health(rates: DataFrame, ids: DataFrame, field: str, text: str) -> DataFrame:
    """Same for health rates, by row id. ``ids`` has ``id``."""
    if field in HEALTH_NUMBERS or field in HEALTH_PERCENTS:
        value = F.lit(float(text) if text.strip() else None).cast("double")
    elif field in (*HEALTH_TEXT, "status", "is_deleted", "remarks", "from_date", "to_date"):
        value = _typed_value(field, text)
    else:
        raise ValueError(f"'{field}' is not an editable field")
    marked = rates.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn(field, F.when(F.col("_hit"), value).otherwise(F.col(field))).drop("_hit").select(*rates.columns)


def deactivate_groups(rates: DataFrame, requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sets ACTIVE rows of requested groups INACTIVE. ``requests`` has ``group_key``; a request counts only where the
    latest scan's ``pairs`` list the group, and not for double-rate risks, whose cause is a master."""
    listed = pairs.where("conflict_type <> 'DOUBLE_RATE_RISK'").select(F.explode(F.array("group_key_a", "group_key_b")).alias("group_key"))
    allowed = requests.select("group_key").distinct().join(listed.distinct(), "group_key", "left_semi")
    keyed = rates.withColumn("group_key", group_key()).join(allowed.withColumn("_hit", F.lit(True)), "group_key", "left")
    hit = F.col("_hit") & (F.col("status") == "ACTIVE") & (F.col("is_deleted") == "NO")
    return keyed.withColumn("status", F.when(hit, F.lit("INACTIVE")).otherwise(F.col("status"))).select(*rates.columns)


def purge_deleted(rates: DataFrame) -> DataFrame:
    return rates.where("is_deleted IS NULL OR is_deleted <> 'YES'")


# ---- retention ------------------------------------------------------------------------------------
def retained_log(log: DataFrame, now: Column, days: int = K.LOG_RETENTION_DAYS) -> DataFrame:
    """Log without the expired entries of the two retained action sets; other actions are kept for good."""
    actions = F.col("action").isin(*K.POINTS_SEARCH_ACTIONS, *K.SECURITY_ACTIONS)
    return log.where(~actions | (F.col("ts") >= now - F.make_dt_interval(F.lit(days))))


def retention_start(today: Column, months: int) -> Column:
    """First day of the oldest month that stays active."""
    return F.add_months(F.trunc(today, "month"), -(months - 1))


def split_retention(documents: DataFrame, today: Column, months: int) -> tuple[DataFrame, DataFrame]:
    """(active, expired); expired rows carry their month."""
    start = retention_start(today, months)
    expired = documents.where(F.col("uploaded_date") < start).withColumn("month", F.date_format("uploaded_date", "yyyy-MM"))
    return documents.where(F.col("uploaded_date") >= start), expired


def manifest(expired: DataFrame) -> DataFrame:
    """Per month: rows, bytes, and an order-free checksum that a written archive can be verified against."""
    digest = F.xxhash64(*[F.col(c) for c in expired.columns])
    return expired.groupBy("month").agg(
        F.count("*").alias("documents"), F.count_if(F.col("file_key") != "").alias("files"),
        F.coalesce(F.sum(F.when(F.col("file_key") != "", F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.sum(digest.cast("decimal(38,0)")).alias("checksum"),
    )


def verified_months(expired: DataFrame, archived: DataFrame) -> DataFrame:
    """Months whose archive agrees with what was to be archived; only these may be purged."""
    a, b = manifest(expired), manifest(archived.select(*expired.columns))
    same = (F.col("a.documents") == F.col("b.documents")) & (F.col("a.checksum") == F.col("b.checksum"))
    return a.alias("a").join(b.alias("b"), "month").where(same).select("month")


def restorable(entries: DataFrame, active: DataFrame) -> DataFrame:
    """Archived documents that are not active: the latest manifest entry of each key. ``entries`` has ``manifest_no``."""
    with_file = entries.where("coalesce(file_key, '') <> ''")
    row = F.struct(*[F.col(c) for c in entries.columns])
    newest = with_file.groupBy("file_key").agg(F.max_by(row, F.struct("manifest_no", "id")).alias("_row")).select("_row.*")
    return newest.join(active.select("file_key").distinct(), "file_key", "left_anti")


def orphans(files: DataFrame, documents: DataFrame, since: Column, before: Column) -> DataFrame:
    """Stored files no document points at, inside the window and old enough. ``files`` has ``file_key``, ``modified``."""
    unknown = files.join(documents.select("file_key").distinct(), "file_key", "left_anti")
    return unknown.where((F.col("modified") >= since) & (F.col("modified") <= before))


def guess_insurers(files: DataFrame, insurers: DataFrame) -> DataFrame:
    """(file_key, insurer): the only insurer whose distinctive words all occur in the file name.

    Files and insurers meet on one word, so an insurer is only tried on files that hold its first word.
    """
    named = files.select("file_key", T.file_name_words("file_key").alias("words"))
    wanted = insurers.select("insurer", F.array_sort(F.array_except(T.file_name_words("insurer"), T.literal_array(K.FILE_NAME_STOP_WORDS))).alias("needs"))
    wanted = wanted.where(F.size("needs") > 0).withColumn("word", F.element_at("needs", 1))
    met = named.withColumn("word", F.explode("words")).join(wanted, "word")
    fits = met.where(F.size(F.array_except("needs", "words")) == 0)
    only = fits.groupBy("file_key").agg(F.count("*").alias("n"), F.min("insurer").alias("insurer")).where("n = 1")
    return files.select("file_key").join(only.select("file_key", "insurer"), "file_key", "left")


# ---- spelling mappings ----------------------------------------------------------------------------
def mapping_problems(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, value, problem) of a batch of spelling mappings; an empty frame means it may be loaded.

    ``batch`` has ``mapping_id`` (NULL for a new mapping), ``name`` and ``value``; ``existing`` has ``mapping_id``,
    ``mapping_name`` and ``value``.
    """
    rows = mapping_rows(batch)
    comma = rows.where(F.contains("value", F.lit(","))).select("name", "value", F.lit("contains a comma").alias("problem"))
    lonely = rows.groupBy("name").agg(F.count_distinct("value").alias("n")).where("n < 2").select(
        "name", F.col("name").alias("value"), F.lit("needs another spelling").alias("problem"))
    several = rows.groupBy("value").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).where("n > 1").select(
        "name", "value", F.lit("is in several mappings of the batch").alias("problem"))
    old = existing.select(F.col("mapping_id").alias("_old_id"), "mapping_name", F.upper(T.strip("value")).alias("value"))
    taken = rows.join(old, "value").where("mapping_id IS NULL OR mapping_id <> _old_id").select(
        "name", "value", F.concat(F.lit('is already mapped under "'), F.col("mapping_name"), F.lit('"')).alias("problem")).distinct()
    return reduce(lambda a, b: a.unionByName(b), [comma, lonely, several, taken])


def mapping_rows(batch: DataFrame) -> DataFrame:
    """(mapping_id, name, value): upper-case spellings; the name is always one of them."""
    upper = batch.select("mapping_id", F.upper(T.strip("name")).alias("name"), F.upper(T.strip("value")).alias("value"))
    own = upper.select("mapping_id", "name", F.col("name").alias("value"))
    return upper.unionByName(own).where("name <> '' AND value <> ''").distinct()


def mapping_changes(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(mapping_id, value, change): spellings a batch adds to or removes from mappings it updates."""
    new = mapping_rows(batch).where("mapping_id IS NOT NULL").select("mapping_id", "value").distinct()
    touched = new.select("mapping_id").distinct()
    old = existing.select("mapping_id", F.upper(T.strip("value")).alias("value")).distinct().join(touched, "mapping_id", "left_semi")
    added = new.join(old, ["mapping_id", "value"], "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new, ["mapping_id", "value"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)
