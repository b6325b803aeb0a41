"""Policy files: the scan, and the typed columns the rule chains read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ratecraft import constants as K
from ratecraft.functions import dates as D, numbers as N, text as T
from ratecraft.operators import resolve as R
from ratecraft.session import stage

ROW_ID = "Original_Row_ID"


def find_column(df: DataFrame, wanted: str, ignore_case: bool = False) -> Column:
    """The column of that trimmed header; a NULL column where the file has none."""
    def key(name: str) -> str:
        return name.strip().lower() if ignore_case else name.strip()

    found = next((c for c in df.columns if key(c) == key(wanted)), None)
    return F.lit(None).cast("string") if found is None else F.col(f"`{found}`")


def number_rows(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Contiguous ids 0..n-1 in file order, for rows read straight from files.

    A row's address is its file, the start of the block it was read from, and its place there; blocks are counted and each adds
    what comes before it by path and start. Ids don't depend on how the scan was split, and the file is read once: rows are
    staged with their address. Nothing is sorted but the blocks, one row each.
    """
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    placed = stage(df.select("*", *block, F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_offset"))
    row = F.col("_offset") + F.col("_at") - F.col("_first")
    return placed.join(offsets, ["_file", "_start"]).withColumn(name, row).drop("_file", "_start", "_at", "_first", "_offset")


def read_policy_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV policy file, every cell as text, headers trimmed, rows numbered."""
    raw = number_rows(spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"'))
    return raw.toDF(*[c.strip() for c in raw.columns])


def policy_columns(df: DataFrame, key: str = ROW_ID, carry: tuple[str, ...] = ()) -> DataFrame:
    """A raw policy file as ``row_id`` plus the short text columns, tolerant of missing headers."""
    wanted = {**K.POLICY_FILE_COLUMNS, **K.PREMIUM_FILE_COLUMNS}
    cells = [find_column(df, header).alias(short) for short, header in wanted.items()]
    return df.select(F.col(key).cast("bigint").alias("row_id"), *[F.col(c) for c in carry], *cells)


def motor_features(policies: DataFrame, run_year: int) -> DataFrame:
    """Typed motor columns of short-named text policies. Text categories are lower case, '' where missing."""
    c = F.col

    def category(name: str) -> Column:
        return F.lower(F.coalesce(T.present(name), F.lit("")))

    vehproduct, sub_product = category("vehproduct"), category("sub_product")
    by_weight = vehproduct.isin(*K.WEIGHT_RATED_PRODUCTS)
    cc_raw = F.when(by_weight, T.strip("gvw")).otherwise(T.strip("cc"))
    is_new = sub_product.isin(*K.NEW_VEHICLE_SUB_PRODUCTS)
    make_model = F.lower(T.strip(F.concat(
        F.coalesce(T.present("make"), F.lit("")), F.lit(" "), F.coalesce(T.present("model"), F.lit("")))))
    combined = T.is_combined_cc_gvw(cc_raw)
    typed = {
        "insurer_raw": c("insurer"),
        "insurer_key": F.lower(T.present("insurer")),
        "vehproduct": vehproduct,
        "sub_product": sub_product,
        "fuel": category("fuel"),
        "vehicle_class": category("vehicle_class"),
        "cc_raw": cc_raw,
        "cc_label": F.when(by_weight, F.lit(K.GVW_LABEL)).otherwise(F.lit(K.CC_LABEL)),
        "cc_combined": combined,
        "cc": F.when(~combined, N.digits_number(cc_raw)),
        "seating": N.digits_number("seating"),
        "tariff": N.digits_number("tariff"),
        "vehicle_age": D.vehicle_age(c("registration"), c("inception"), is_new, run_year),
        "age_label": F.when(is_new, F.lit(K.INCEPTION_LABEL)).otherwise(F.lit(K.REGISTRATION_LABEL)),
        "inception": D.policy_date("inception"),
        "make_model": make_model,
        "rto_raw": T.strip("rto"),
        "rto": F.lower(T.normalize_rto_code("rto")),
        "ncb": N.plain_number("ncb"),
        "cpa": N.plain_number("cpa"),
        "nil_dep": F.upper(T.present("nil_dep")),
        "zd": T.nil_dep_class("nil_dep"),
    }
    amounts = {"ncb_cell": c("ncb"), "total_od_cell": c("total_od"), "tp_premium_cell": c("tp_premium")}
    return policies.select("row_id", *[v.alias(k) for k, v in {**typed, **amounts}.items()])


def health_features(policies: DataFrame) -> DataFrame:
    """Typed health columns of short-named text policies."""
    def category(name: str) -> Column:
        return F.lower(F.coalesce(T.present(name), F.lit("")))

    business = F.coalesce(T.fold_business_type(T.present("policy_type")), F.lit(""))
    inception, expiry = D.policy_date("inception"), D.policy_date("expiry")
    typed = {
        "insurer_raw": F.col("insurer"),
        "insurer_key": F.lower(T.present("insurer")),
        "product_name": category("product_name"),
        "policy_category": category("policy_category"),
        "business_type": business,
        "plan_name": F.coalesce(T.present("plan_name"), F.lit("")),
        "deductible": N.digits_number("deductible"),
        "sum_assured": N.digits_number("sum_assured"),
        "age": N.digits_number("age"),
        "pincode": T.normalize_pincode("pin_code"),
        "inception": inception,
        "tenure": D.tenure_years(inception, expiry),
    }
    return policies.select("row_id", *[v.alias(k) for k, v in typed.items()])


def with_insurer(features: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``insurer``, the resolved rate-card insurer, NULL where none is close enough.

    ``names`` comes from :func:`insurer_names` over the same features.
    """
    return features.join(names.select(F.col("source").alias("insurer_key"), "insurer"), "insurer_key", "left")


def insurer_names(features: DataFrame, rates: DataFrame) -> DataFrame:
    return R.resolve_insurers(
        features.select(F.col("insurer_key").alias("name")), rates.select(F.col("r_insurer").alias("name"))
    )


def with_names(features: DataFrame, value: str, out: str, resolved: DataFrame) -> DataFrame:
    """Adds ``out``, the sorted master names a value resolves to; empty where none."""
    names = R.name_arrays(resolved).select(F.lower("term").alias(value), F.col("names").alias(out))
    empty = F.array().cast("array<string>")
    return features.join(names, value, "left").withColumn(out, F.coalesce(out, empty))
