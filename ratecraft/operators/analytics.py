"""Heatmap, pivots, roll-ups and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft import constants as K
from ratecraft.functions import clusters as C, dates as D, text as T
from ratecraft.operators.resolve import cluster_long
from ratecraft.sources.rates import group_key

HEAT_RATES = {
    "net": "pi_net_rate", "od": "pi_od_rate", "tp": "pi_tp_rate", "tp2": "pi_tp_2", "tp3": "pi_tp_3", "tp4": "pi_tp_4",
    "tp5": "pi_tp_5",
}
HEAT_RANGES = {"age": "vehicle_age", "cc": "cc", "tariff": "tariff"}
HEAT_CODES = {"ncb": "is_ncb", "cpa": "is_cpa", "zd": "is_zd"}
CELL = ["product", "sub_product", "insurer", "state", "month"]


# ---- heatmap --------------------------------------------------------------------------------------
def rto_states(rto_master: DataFrame) -> DataFrame:
    """(rto, state): the states behind an RTO group, from the first letters of its codes."""
    codes = cluster_long(rto_master).where(F.length("item") >= 2)
    return codes.select("name", T.state_code("item").alias("state")).where("state IS NOT NULL").distinct()


def rate_cells(rates: DataFrame, rto_master: DataFrame) -> DataFrame:
    """(id, state, month): every state of the row's RTO groups with every month its labels carry, once per row."""
    labels = rates.select("id", F.explode(C.upper_items("new_rto_list")).alias("label"))
    states = labels.join(rto_states(rto_master).select(F.upper("name").alias("label"), "state"), "label")
    months = labels.select("id", T.month_token("label").alias("month")).distinct()
    return states.select("id", "state").distinct().join(months, "id")


def heatmap(rates: DataFrame, rto_master: DataFrame) -> DataFrame:
    """Per product, sub product, insurer, state and month: count and range of every positive pay-in rate, the widest
    ranges, and the codes in use. Cells without a rate are dropped. Rates must already be filtered."""
    other = F.lit("Uncategorized")
    cells = rates.join(rate_cells(rates, rto_master), "id").select(
        "*", F.coalesce(T.none_if_empty(F.col("product")), other).alias("p"),
        F.coalesce(T.none_if_empty(F.col("sub_product")), other).alias("sp"),
    )
    measures = []
    for key, column in HEAT_RATES.items():
        positive = F.when(F.col(column) > 0, F.col(column))
        measures += [
            F.count(positive).alias(f"{key}_n"), F.round(F.min(positive), 2).alias(f"{key}_min"),
            F.round(F.max(positive), 2).alias(f"{key}_max"),
        ]
    for key, column in HEAT_RANGES.items():
        low, high = F.col(f"{column}_min"), F.col(f"{column}_max")
        measures += [F.min(F.least(low, high)).alias(f"{key}_min"), F.max(F.greatest(low, high)).alias(f"{key}_max")]
    for key, column in HEAT_CODES.items():
        measures.append(F.array_sort(F.collect_set(T.none_if_empty(F.col(column)))).alias(key))
    grouped = cells.groupBy(
        F.col("p").alias("product"), F.col("sp").alias("sub_product"), F.col("insurance_company").alias("insurer"),
        "state", "month",
    ).agg(*measures)
    total = reduce(lambda a, b: a + b, [F.col(f"{k}_n") for k in HEAT_RATES])
    return grouped.withColumn("total_n", total).where("total_n > 0")


def merge_months(cells: DataFrame) -> DataFrame:
    """Cells of all months as one: widest ranges, summed counts, union of codes; and the best range over all rates."""
    measures = []
    for key in HEAT_RATES:
        measures += [F.sum(f"{key}_n").alias(f"{key}_n"), F.min(f"{key}_min").alias(f"{key}_min"), F.max(f"{key}_max").alias(f"{key}_max")]
    for key in HEAT_RANGES:
        measures += [F.min(f"{key}_min").alias(f"{key}_min"), F.max(f"{key}_max").alias(f"{key}_max")]
    measures += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))).alias(k) for k in HEAT_CODES]
    merged = cells.groupBy("product", "sub_product", "insurer", "state").agg(*measures, F.sum("total_n").alias("total_n"))
    return merged.withColumn("best_min", F.least(*[F.col(f"{k}_min") for k in HEAT_RATES])).withColumn(
        "best_max", F.greatest(*[F.col(f"{k}_max") for k in HEAT_RATES])
    )


def colour_buckets(merged: DataFrame) -> DataFrame:
    """Adds ``bucket`` 0-5, the place of a cell's best rate between the lowest and highest of its product view."""
    view = ["product", "sub_product"]
    span = merged.groupBy(*view).agg(F.min("best_max").alias("_low"), F.max("best_max").alias("_high"))
    place = F.floor((F.col("best_max") - F.col("_low")) / (F.col("_high") - F.col("_low")) * 6)
    bucket = F.when(F.col("_high") == F.col("_low"), F.lit(3)).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), place)))
    return merged.join(span, view).withColumn("bucket", bucket.cast("int")).drop("_low", "_high")


def insurer_ranking(merged: DataFrame) -> DataFrame:
    """Insurers of each product view by the mean of their best rates over states."""
    return merged.groupBy("product", "sub_product", "insurer").agg(
        F.avg("best_max").alias("mean_top_rate"), F.count("*").alias("states")
    )


def default_state(merged: DataFrame) -> DataFrame:
    """Per product view the state most insurers have a rate in; ties go to the first in the alphabet."""
    counts = merged.groupBy("product", "sub_product", "state").agg(F.count("*").alias("insurers"))
    return counts.groupBy("product", "sub_product").agg(
        F.min_by("state", F.struct(-F.col("insurers"), F.col("state"))).alias("state"), F.max("insurers").alias("insurers")
    )


def volumes(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy(by).agg(F.sum("total_n").alias("volume"))


def months_seen(rates: DataFrame, rto_master: DataFrame) -> DataFrame:
    """Months in chronological order with their label; evergreen is not a month."""
    months = rate_cells(rates, rto_master).select("month").distinct().where(F.col("month") != K.EVERGREEN)
    return months.select("month", T.month_label("month").alias("label"), T.month_order("month").alias("position"))


# ---- roll-ups -------------------------------------------------------------------------------------
def grid_summary(rates: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Distinct grids per product, sub product, insurer, validity window and status."""
    live = rates.where("is_deleted = 'NO'")
    if as_of is not None:
        live = live.where(D.valid_on(as_of))
    by = ["product", "sub_product", "insurance_company", "from_date", "to_date", "status"]
    return live.groupBy(*by).agg(F.count_distinct(group_key()).alias("grid_count"))


def status_counts(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("status") == "INACTIVE").alias("inactive")
    )


def home_kpis(register: DataFrame) -> DataFrame:
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    motor = filled("vehicle_registration_number") | filled("vehicle_make")
    return register.agg(
        F.count("*").alias("cases"), F.coalesce(F.sum("gross_premium"), F.lit(0)).alias("premium"),
        F.count_if(motor).alias("motor"), F.count_if(~motor).alias("health"),
    )


def register_stats(register: DataFrame, **contains: str) -> DataFrame:
    found = register
    for column, text in contains.items():
        found = found.where(C.contains_text(column, text)) if text else found
    return found.agg(F.count("*").alias("records"), F.sum("gross_premium").alias("premium"))


def facet_counts(rows: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n) for every value of every facet's domain, zero where none occurs.

    All facets are counted in one pass: each row contributes one (facet, value) per facet, pre-aggregated map-side.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])
    counted = rows.select(F.inline(entries)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    domain = rows.sparkSession.createDataFrame(
        [(f, v) for f, values in facets.items() for v in values], "facet string, value string"
    )
    return domain.join(counted, ["facet", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cascading_values(rows: DataFrame, chain: list[str], picks: dict[str, str]) -> DataFrame:
    """(facet, value): the values each facet of a chain still offers, given the picks made before it. One scan and one aggregate:
    a row gives an entry for every facet whose earlier picks it meets."""
    entries, met = [], F.lit(True)
    for facet in chain:
        offered = met & (F.coalesce(F.col(facet), F.lit("")) != "")
        entries.append(F.when(offered, F.struct(F.lit(facet).alias("facet"), F.col(facet).alias("value"))))
        if picks.get(facet):
            met = met & F.coalesce(F.col(facet) == picks[facet], F.lit(False))
    return rows.select(F.inline(F.array_compact(F.array(*entries)))).distinct()


def labelled_union(frames: dict[str, DataFrame], columns: list[str], label: str = "kind") -> DataFrame:
    """Rows of several results under one another, each with the name of its result; a column that a result lacks is NULL."""
    parts = [df.select(*[c for c in columns if c in df.columns], F.lit(name).alias(label)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").distinct().orderBy(column)


def distinct_months(rows: DataFrame, column: str) -> DataFrame:
    month = F.trunc(column, "month").alias("month")
    return rows.where(F.col(column).isNotNull()).select(month).distinct().orderBy(F.desc("month"))


def archive_summary(entries: DataFrame) -> DataFrame:
    """Per archived month: documents, files, bytes and a status from the failed ones."""
    done = F.col("error").isNull()
    status = F.when(F.col("failed") == 0, F.lit("COMPLETED")).when(F.col("documents") > 0, F.lit("PARTIAL")).otherwise(F.lit("FAILED"))
    return entries.groupBy("month").agg(
        F.count_if(done).alias("documents"), F.count_if(done & (F.col("file_key") != "")).alias("files"),
        F.coalesce(F.sum(F.when(done & (F.col("file_key") != ""), F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.count_if(~done).alias("failed"),
    ).withColumn("status", status)


def class_makes(rates: DataFrame, make_master: DataFrame, by: str) -> DataFrame:
    """(by, item): the cluster items behind the make groups a class or a product uses."""
    used = rates.where("is_deleted = 'NO'").select(by, "new_vehicle_makes").where(F.col(by).isNotNull()).distinct()
    names = used.select(by, F.explode(C.cluster_items("new_vehicle_makes")).alias("name")).distinct()
    items = make_master.select(F.lower(T.strip("name")).alias("name"), F.explode(C.split_list("cluster")).alias("item"))
    return names.join(items.distinct(), "name").select(by, "item").distinct()


def latest(rows: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """The newest row per key, an aggregate."""
    return rows.groupBy(*by).agg(*[F.max_by(c, F.struct(at, "id")).alias(c) for c in columns])


def most_recent(rows: DataFrame, at: str, n: int | None = None) -> DataFrame:
    """Rows, newest first, all of them or the first ``n``."""
    newest = rows.orderBy(F.desc(at), F.desc("id"))
    return newest if n is None else newest.limit(n)
