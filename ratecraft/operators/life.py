"""Life payout grids: search, ranking, renewals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecraft import constants as K
from ratecraft.functions import life as L, text as T
from ratecraft.session import stage

SLOT_LABELS = ["Yr 2", "Yr 3", "Yr 4", "Yr 5", "Yr 6+"]


def search_grid(rows: DataFrame, insurer: str = "", product: str = "", ppt: str = "", pt: str = "", query: str = "") -> DataFrame:
    picks = {"InsurerDisplay": insurer, "Product_Name": product, "PPT": ppt, "PT": pt}
    tests = [F.col(c) == v for c, v in picks.items() if v]
    return rows.where(reduce(lambda a, b: a & b, tests, L.matches_search(query)))


def grouped_grid(rows: DataFrame) -> DataFrame:
    """Per insurer and product: how many rows, and the insurer's first note."""
    notes = rows.groupBy("InsurerDisplay").agg(
        F.min_by("Sheet_Level_Notes_And_Conditions", F.when(F.col("Sheet_Level_Notes_And_Conditions").isNotNull(), F.col("Row_ID"))).alias("notes")
    )
    products = rows.groupBy("InsurerDisplay", "Product_Name").agg(F.count("*").alias("rows"))
    return products.join(notes, "InsurerDisplay")


def product_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("InsurerDisplay", "Product_Name").alias("products"))


def best_payouts(rows: DataFrame, plan_type: str = "", ppt: str = "", n: int | None = None) -> DataFrame:
    """Rows with a numeric first-year payout, best first, all of them or the first ``n``."""
    found = rows.where("Base_Payout_Yr1 IS NOT NULL").withColumn("canonical_type", L.canonical_type("Category"))
    if plan_type:
        found = found.where(F.col("canonical_type") == plan_type)
    if ppt:
        found = found.where(F.col("PPT") == ppt)
    found = found.orderBy(F.desc("Base_Payout_Yr1"), F.asc("Row_ID"))
    return found if n is None else found.limit(n)


def _values() -> list[Column]:
    return [F.col(s) for s in K.RENEWAL_SLOTS]


def renewal_long(rows: DataFrame) -> DataFrame:
    """(Row_ID, slot, label, value): the filled renewal slots."""
    slots = F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(label).alias("label"), v.alias("value"))
        for i, (label, v) in enumerate(zip(SLOT_LABELS, _values()))
    ])
    return rows.select("Row_ID", F.inline(F.filter(slots, lambda s: s["value"].isNotNull())))


def renewal_summary() -> Column:
    """``Yr 2 5.0% · Yr 3 4.0%``; NULL where no slot is filled."""
    parts = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.concat(F.lit(label + " "), L.payout_text(v, F.lit(None).cast("string"))))
        for label, v in zip(SLOT_LABELS, _values())
    ]))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · "))


def has_overflow() -> Column:
    """The source had more filled renewal columns than the slots show."""
    filled = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in _values()])
    return F.size(L.raw_renewals("All_Renewal_Years_Raw", filled_only=True)) > filled


def visible_slots(rows: DataFrame) -> DataFrame:
    """(slot, visible): slots with a value anywhere."""
    counted = rows.agg(*[F.count(v).alias(s) for s, v in zip(K.RENEWAL_SLOTS, _values())])
    entries = F.array(*[F.struct(F.lit(s).alias("slot"), (F.col(s) > 0).alias("visible")) for s in K.RENEWAL_SLOTS])
    return counted.select(F.inline(entries))


def insurer_summary(rows: DataFrame) -> DataFrame:
    """Rows and distinct (product, variant) per insurer; a NULL variant is a variant of its own."""
    return rows.groupBy("InsurerDisplay").agg(
        F.count("*").alias("rows"), F.count_distinct(F.struct("Product_Name", "Variant")).alias("products")
    )


def fill_down(cells: DataFrame) -> DataFrame:
    """Product, variant, PT and category carried down a block.

    ``cells`` has ``sheet``, ``block``, ``line`` and the four columns. Category carries through a block; variant and PT
    start afresh where a different product begins.

    A segmented scan: rows are cut into ranges of lines, filled inside their range, and each range of a block takes over what the
    ranges before it left, so a block of any length is no single task.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["sheet", "block", "line"]
    rows = cells.select(*order, "product", "variant", "pt", "category").repartitionByRange(n, *order)
    rows = stage(rows.withColumn("_part", F.spark_partition_id()))
    keys = ["sheet", "block", "_part"]
    own = Window.partitionBy(*keys).orderBy("line")
    upto, before = (own.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))

    def last_filled(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line")))

    def carried(df: DataFrame, left: DataFrame, columns: list[str]) -> DataFrame:
        """Adds ``_<c>_in``: the last value of ``left``, one row a range, from the ranges before."""
        taken = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.last(c, ignorenulls=True).over(
            Window.partitionBy("sheet", "block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}_in") for c in columns])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        return df.join(taken, same).drop(*[f"_k_{k}" for k in keys])

    ends = rows.groupBy(*keys).agg(*[last_filled(c).alias(c) for c in ("product", "category")])
    current = carried(rows, ends, ["product", "category"])
    filled = lambda c, over: F.coalesce(F.last(c, ignorenulls=True).over(over), F.col(f"_{c}_in"))
    current = current.withColumn("_prior", filled("product", before)).withColumn("product_name", filled("product", upto)).withColumn("category_name", filled("category", upto))
    starts = F.col("product").isNotNull() & (F.col("_prior").isNull() | (F.col("product") != F.col("_prior")))
    current = current.withColumn("_run", F.sum(starts.cast("int")).over(upto))
    # what a range leaves: the value of its last run, blank where a product began there without one; nothing if it saw neither
    place = F.struct("_run", "line")
    left = current.groupBy(*keys).agg(F.max("_run").alias("_runs"), *[F.max_by(F.struct(F.col(c).alias("value"), "_run"), F.when(F.col(c).isNotNull(), place)).alias(c) for c in ("variant", "pt")])
    value = lambda c: F.when(F.col(f"{c}._run") == F.col("_runs"), F.col(f"{c}.value"))
    left = left.select(*keys, *[F.when((F.col("_runs") > 0) | value(c).isNotNull(), F.struct(value(c).alias("value"))).alias(c) for c in ("variant", "pt")])
    current = carried(current, left, ["variant", "pt"])
    run = Window.partitionBy(*keys, "_run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda c: F.last(c, ignorenulls=True).over(run)
    names = [F.coalesce(inside(c), F.when(F.col("_run") == 0, F.col(f"_{c}_in.value"))).alias(out) for c, out in (("variant", "variant_name"), ("pt", "pt_value"))]
    return current.select(*order, "product_name", "category_name", *names)


def slot_columns(columns: DataFrame) -> DataFrame:
    """(table_id, slot, position): the column each renewal slot reads.

    ``columns`` has ``table_id``, ``position`` and ``label`` of the renewal columns. A label that names years fills their
    slots; among several the last "total" wins, else the last. Columns without a year then fill the slots still empty,
    in order; what is left over goes to the last slot. A table has a handful of columns.
    """
    parsed = columns.withColumn("years", L.renewal_years("label"))
    open_or_named = F.col("years.years").isNotNull() | F.col("years.open_ended")
    named = parsed.withColumn("slots", F.when(open_or_named, L.renewal_slots(F.col("years"))).otherwise(F.array().cast("array<int>")))
    is_total = F.contains(F.lower(T.squash_whitespace("label")), F.lit("total"))
    usable = named.where(~F.col("years.year_one_only"))
    claims = usable.select("table_id", "position", is_total.alias("is_total"), F.explode("slots").alias("slot"))
    taken = claims.groupBy("table_id").agg(F.array_sort(F.collect_set("slot")).alias("taken"))
    every = F.array(*[F.lit(i) for i in range(5)])
    rest = usable.where(F.size("slots") == 0).withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy("position")))
    rest = rest.join(taken, "table_id", "left").withColumn("free", F.array_except(every, F.coalesce("taken", F.array().cast("array<int>"))))
    placed = rest.select("table_id", "position", is_total.alias("is_total"), F.coalesce(F.get("free", F.col("n") - 1), F.lit(4)).alias("slot"))
    both = claims.unionByName(placed)
    return both.groupBy("table_id", "slot").agg(F.max_by("position", F.struct("is_total", "position")).alias("position"))


def wide_records(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, line, Renewal_*): long cells (table_id, line, position, value) pivoted to the five slots."""
    slots = slot_columns(columns)
    long = cells.join(slots, ["table_id", "position"]).select("table_id", "line", "slot", "value")
    wide = long.groupBy("table_id", "line").pivot("slot", list(range(5))).agg(F.first("value"))
    return wide.select("table_id", "line", *[F.col(str(i)).alias(name) for i, name in enumerate(K.RENEWAL_SLOTS)])
