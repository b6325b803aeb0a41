"""Rate upload -> rate table: names, rejection, duplicate guard, groups and outcome in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft.functions import text as T
from ratecraft.operators import maintain as M
from ratecraft.session import dealt, stage

#: dimension cells of an upload; an unknown number is a new name everywhere but in ``product``, where it is blank
DIMENSIONS = ["product", "sub_product", "policy_type", "fuel_type", "make_model_class"]


@dataclass(frozen=True)
class Ingest:
    """``inserted``: rate rows with their group; ``outcome``: one row (success, rows, problem); ``new_members``: (field, name)."""

    inserted: DataFrame
    outcome: DataFrame
    new_members: DataFrame


def member_names(upload: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """(field, _key, name, is_new) of every distinct filled cell: the master's spelling by id or by name, else a new member.

    A master has ``id`` and ``name``; names that differ in case only count as the one with the largest id. A new member
    takes the spelling of its first line.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), T.none_if_empty(T.strip(F.coalesce(f, F.lit("")))).alias("cell")) for f in masters])
    cells = upload.select("line", F.inline(cells)).where("cell IS NOT NULL").groupBy("field", F.lower("cell").alias("_key")).agg(
        F.min_by("cell", "line").alias("cell"))
    number = F.when(F.col("_key").rlike(r"^\d+$"), F.col("_key").try_cast("bigint"))
    known = reduce(DataFrame.unionByName, [
        m.select(F.lit(f).alias("field"), F.col("id").cast("bigint").alias("id"), "name") for f, m in masters.items()])
    by_id = known.select("field", F.col("id").alias("_id"), F.col("name").alias("by_id"))
    by_name = known.groupBy("field", F.lower("name").alias("_key")).agg(F.max_by("name", "id").alias("by_name"))
    found = cells.withColumn("_id", number).join(by_id, ["field", "_id"], "left").join(by_name, ["field", "_key"], "left")
    by_text = (F.col("field") != "product") | F.col("_id").isNull()
    name = F.coalesce("by_id", F.when(by_text, F.col("by_name")))
    is_new = name.isNull() & by_text
    return found.select("field", "_key", F.when(is_new, F.col("cell")).otherwise(name).alias("name"), is_new.alias("is_new"))


def named_rows(rows: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """Upload rows with their dimension cells replaced by the names of :func:`member_names`."""
    named = rows
    for field in fields:
        own = members.where(F.col("field") == field).select("_key", F.col("name").alias("_name"))
        named = named.withColumn("_key", F.lower(T.strip(F.coalesce(field, F.lit(""))))).join(own, "_key", "left")
        named = named.withColumn(field, F.col("_name")).drop("_key", "_name")
    return named


def problems(upload: DataFrame, rto_master: DataFrame, make_master: DataFrame, keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """(line, problem): RTO and make names no master has, and filled number cells that are no number. ``keys`` name a row."""
    rto = F.concat(F.lit("RTO '"), F.col("item"), F.lit("' does not exist in RTOMaster. Please add it first."))
    make = F.concat(F.lit("Vehicle Make '"), F.col("item"), F.lit("' does not exist in MakeModelMaster. Please add it first."))
    unknown = M.unknown_members(upload, rto_master, make_master, keys).select(
        *keys, F.when(F.col("field") == "new_rto_list", rto).otherwise(make).alias("problem"))
    number = F.concat(F.col("field"), F.lit(" value '"), F.col("cell"), F.lit("' is not a valid number."))
    return unknown.unionByName(M.unreadable_numbers(upload, keys).select(*keys, number.alias("problem")))


def ingest_rates(upload: DataFrame, existing: DataFrame, groups: DataFrame, masters: dict[str, DataFrame],
                 rto_master: DataFrame, make_master: DataFrame) -> Ingest:
    """Applies an all-text upload (``line`` numbers its rows) to the rate table.

    An upload with any problem inserts nothing; the outcome names the problem of the smallest line. Otherwise rows whose
    content is live already, or whose group has the same RTO list already, are left out, so a replay inserts nothing.
    ``masters`` are those of the dimension cells, by field (see ``DIMENSIONS``). ``existing`` has ``key_hash``; ``groups`` has ``group_id`` and ``key_hash``. An empty upload succeeds with no rows.
    """
    rows = stage(dealt(upload, "line"))
    found = stage(problems(rows, rto_master, make_master))
    rejected: Column = found.agg((F.count("*") > 0).alias("rejected")).scalar()
    members = stage(member_names(rows, masters))
    named = named_rows(rows, members, list(masters))
    fresh = M.new_rates(stage(M.typed_upload(named)), existing).where(~rejected)
    inserted = stage(M.assign_groups(fresh, groups))
    first = found.agg(F.min_by("problem", F.struct("line", "problem")).alias("problem"))
    counted = inserted.agg(F.count("*").alias("rows"))
    outcome = first.select(F.col("problem").isNull().alias("success"), counted.scalar().alias("rows"), "problem")
    new_members = members.where("is_new").where(~rejected).select("field", "name")
    return Ingest(inserted, outcome, new_members)
