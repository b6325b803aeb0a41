"""Policy file -> mapped file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft import constants as K
from ratecraft.functions import reasons, text as T
from ratecraft.operators import rulejoin as J
from ratecraft.operators.amounts import premium_validation, with_amounts
from ratecraft.operators.healthjoin import map_health, map_health_apart
from ratecraft.operators.resolve import resolve_codes, resolve_models
from ratecraft.session import stage
from ratecraft.sources.policies import insurer_names, motor_features, with_insurer, with_names

RESULT_COLUMNS = [
    "row_id", "mapping_status", "failure_reason", "display_group_id", "po_type", "po_rate", "po_flat_amount", "pi_type",
    "pi_rate", "pi_flat_amount", "add_tnc", "po_od_rate", "po_tp_rate", "pi_od_rate", "pi_tp_rate", "tied_groups", "match_ids",
]


def route() -> Column:
    """``motor``, ``health`` or ``none``, from the Product cell."""
    product = T.norm_text("product")
    return F.when(product.isin("motor", "health"), product).otherwise(F.lit("none"))


def resolve_motor(features: DataFrame, rates: DataFrame, rto_master: DataFrame, make_master: DataFrame) -> DataFrame:
    """Motor features with insurer, RTO groups and make groups resolved, each on its distinct values.

    The typed features are staged first: the source is read once, and the resolvers scan one column each.
    """
    typed = stage(features)
    rtos = resolve_codes(typed.select(F.col("rto").alias("term")), rto_master)
    makes = resolve_models(typed.select(F.col("make_model").alias("term")), make_master)
    named = with_names(with_names(typed, "rto", "rto_names", rtos), "make_model", "make_names", makes)
    return with_insurer(named, insurer_names(typed, rates))


def map_motor(features: DataFrame, rates: DataFrame, all_ids: bool = True) -> DataFrame:
    """Results of resolved motor features against normalised motor rates.

    Each policy is looked up once in the index of the card, which tells its matches and the rules it fails. Without ``all_ids``
    the column ``match_ids`` keeps the ids that the failure text shows and no more.
    """
    chain, checked, placed = _checked_motor(features, rates)
    return _motor_results(checked, J.matched_groups(checked, placed, chain, J.motor_payload(), None if all_ids else J.SHOWN_IDS), chain)


def map_motor_apart(features: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``map_motor``; ``match_ids`` names the lists of all ids, which come beside: (list_ids, ids)."""
    chain, checked, placed = _checked_motor(features, rates)
    matched, lists = J.matched_groups_apart(checked, placed, chain, J.motor_payload())
    return _motor_results(checked, matched, chain), lists


def _checked_motor(features: DataFrame, rates: DataFrame) -> tuple[J.RuleChain, DataFrame, DataFrame]:
    chain = J.motor_chain()
    combined = F.when(
        F.col("cc_combined"),
        F.concat(F.col("cc_label"), F.lit(" value '"), F.col("cc_raw"),
                 F.lit("' looks like a combined CC/GVW figure (two numbers separated by '/'). Not auto-parsed — correct "
                       "the source MIS data and re-run mapping for this row.")),
    )
    validation = premium_validation(
        F.col("sub_product"), F.col("vehproduct"), F.col("total_od_cell"), F.col("tp_premium_cell"), F.col("ncb_cell")
    )
    checked = stage(features.withColumn("data_errors", F.array_compact(F.array(combined, validation))))
    return chain, checked, J.with_group_places(rates)


def _motor_results(checked: DataFrame, matched: DataFrame, chain: J.RuleChain) -> DataFrame:
    insurer_failure = reasons.segment(F.lit(K.POLICY_FILE_COLUMNS["insurer"]), F.when(
        F.col("insurer").isNull(),
        F.concat(F.lit("Insurer '"), F.coalesce(F.col("insurer_raw"), F.lit("(blank)")),
                 F.lit(f"' did not fuzzy-match any active Rate Master insurer (threshold={K.INSURER_SCORE_MIN}). "
                       "Either no active rate is configured for this insurer, or the name on file differs too much to "
                       "match.")),
    ).otherwise(F.concat(F.lit("Insurer resolved to '"), F.col("insurer"),
                         F.lit("' but there are 0 active Rate Master rows for that insurer."))))
    segments = F.when(F.col("mask").isNull(), F.array(insurer_failure)).otherwise(
        J.failed_segments(chain.rules, F.col("mask"))
    )
    joined = checked.join(matched, "row_id", "left").withColumn("segments", segments)

    bad = F.size("data_errors") > 0
    single = (F.col("group_count") == 1) | F.coalesce(F.col("same_payout"), F.lit(False))
    status = (
        F.when(bad, F.lit(K.BAD_DATA))
        .when(F.coalesce(single, F.lit(False)), F.lit(K.MATCH))
        .when(F.col("group_count") > 1, F.lit(K.MULTIPLE))
        .otherwise(F.lit(K.NO_MATCH))
    )
    used = F.concat(
        F.lit("Matched Successfully — "), F.col("group_count").cast("string"),
        F.lit(" Rate Master groups matched with identical payout and payin rates; used Group "),
        F.col("group_key").cast("string"), F.lit(" (lowest Group ID)."),
    )
    several = F.concat(
        F.lit("Multiple Rate Master groups matched ("), F.col("group_count").cast("string"), F.lit(" groups, "),
        F.col("row_count").cast("string"),
        F.lit(" rows total). Please refine Rate Master so only one group applies. Matching Group IDs: "),
        J.id_list_text(),
    )
    reason = (
        F.when(F.col("mapping_status") == K.BAD_DATA, reasons.bad_data_reason(F.col("data_errors"), F.col("segments")))
        .when(F.col("mapping_status") == K.MATCH,
              F.when(F.col("group_count") > 1, used).otherwise(F.lit("Matched Successfully")))
        .when(F.col("mapping_status") == K.MULTIPLE, several)
        .otherwise(reasons.failed_on(F.col("segments")))
    )
    ok = F.col("mapping_status") == K.MATCH
    row = F.col("rate_row")
    return (
        joined.withColumn("mapping_status", status)
        .withColumn("failure_reason", reason)
        .select(
            "row_id", "mapping_status", "failure_reason",
            F.when(ok, F.col("group_key")).alias("display_group_id"),
            F.when(ok, row["r_po_type"]).alias("po_type"),
            F.when(ok, J.chosen_rate("po")).alias("po_rate"),
            F.when(ok, row["r_po_flat_amount"]).alias("po_flat_amount"),
            F.when(ok, row["r_pi_type"]).alias("pi_type"),
            F.when(ok, J.chosen_rate("pi")).alias("pi_rate"),
            F.when(ok, row["r_pi_flat_amount"]).alias("pi_flat_amount"),
            F.when(ok, row["r_add_tnc"]).alias("add_tnc"),
            *[F.when(ok, row[f"r_{leg}"]).alias(leg) for leg in ("po_od_rate", "po_tp_rate", "pi_od_rate", "pi_tp_rate")],
            F.when(ok & (F.col("group_count") > 1), F.col("group_count")).otherwise(F.lit(0)).alias("tied_groups"),
            (J.ambiguous_ids("list_ids", "array<binary>") if "list_ids" in matched.columns else J.ambiguous_ids()).alias("match_ids"),
        )
    )


def unroutable(policies: DataFrame) -> DataFrame:
    """Result rows of policies that are neither motor nor health."""
    shown = F.when(T.norm_text("product").isin("", "nan", "none"), F.lit("(blank)")).otherwise(T.norm_text("product"))
    reason = F.concat(
        F.lit("Failed on: Product — Product '"), shown,
        F.lit("' is neither 'motor' nor 'health', so no Rate Master applies and the row was not matched. Correct the "
              "Product column and re-run mapping for this row."),
    )
    return empty_result(policies, F.lit(K.NO_MATCH), reason)


def empty_result(rows: DataFrame, status: Column, reason: Column) -> DataFrame:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    blanks = {"display_group_id": F.lit(None).cast("bigint"), "po_type": text, "pi_type": text, "add_tnc": text}
    columns = [blanks.get(c, number).alias(c) for c in RESULT_COLUMNS[3:-2]]
    return rows.select(
        "row_id", status.alias("mapping_status"), reason.alias("failure_reason"), *columns,
        F.lit(0).cast("bigint").alias("tied_groups"), F.array().cast("array<bigint>").alias("match_ids"),
    )


def map_policies(policies: DataFrame, motor_rates: DataFrame, health_rates: DataFrame, rto_master: DataFrame,
                 make_master: DataFrame, pincode_master: DataFrame, run_year: int, all_ids: bool = True) -> DataFrame:
    """Short-named text policies mapped against both rate cards, with amounts.

    ``motor_rates`` and ``health_rates`` are normalised (see ``ratecraft.sources.rates``). Each policy goes to exactly
    one branch; a file without health rows leaves that branch empty and adaptive execution drops it. ``all_ids`` as in ``map_motor``.
    """
    routed = policies.withColumn("route", route())
    motor = motor_features(routed.where("route = 'motor'"), run_year)
    motor_results = map_motor(resolve_motor(motor, motor_rates, rto_master, make_master), motor_rates, all_ids)
    health_results = map_health(routed.where("route = 'health'"), health_rates, pincode_master, all_ids)
    results = motor_results.unionByName(health_results).unionByName(unroutable(routed.where("route = 'none'")))
    return with_amounts(with_results(policies, results))


def map_policies_apart(policies: DataFrame, motor_rates: DataFrame, health_rates: DataFrame, rto_master: DataFrame,
                       make_master: DataFrame, pincode_master: DataFrame, run_year: int) -> tuple[DataFrame, DataFrame]:
    """As ``map_policies`` with all ids; ``match_ids`` names the lists of ids, which come beside, each once: (list_ids, ids)."""
    routed = policies.withColumn("route", route())
    motor = motor_features(routed.where("route = 'motor'"), run_year)
    motor_results, motor_lists = map_motor_apart(resolve_motor(motor, motor_rates, rto_master, make_master), motor_rates)
    health_results, health_lists = map_health_apart(routed.where("route = 'health'"), health_rates, pincode_master)
    none = unroutable(routed.where("route = 'none'")).withColumn("match_ids", F.array().cast("array<binary>"))
    results = motor_results.unionByName(health_results).unionByName(none)
    return with_amounts(with_results(policies, results)), motor_lists.unionByName(health_lists)


def with_results(policies: DataFrame, results: DataFrame) -> DataFrame:
    """Policies with their results; a policy without any is no match."""
    joined = policies.join(results, "row_id", "left")
    return joined.withColumn("mapping_status", F.coalesce("mapping_status", F.lit(K.NO_MATCH)))


def mapped_file(policies_raw: DataFrame, mapped: DataFrame, key: str = "Original_Row_ID", all_ids: bool = False) -> DataFrame:
    """The output file: generated columns first, then every original column in its order.

    With ``all_ids`` a last column lists every group id of an ambiguous row, of which the failure text shows ten, so failed rows
    can be rebuilt from the file (``gaps.failed_from_file``).
    """
    generated = {
        "Mapping Status": "mapping_status", "Failure Reason": "failure_reason", "Displaygroupid": "display_group_id",
        "Potype": "po_type", "Porate": "po_rate_text", "Poflatamount": "po_flat_amount", "Pitype": "pi_type",
        "Pirate": "pi_rate_text", "Piflatamount": "pi_flat_amount", "Addtnc": "add_tnc", "cp premium#": "cp_premium",
        "Pay-in Amt": "pay_in_amount", "Pay-out Amt": "pay_out_amount", "Margin Rate": "margin_rate",
        "Margin Amt": "margin_amount",
    }
    ids = {K.ALL_IDS_COLUMN: F.array_join("match_ids", ",")} if all_ids else {}
    results = mapped.select(F.col("row_id").alias(key), *[F.col(v).alias(k) for k, v in generated.items()], *[v.alias(k) for k, v in ids.items()])
    original = [c for c in policies_raw.columns if c != key]
    return policies_raw.join(results, key, "left").select(*[F.col(f"`{c}`") for c in [*generated, *original, key, *ids]])


def run_summary(mapped: DataFrame) -> DataFrame:
    """One row: processed, matched, collapsed, multiple and bad-data policies."""
    status = F.col("mapping_status")
    return mapped.agg(
        F.count("*").alias("processed"),
        F.count_if(status == K.MATCH).alias("matched"),
        F.count_if(F.col("tied_groups") > 0).alias("collapsed"),
        F.count_if(status == K.MULTIPLE).alias("multiple"),
        F.count_if(status == K.BAD_DATA).alias("bad_data"),
    )


def summary_text() -> Column:
    """The sentence a finished run shows, over a ``run_summary`` row."""
    n = {c: F.col(c).cast("string") for c in ("processed", "matched", "collapsed", "multiple", "bad_data")}
    tied = F.concat(n["collapsed"], F.lit(" of them matched several Rate Master groups/rows with identical payout and "
                                          "payin rates and used the lowest Group ID. "))
    return F.concat(
        F.lit("Processed "), n["processed"], F.lit(" rows successfully. Mapped "), n["matched"], F.lit(" rates. "),
        F.when(F.col("collapsed") > 0, tied).otherwise(F.lit("")), n["multiple"],
        F.lit(" rows skipped — multiple Rate Master groups matched (refine Rate Master to get a single match). "),
        n["bad_data"], F.lit(" rows flagged FAILED - BAD DATA (invalid source values — see Failure Reason)."),
    )
