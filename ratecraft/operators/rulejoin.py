"""Rule joins: policies against rate rows under an ordered chain of rules.

A rule that would leave a policy no candidate is recorded as failed and does not narrow. So the surviving candidates are
those with the lexicographically greatest pass/fail vector (first rule most significant), and the failed rules are the
zero bits of that vector. As an integer mask that is ``max(mask)`` per policy: one join and one aggregate that combines
map-side, with no iteration over rules.

The motor and health chains are answered from a bitmap index of the card (``operators.bitmap``): no policy meets a rate row.
So are rules of a configuration. For tests of any other kind there is ``best_masks``, a join: the chain is split into *lead*
rules (equality on a few low-cardinality fields) and *tail* rules. The lead part of the mask depends only on the distinct lead
values, so it is worked out on those, and only the candidates that survive it meet the policies: the greatest vector has the
greatest prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecraft import constants as K
from ratecraft.functions import numbers as N, reasons, text as T
from ratecraft.functions.rates import consolidated_rate, effective_rate, payout_signature
from ratecraft.operators.bitmap import Groups, Range, Tokens, days, list_or_empty, names_or_blank, narrowed, one_of
from ratecraft.operators.resolve import word_pairs
from ratecraft.session import stage

#: ids a failure text shows
SHOWN_IDS = 10


@dataclass(frozen=True)
class Rule:
    """One test of a rate row (columns ``r_*``) against a policy, with the text of its failure over policy columns.

    ``test`` is a condition over both, or what a bitmap index of the card needs to answer it.
    """

    label: Column
    test: Column | Tokens | Range
    detail: Column

    def holds(self) -> Column:
        return self.test if isinstance(self.test, Column) else self.test.holds()


@dataclass(frozen=True)
class RuleChain:
    """An ordered chain. ``block`` is the resolved insurer, the one rule that is an equi-join. The columns that the rules read
    are only named where the chain is joined."""

    lead: list[Rule]
    tail: list[Rule]
    lead_policy: list[str] = field(default_factory=list)
    lead_rate: list[str] = field(default_factory=list)
    tail_policy: list[str] = field(default_factory=list)
    tail_rate: list[str] = field(default_factory=list)
    block: str = "insurer"
    key: str = "row_id"

    @property
    def rules(self) -> list[Rule]:
        return [*self.lead, *self.tail]


def mask_of(rules: list[Rule]) -> Column:
    """Bit per rule, the first rule the most significant; a test that is NULL has failed."""
    bits = [
        F.when(F.coalesce(rule.holds(), F.lit(False)), F.lit(1 << (len(rules) - 1 - i)).cast("bigint")).otherwise(
            F.lit(0).cast("bigint")
        )
        for i, rule in enumerate(rules)
    ]
    return reduce(lambda a, b: a + b, bits, F.lit(0).cast("bigint"))


def failed_segments(rules: list[Rule], mask: Column) -> Column:
    """Array with the segment of every failed rule and NULL for the others."""
    size = len(rules)
    return F.array(*[
        F.when(F.getbit(mask, F.lit(size - 1 - i)) == 0, reasons.segment(rule.label, rule.detail))
        for i, rule in enumerate(rules)
    ])


def same_values(left: DataFrame, right: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """Inner join on equal values, NULL equal to NULL; the right side's copies of the columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"{mark}{c}") if c in columns else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in columns])
    return left.join(renamed, condition).drop(*[f"{mark}{c}" for c in columns])


def best_masks(policies: DataFrame, rates: DataFrame, chain: RuleChain) -> DataFrame:
    """(key, mask): the greatest mask any rate row of the policy's insurer reaches."""
    lead_keys = [chain.block, *chain.lead_policy]
    rate_block = F.col(f"r_{chain.block}").alias(chain.block)
    tuples = policies.select(*lead_keys).where(F.col(chain.block).isNotNull()).distinct()
    lead_rates = rates.select(rate_block, *chain.lead_rate).distinct()
    per_tuple = Window.partitionBy(*lead_keys)
    lead = (
        tuples.join(lead_rates, chain.block)
        .withColumn("lead_mask", mask_of(chain.lead))
        .withColumn("_best", F.max("lead_mask").over(per_tuple))
        .where("lead_mask = _best")
        .drop("_best")
    )
    tail_rates = rates.select(rate_block, *chain.lead_rate, *chain.tail_rate).distinct()
    survivors = (
        same_values(lead, tail_rates, [chain.block, *chain.lead_rate], "_t_")
        .select(*lead_keys, "lead_mask", *chain.tail_rate)
        .distinct()
    )
    asked = policies.select(chain.key, *lead_keys, *chain.tail_policy)
    candidates = same_values(asked, survivors, lead_keys, "_s_")
    mask = F.shiftleft("lead_mask", len(chain.tail)) + mask_of(chain.tail)
    return candidates.groupBy(chain.key).agg(F.max(mask).alias("mask"))


def indexed_masks(policies: DataFrame, rates: DataFrame, chain: RuleChain) -> DataFrame:
    """(key, mask) of a chain whose tests are all indexable."""
    found = narrowed(policies, rates, [rule.test for rule in chain.rules], chain.block, chain.key)
    return found.groupBy(chain.key).agg(F.max("mask").alias("mask"))


# ---- motor chain ----------------------------------------------------------------------------------
def exact_or_wildcard(rate: Column, policy: Column) -> Tokens:
    """Blank rate matches anything; otherwise equal. Both are normalised text with '' for blank."""
    return Tokens(one_of("", policy), F.array(rate))


def class_or_wildcard(rate: Column, policy: Column) -> Tokens:
    return Tokens(one_of("", "na", policy), F.array(rate))


def resolved_in_list(blank: Column, names: Column, items: Column) -> Tokens:
    """A blank policy value matches only an empty list; otherwise the list must hold a resolved name."""
    return Tokens(names_or_blank(blank, names), list_or_empty(items))


def coded(rate: Column, is_yes: Column, is_no: Column) -> Tokens:
    return Tokens(one_of("NA", F.when(is_yes, F.lit("YES")), F.when(is_no, F.lit("NO"))), F.array(rate))


def _quoted_category(name: str, policy: str) -> Column:
    return F.concat(
        F.lit("Value '"), _shown(policy), F.lit(f"' did not match any remaining candidate Rate Master row's {name} "
                                                 "(after the previous rules narrowed the field).")
    )


def _shown(c: str) -> Column:
    """A blank category cell is quoted as ``nan``."""
    return F.when(F.col(c) == "", F.lit("nan")).otherwise(F.col(c))


def _range_detail(label: Column, value: Column) -> Column:
    blank = F.concat(label, F.lit(" is blank/unparseable on this policy, and no remaining candidate rate row has an "
                                  "open (blank) range."))
    outside = F.concat(label, F.lit(" value "), N.number_text(value),
                       F.lit(" falls outside the range configured on every remaining candidate rate row."))
    return F.when(value.isNull(), blank).otherwise(outside)


def _preview(names: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(names), 1, 5), ", ")


def motor_chain() -> RuleChain:
    """Rules 2-6 of the motor chain; rule 1, the insurer, is the block."""
    c = F.col
    lead = [
        Rule(F.lit(K.POLICY_FILE_COLUMNS["vehproduct"]), exact_or_wildcard(c("r_product"), c("vehproduct")),
             _quoted_category("product", "vehproduct")),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["sub_product"]), exact_or_wildcard(c("r_sub_product"), c("sub_product")),
             _quoted_category("sub product", "sub_product")),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["fuel"]), exact_or_wildcard(c("r_fuel_type"), c("fuel")),
             _quoted_category("fuel type", "fuel")),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["vehicle_class"]),
             class_or_wildcard(c("r_make_model_class"), c("vehicle_class")),
             F.concat(F.lit("Vehicle class '"), _shown("vehicle_class"),
                      F.lit("' has no exact match among remaining candidate rate rows, and none of them has an "
                            "NA-wildcard class."))),
    ]
    age_detail = F.when(
        c("vehicle_age").isNull(), _range_detail(c("age_label"), c("vehicle_age"))
    ).otherwise(F.concat(
        F.lit("Calculated vehicle age '"), N.whole_text("vehicle_age"),
        F.lit("' ((current year + 1) - the year in "), c("age_label"),
        F.lit(") falls outside the age band (lower bound exclusive, upper bound inclusive) configured on every "
              "remaining candidate rate row."),
    ))
    date_detail = F.when(
        c("inception").isNull(),
        F.lit("Inception date is blank/unparseable on this policy, and no remaining candidate rate row has an open "
              "(blank) date window."),
    ).otherwise(F.concat(
        F.lit("Inception date "), c("inception").cast("string"),
        F.lit(" falls outside the active date window on every remaining candidate rate row."),
    ))
    make_detail = (
        F.when(c("make_model") == "",
               F.lit("Vehicle make/model is blank on this policy, and no remaining candidate rate row allows a blank "
                     "vehicle-make cluster."))
        .when(F.size("make_names") == 0,
              F.concat(F.lit(K.UNRESOLVED_MAKE_PREFIX), c("make_model"), F.lit(K.UNRESOLVED_MAKE_SUFFIX),
                       F.lit(f"{K.MODEL_SHARED_WORDS} words with any MakeModelMaster cluster entry — add it to "
                             "MakeModelMaster or check the MIS value.")))
        .otherwise(F.concat(F.lit(K.UNRESOLVED_MAKE_PREFIX), c("make_model"),
                            F.lit("' resolved to master group(s) ["), _preview(c("make_names")),
                            F.lit("], but no remaining candidate rate row lists that group in its vehicle-make "
                                  "cluster.")))
    )
    rto_text = F.concat(F.lit("RTO '"), c("rto_raw"), F.lit("' (normalized to '"), F.upper("rto"), F.lit("')"))
    rto_detail = (
        F.when(c("rto") == "",
               F.lit("RTO is blank on this policy, and no remaining candidate rate row allows a blank RTO cluster."))
        .when(F.size("rto_names") == 0,
              F.concat(rto_text, F.lit(" was not found in any RTOMaster cluster — add it to RTOMaster or check the "
                                       "MIS value.")))
        .otherwise(F.concat(rto_text, F.lit(" resolved to master group(s) ["), _preview(c("rto_names")),
                            F.lit("], but no remaining candidate rate row lists that group in its RTO cluster.")))
    )

    def code_detail(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name} value "), value,
                        F.lit(" doesn't satisfy the YES/NO/NA requirement on any remaining candidate rate row."))

    tail = [
        Rule(c("cc_label"), Range(F.when(c("cc_combined"), F.lit(float("nan"))).otherwise(c("cc")), c("r_cc_min"), c("r_cc_max")),
             _range_detail(c("cc_label"), c("cc"))),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["seating"]), Range(c("seating"), c("r_sc_min"), c("r_sc_max")),
             _range_detail(F.lit(K.POLICY_FILE_COLUMNS["seating"]), c("seating"))),
        Rule(c("age_label"),
             Range(c("vehicle_age"), c("r_vehicle_age_min"), c("r_vehicle_age_max"), low_open=True), age_detail),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["tariff"]), Range(c("tariff"), c("r_tariff_min"), c("r_tariff_max")),
             _range_detail(F.lit(K.POLICY_FILE_COLUMNS["tariff"]), c("tariff"))),
        Rule(F.lit(K.INCEPTION_LABEL), Range(days(c("inception")), days(c("r_from_date")), days(c("r_to_date"))), date_detail),
        Rule(F.lit(K.MAKE_MODEL_LABEL),
             resolved_in_list(c("make_model") == "", c("make_names"), c("r_make_items")), make_detail),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["rto"]),
             resolved_in_list(c("rto") == "", c("rto_names"), c("r_rto_items")), rto_detail),
        Rule(F.lit(K.NCB_LABEL), coded(c("r_is_ncb"), c("ncb").between(1, 99), c("ncb") == 0),
             code_detail("NCB", N.number_text("ncb"))),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["cpa"]), coded(c("r_is_cpa"), c("cpa").between(1, 1000), c("cpa") == 0),
             code_detail("CPA", N.number_text("cpa"))),
        Rule(F.lit(K.POLICY_FILE_COLUMNS["nil_dep"]), coded(c("r_is_zd"), c("zd") == "YES", c("zd") == "NO"),
             code_detail("Nil Dep", F.concat(F.lit("'"), F.coalesce(c("nil_dep"), F.lit("NAN")), F.lit("'")))),
    ]
    return RuleChain(lead=lead, tail=tail)


def with_group_places(rates: DataFrame) -> DataFrame:
    """Rate rows with what a match has to carry, as numbers: their group, their place in it (lowest effective rate, then
    lowest id), and one id that rows of equal payout share.

    Worked out on the card, which is far smaller than its matches.
    """
    rate = effective_rate(*[F.col(f"r_po_{f}") for f in ("type", "od_rate", "tp_rate", "net_rate")])
    keyed = rates.withColumn("r_group", F.coalesce("r_group_id", "r_id"))
    place = F.row_number().over(Window.partitionBy("r_group").orderBy(rate.asc_nulls_first(), "r_id"))
    payout = F.min("r_id").over(Window.partitionBy(payout_signature("r_")))
    return keyed.withColumns({"r_place": place, "r_payout": payout})


def matched_groups(policies: DataFrame, rates: DataFrame, chain: RuleChain, payload: list[str], shown: int | None = None) -> DataFrame:
    """One row per policy whose insurer has rates: its mask; how many groups and rows pass the whole chain, whether they all pay the
    same, and the row used (all NULL where none passes).

    Ambiguity is judged on distinct group keys. Inside a group the row with the lowest effective rate is used (then the
    lowest id); several groups with one payout signature count as one, the lowest. ``group_keys`` lists all of them, or the ``shown``
    lowest. ``rates`` come from ``with_group_places``: matches are counted by group where they are found, so none of them is
    shuffled, and the used row is joined back at the end. Policies that share a key count as one, whose matches meet one by one.
    """
    return _with_used_rows(_matches(policies, rates, chain, shown), rates, chain.key, payload)


def matched_groups_apart(policies: DataFrame, rates: DataFrame, chain: RuleChain, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """As ``matched_groups`` with the ids that a text shows and the name of the list of all ids, ``list_ids``; and every such list
    once, (list_ids, ids). A list grows as the card and many policies share it, so only its name goes with each of them."""
    lists = Lists(chain.key, "motor")
    matched = _with_used_rows(_matches(policies, rates, chain, None, lists.named), rates, chain.key, payload)
    return matched, lists.all()


class Lists:
    """Lists of ids of a card, kept apart from the policies they belong to. Names start from the ``card``, as cards may use one id."""

    def __init__(self, key: str, card: str):
        self.key, self.card, self.kept = key, card, []

    def named(self, found: DataFrame) -> DataFrame:
        """Rows with the first ids of ``group_keys`` and ``list_id``, a digest of them all."""
        digest = F.unhex(F.sha2(F.concat(F.lit(self.card), F.array_join("group_keys", ",")), 256))
        held = stage(found.withColumn("list_id", F.when(F.size("group_keys") > 0, digest)))
        self.kept.append(held.where("list_id IS NOT NULL").select(self.key, "list_id", F.col("group_keys").alias("ids")))
        return held.withColumn("group_keys", F.slice("group_keys", 1, SHOWN_IDS))

    def all(self) -> DataFrame:
        """(list_ids, ids): every list once; that of a policy is made of one list for each shard of its card."""
        held = reduce(DataFrame.unionByName, self.kept)
        parts = held.groupBy("list_id").agg(F.any_value("ids").alias("part"))
        whole = held.groupBy(self.key).agg(F.sort_array(F.collect_list("list_id")).alias("list_ids")).select("list_ids").distinct()
        return whole.withColumn("list_id", F.explode("list_ids")).join(parts, "list_id").groupBy("list_ids").agg(
            F.array_sort(F.flatten(F.collect_list("part"))).alias("ids"))


def list_names(found: DataFrame) -> list[Column]:
    """An aggregate with the names of a policy's lists, where lists were kept apart."""
    return [F.sort_array(F.collect_list("list_id")).alias("list_ids")] if "list_id" in found.columns else []


def _matches(policies: DataFrame, rates: DataFrame, chain: RuleChain, shown: int | None, named: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    key = chain.key
    shared = stage(policies.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    tests, same = [rule.test for rule in chain.rules], F.col(key).eqNullSafe(F.col("_key"))
    if shared.isEmpty():
        return _joined_shards(named(narrowed(policies, rates, tests, chain.block, key, groups=Groups(shown=shown))), key, shown)
    alone = narrowed(policies.join(shared, same, "left_anti"), rates, tests, chain.block, key, groups=Groups(shown=shown))
    several = narrowed(policies.join(shared, same, "left_semi"), rates, tests, chain.block, key, Groups().columns)
    together = named(_matches_by_group(several, key, shown))
    if "list_id" in together.columns:
        together = together.withColumn("list_ids", F.array_compact(F.array("list_id"))).drop("list_id")
    return _joined_shards(named(alone), key, shown).unionByName(together)


def _with_used_rows(matched: DataFrame, rates: DataFrame, key: str, payload: list[str]) -> DataFrame:
    row = F.struct(*[F.col(p) for p in payload]).alias("rate_row")
    used = rates.select(F.col("r_group").alias("_group"), F.col("r_place").alias("_used"), row)
    # policies without a match have keys of their own, so they don't meet on NULL
    own = F.coalesce(F.col("group_key"), -1 - F.xxhash64(key))
    return matched.join(used, (own == F.col("_group")) & (F.col("used") == F.col("_used")), "left").drop("used", "_used", "_group")


def _joined_shards(found: DataFrame, key: str, shown: int | None) -> DataFrame:
    """One row per policy over the shards of its card; a group lies in one of them."""
    shown = SHOWN_IDS if "list_id" in found.columns else shown
    keys = F.array_sort(F.flatten(F.collect_list("group_keys")))
    return found.groupBy(key).agg(
        F.max("mask").alias("mask"), F.sum("group_count").alias("group_count"), F.sum("row_count").alias("row_count"),
        (F.min("low_payout") == F.max("high_payout")).alias("same_payout"), F.min("group_key").alias("group_key"),
        F.min_by("used", "group_key").alias("used"), (keys if shown is None else F.slice(keys, 1, shown)).alias("group_keys"),
        *list_names(found),
    )


def _matches_by_group(found: DataFrame, key: str, shown: int | None) -> DataFrame:
    rows = found.repartition(key).select(key, "mask", F.explode_outer(F.arrays_zip(*Groups().columns)).alias("m"))
    groups = rows.groupBy(key, F.col("m.r_group").alias("group_key")).agg(
        F.max("mask").alias("mask"),
        F.count("m").alias("rows"),
        F.min("m.r_payout").alias("low_payout"),
        F.max("m.r_payout").alias("high_payout"),
        F.min("m.r_place").alias("used"),
    )
    out = collapse_groups(groups, key)
    return out if shown is None else out.withColumn("group_keys", F.slice("group_keys", 1, shown))


def collapse_groups(groups: DataFrame, key: str) -> DataFrame:
    """One row per policy over its matched groups; ``used`` is that of the lowest group. A group without a key is no match."""
    return groups.groupBy(key).agg(
        F.max("mask").alias("mask"),
        F.count("group_key").alias("group_count"),
        F.sum("rows").alias("row_count"),
        (F.min("low_payout") == F.max("high_payout")).alias("same_payout"),
        F.min("group_key").alias("group_key"),
        F.min_by("used", "group_key").alias("used"),
        F.array_sort(F.collect_list("group_key")).alias("group_keys"),
    )


def id_list_text() -> Column:
    """First ten ids, and how many more; the column ``group_keys`` may keep them all."""
    shown = F.array_join(F.transform(F.slice("group_keys", 1, SHOWN_IDS), lambda k: k.cast("string")), ", ")
    more = F.concat(F.lit(" … (+"), (F.col("group_count") - SHOWN_IDS).cast("string"), F.lit(" more)"))
    return F.concat(shown, F.when(F.col("group_count") > SHOWN_IDS, more).otherwise(F.lit("")))


def ambiguous_ids(column: str = "group_keys", kind: str = "array<bigint>") -> Column:
    """The ids in ``group_keys`` of a policy that several groups match; none for every other policy. ``list_ids`` likewise."""
    return F.when(F.col("mapping_status") == K.MULTIPLE, F.col(column)).otherwise(F.array().cast(kind))


def motor_payload() -> list[str]:
    sides = [f"r_{side}_{f}" for side in ("po", "pi") for f in ("type", "od_rate", "tp_rate", "net_rate", "flat_amount")]
    return [*sides, "r_add_tnc"]


def chosen_rate(side: str) -> Column:
    r = F.col("rate_row")
    return consolidated_rate(*[r[f"r_{side}_{f}"] for f in ("type", "od_rate", "tp_rate", "net_rate")])


# ---- rules from a table ---------------------------------------------------------------------------
def configured_rules(specs: list[dict]) -> list[Rule]:
    """Rules of a configuration: dicts with ``source``, ``operator``, ``target``, ``order`` and ``active``.

    Policy columns keep their name, rate columns carry the prefix ``r_``. EXACT treats a blank rate as a wildcard;
    WORD_MATCH asks for two shared words with one item of the list, CONTAINS for a shared substring; the RANGE
    operators read ``<target>_min`` and ``<target>_max`` (``from_date`` and ``to_date`` for dates).
    """
    rules = []
    for spec in sorted((s for s in specs if s["active"]), key=lambda s: s["order"]):
        p, target, op = F.col(spec["source"]), spec["target"], spec["operator"]
        if op == "EXACT":
            test = exact_or_wildcard(T.norm_text(f"r_{target}"), T.norm_text(p))
        elif op == "WORD_MATCH":
            # two shared words are a shared pair of words
            items = F.split(F.coalesce(F.col(f"r_{target}"), F.lit("")), ",")
            test = Tokens(word_pairs(T.model_words(p)), F.array_distinct(F.flatten(F.transform(items, lambda i: word_pairs(T.model_words(i))))))
        elif op == "CONTAINS":
            test = _contained(T.norm_text(f"r_{target}"), T.norm_text(p))
        elif op == "RANGE_DATE":
            test = Range(days(p), days(F.col("r_from_date")), days(F.col("r_to_date")))
        elif op in ("RANGE_CC", "RANGE_SC", "RANGE_AGE"):
            test = Range(p, F.col(f"r_{target}_min"), F.col(f"r_{target}_max"), op == "RANGE_AGE")
        else:
            raise ValueError(f"unknown operator {op!r}")
        shown = F.concat(F.lit("value '"), F.coalesce(p.cast("string"), F.lit("(blank)")), F.lit(f"' fails {op} on {target}"))
        rules.append(Rule(F.lit(spec["source"]), test, shown))
    return rules


def _contained(rate: Column, policy: Column) -> Tokens:
    """Blank rate matches anything; otherwise one text holds the other: each offers all pieces of itself."""
    def pieces(c: Column, mark: str) -> Column:
        starts = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
        cut = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.concat(F.lit(mark), F.substr(c, i, n))))
        return F.array_distinct(F.flatten(cut))

    asked = F.concat(F.array(F.lit("any")), F.when(policy != "", F.array(F.concat(F.lit("in:"), policy))).otherwise(F.array().cast("array<string>")), pieces(policy, "of:"))
    offered = F.when(rate == "", F.array(F.lit("any"))).otherwise(F.concat(pieces(rate, "in:"), F.array(F.concat(F.lit("of:"), rate))))
    return Tokens(asked, offered)


def configured_join(policies: DataFrame, rates: DataFrame, rules: list[Rule], block: str, key: str) -> DataFrame:
    """(key, mask, failed): keep-on-fail evaluation of a configured chain, from a bitmap index. ``rates`` carries ``r_`` names."""
    masks = indexed_masks(policies, rates, RuleChain(lead=[], tail=rules, block=block, key=key))
    return policies.join(masks, key, "left").withColumn("failed", F.array_compact(failed_segments(rules, F.col("mask"))))
