"""Resolving free values against masters and rate cards.

Every resolver works on *distinct* values and is an equi-join on tokens that any match must share, so it neither
compares everything with everything nor loses a match. The caller joins the result back on the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecraft import constants as K
from ratecraft.functions.clusters import alnum_tokens, split_list
from ratecraft.functions.similarity import ratio, similarity, token_set_ratio, token_sort_ratio
from ratecraft.functions.text import (
    insurer_key_tokens, lowered, model_words, norm_text, normalize_plan_name, present, strip, word_match,
)
from ratecraft.operators.skew import first_per_group, grid_join
from ratecraft.session import stage

_NO_TOKEN = ""


# ---- insurers -------------------------------------------------------------------------------------
def insurer_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate (source, target) insurer names with their Jaccard score.

    ``sources`` and ``targets`` have one column ``name``. A pair of names that both have key tokens can only reach the
    threshold when it shares one, so those meet on a token; a name made of stop words alone is scored on its letters
    and can only score when it shares one, so it meets the others on letters.
    """
    src = sources.select(lowered("name").alias("source")).where("source <> ''").distinct()
    tgt = targets.select(lowered("name").alias("target")).where("target <> ''").distinct()
    src = src.withColumn("source_keys", insurer_key_tokens("source"))
    tgt = tgt.withColumn("target_keys", insurer_key_tokens("target"))
    by_token = src.withColumn("token", F.explode("source_keys")).join(
        tgt.withColumn("token", F.explode("target_keys")), "token"
    )

    def letters(c: str) -> Column:
        return F.explode(F.array_distinct(F.split(F.regexp_replace(c, r"\s", ""), "")))

    keyless = src.withColumn("token", letters("source")).join(tgt.withColumn("token", letters("target")), "token")
    keyless = keyless.where((F.size("source_keys") == 0) | (F.size("target_keys") == 0))
    columns = ["source", "target", "source_keys", "target_keys"]
    pairs = by_token.select(columns).unionByName(keyless.select(columns)).distinct()
    shared = F.size(F.array_intersect("source_keys", "target_keys"))
    either = F.size(F.array_union("source_keys", "target_keys"))
    has_keys = (F.size("source_keys") > 0) & (F.size("target_keys") > 0)
    return pairs.select("source", "target", F.when(has_keys, shared / either).alias("jaccard"))


def resolve_insurers(sources: DataFrame, targets: DataFrame, threshold: float = K.INSURER_SCORE_MIN) -> DataFrame:
    """(source, insurer): the best-scoring target of every source that reaches the threshold; ties go to the smaller name."""
    weighted = similarity("weighted_ratio", F.col("source"), F.col("target"))
    scored = insurer_pairs(sources, targets).withColumn("weighted", weighted)
    total = F.when(F.col("jaccard").isNull(), F.col("weighted")).otherwise(
        F.col("jaccard") * 80 + F.col("weighted") * 0.20
    )
    best = scored.withColumn("score", total).groupBy("source").agg(
        F.min_by("target", F.struct(-F.col("score"), F.col("target"))).alias("insurer"), F.max("score").alias("score")
    )
    return best.where(F.col("score") >= threshold)


# ---- codes listed in clusters ---------------------------------------------------------------------
def cluster_long(master: DataFrame) -> DataFrame:
    """(name, item): one row per upper-case item of a (name, cluster) master."""
    return (
        master.select(F.lower(strip("name")).alias("name"), F.explode(split_list("cluster")).alias("item"))
        .withColumn("item", F.upper("item"))
        .distinct()
    )


def resolve_codes(terms: DataFrame, master: DataFrame) -> DataFrame:
    """(term, name): the masters whose cluster lists the term as an item or as a whole word of an item.

    ``terms`` has one column ``term``; ``master`` has ``name`` and ``cluster``.
    """
    # both branches read the distinct terms; without the table each would normalise every row again, once a filter
    wanted = stage(terms.select(F.upper(strip("term")).alias("term")).where("term <> ''").distinct())
    wanted = wanted.withColumn("token", F.regexp_extract("term", "[A-Z0-9]+", 0))
    items = cluster_long(master)
    tokens = items.select("name", "item", F.explode(F.array_union(alnum_tokens(F.col("item")), F.array(F.lit(_NO_TOKEN)))).alias("token"))
    plain = wanted.where("term = token")
    by_token = plain.join(tokens.where("token <> ''").select("name", "token").distinct(), "token")
    other = wanted.where("term <> token").join(tokens, "token")
    by_text = other.where((F.col("item") == F.col("term")) | word_match(F.col("item"), F.col("term")))
    return by_token.select("term", "name").unionByName(by_text.select("term", "name")).distinct()


def resolve_models(terms: DataFrame, master: DataFrame) -> DataFrame:
    """(term, name): the masters with an item that shares at least two distinct words with the term.

    Two shared words means a shared *pair* of words, so the join key is the pair. That is far more selective than
    joining on single words and counting, where one common make would meet itself in every item.
    """
    wanted = terms.select(F.upper(strip("term")).alias("term")).where("term <> ''").distinct()
    items = cluster_long(master)
    left = wanted.select("term", F.explode(word_pairs(model_words("term"))).alias("pair"))
    right = items.select("name", F.explode(word_pairs(model_words("item"))).alias("pair")).distinct()
    return left.join(right, "pair").select("term", "name").distinct()


def word_pairs(words: Column) -> Column:
    """All unordered pairs of distinct words."""
    ordered = F.array_sort(words)
    return F.flatten(
        F.transform(
            ordered,
            lambda a, i: F.transform(
                F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.concat(a, F.lit(" "), b)
            ),
        )
    )


def name_arrays(resolved: DataFrame) -> DataFrame:
    """(term, names): sorted master names per term; at most one entry per master."""
    return resolved.groupBy("term").agg(F.array_sort(F.collect_set("name")).alias("names"))


def with_spellings(terms: DataFrame, spellings: DataFrame) -> DataFrame:
    """(term, spelling): the term itself and every spelling mapped together with it.

    ``spellings`` has ``mapping_id`` and ``value``.
    """
    own = terms.select(F.upper(strip("term")).alias("term")).where("term <> ''").distinct()
    values = spellings.select("mapping_id", F.upper(strip("value")).alias("value")).distinct()
    linked = (
        own.join(values.withColumnRenamed("value", "term"), "term")
        .join(values, "mapping_id")
        .select("term", F.col("value").alias("spelling"))
    )
    return own.select("term", F.col("term").alias("spelling")).unionByName(linked).distinct()


def resolve_search_terms(terms: DataFrame, spellings: DataFrame, master: DataFrame) -> DataFrame:
    """(term, name): masters that list the term or any spelling linked to it."""
    expanded = with_spellings(terms, spellings)
    hits = resolve_codes(expanded.select(F.col("spelling").alias("term")), master)
    return expanded.join(hits.withColumnRenamed("term", "spelling"), "spelling").select("term", "name").distinct()


# ---- fuzzy value pairs ----------------------------------------------------------------------------
def _grams(c: Column) -> Column:
    """Two-letter grams, numbered so that a repeated gram counts as often as it occurs."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))
    grams = F.when(F.length(c) >= 2, grams).otherwise(F.array().cast("array<string>"))
    return F.transform(
        grams,
        lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")),
    )


def close_pairs(left: DataFrame, right: DataFrame, block: str, minimum: float) -> DataFrame:
    """(block, a, b) candidates that may reach an indel ratio of ``minimum`` percent, none lost.

    ``left`` has ``block`` and ``a``, ``right`` has ``block`` and ``b``, both distinct. With S the sum of the lengths and
    r the ratio, at most S(1-r) single-character edits separate the two, and at least S(3r-2)/2 - 1 of the two-letter
    grams survive them. Pairs are counted on shared grams; pairs too short for the bound meet on a shared letter.
    """
    share = (3 * minimum / 100 - 2) / 2
    short = int(1 / share) + 1
    a = left.withColumn("gram", F.explode(_grams(F.col("a"))))
    b = right.withColumn("gram", F.explode(_grams(F.col("b"))))
    total = F.length("a") + F.length("b")
    counted = a.join(b, [block, "gram"]).groupBy(block, "a", "b").agg(F.count("*").alias("shared"))
    survive = counted.where(F.col("shared") >= total * F.lit(share) - 1).select(block, "a", "b")

    def letters(df: DataFrame, c: str) -> DataFrame:
        return df.where(F.length(c) < short).withColumn("gram", F.explode(F.array_distinct(F.split(F.col(c), ""))))

    brief = letters(left, "a").join(letters(right, "b"), [block, "gram"]).where(total <= short)
    return survive.unionByName(brief.select(block, "a", "b")).distinct()


def contained_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """(block, a, b) where one text contains the other: the first two letters of the shorter are a gram of the longer."""
    def starts(c: str) -> Column:
        return F.substring(F.col(c), 1, 2)

    def inside(c: str) -> Column:
        text = F.col(c)
        pieces = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(2)))
        singles = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
        return F.array_distinct(F.concat(pieces, singles))

    filled_left, filled_right = left.where("a <> ''"), right.where("b <> ''")
    a_in_b = filled_left.withColumn("gram", starts("a")).join(
        filled_right.withColumn("gram", F.explode(inside("b"))), [block, "gram"]
    )
    b_in_a = filled_left.withColumn("gram", F.explode(inside("a"))).join(
        filled_right.withColumn("gram", starts("b")), [block, "gram"]
    )
    found = a_in_b.where(F.contains("b", "a")).unionByName(b_in_a.where(F.contains("a", "b")))
    return found.select(block, "a", "b").distinct()


def fuzzy_category_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """(block, a, b): values that are equal, contain one another, or have a ratio above 75."""
    close = close_pairs(left, right, block, K.CATEGORY_RATIO_ABOVE)
    close = close.where(ratio(F.col("a"), F.col("b")) > K.CATEGORY_RATIO_ABOVE)
    return contained_pairs(left, right, block).unionByName(close).distinct()


def fuzzy_plan_pairs(plans: DataFrame, lists: DataFrame, block: str) -> DataFrame:
    """(block, a, b): plan names and plan lists with an item of token-sorted ratio 80 or more.

    ``plans`` has ``block`` and ``a``; ``lists`` has ``block`` and ``b``, a comma-separated list.
    """
    def sorted_tokens(c: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: t != "")), " ")

    left = plans.select(block, "a", normalize_plan_name("a").alias("a_norm")).where("a_norm <> ''")
    left = left.withColumn("a_sorted", sorted_tokens(F.col("a_norm")))
    right = lists.select(block, "b", F.explode(split_list("b")).alias("item"))
    right = right.select(block, "b", sorted_tokens(normalize_plan_name("item")).alias("b_sorted")).distinct()
    a = left.select(block, F.col("a_sorted").alias("a")).distinct()
    b = right.select(block, F.col("b_sorted").alias("b")).distinct()
    close = close_pairs(a, b, block, K.PLAN_RATIO_MIN)
    close = close.where(ratio(F.col("a"), F.col("b")) >= K.PLAN_RATIO_MIN)
    close = close.select(block, F.col("a").alias("a_sorted"), F.col("b").alias("b_sorted"))
    return (
        left.join(close, [block, "a_sorted"]).join(right, [block, "b_sorted"]).select(block, "a", "b").distinct()
    )


# ---- spelling suggestions -------------------------------------------------------------------------
def default_process(c: Column) -> Column:
    """Lower case, everything that is no letter or digit as a blank, ends trimmed."""
    return strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "))


def suggest_spellings(values: DataFrame, master: DataFrame, limit: int | None = None) -> DataFrame:
    """(value, item, score, tie): cluster items that look like another spelling of a value, all of them or the ``limit`` best.

    A pair scores 90 by its token sets only if it shares a word, or if the texts as a whole are that close.
    """
    def prepared(df: DataFrame, name: str, out: str) -> DataFrame:
        d = df.select(F.upper(strip(name)).alias(f"{out}_raw")).where(f"{out}_raw <> ''").distinct()
        d = d.withColumn(out, default_process(F.col(f"{out}_raw")))
        tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.col(out), r"\s+"), lambda t: t != "")))
        return d.withColumn(f"{out}_words", tokens)

    left = prepared(values.withColumnRenamed("value", "v"), "v", "a")
    right = prepared(cluster_long(master).select("item").distinct(), "item", "b").where(F.size("b_words") >= 2)
    shared = grid_join(
        left.select("a", F.explode("a_words").alias("word")).distinct(),
        right.select("b", F.explode("b_words").alias("word")).distinct(),
        ["word"], ("a", "b"), F.lit(True),
    )
    a = left.select(F.lit(1).alias("all"), F.array_join("a_words", " ").alias("a")).distinct()
    b = right.select(F.lit(1).alias("all"), F.array_join("b_words", " ").alias("b")).distinct()
    whole = close_pairs(a, b, "all", K.SPELLING_RATIO_MIN)
    whole = (
        whole.select(F.col("a").alias("aw"), F.col("b").alias("bw"))
        .join(left.select(F.array_join("a_words", " ").alias("aw"), "a").distinct(), "aw")
        .join(right.select(F.array_join("b_words", " ").alias("bw"), "b").distinct(), "bw")
    )
    pairs = shared.select("a", "b").unionByName(whole.select("a", "b")).distinct()
    pairs = pairs.withColumn("score", token_set_ratio(F.col("a"), F.col("b")))
    pairs = pairs.where(F.col("score") >= K.SPELLING_RATIO_MIN)
    pairs = pairs.withColumn("tie", token_sort_ratio(F.col("a"), F.col("b")))
    named = (
        pairs.join(left.select("a", F.col("a_raw").alias("value")), "a")
        .join(right.select("b", F.col("b_raw").alias("item")), "b")
        .where("value <> item")
        .select("value", "item", "score", "tie")
    )
    if limit is None:
        return named
    return first_per_group(named, ["value"], [F.desc("score"), F.desc("tie"), F.asc("item")], limit)


def item_index(master: DataFrame) -> DataFrame:
    """(item, groups): every cluster item with the sorted names of the groups that list it."""
    long = master.select(strip("name").alias("name"), F.explode(split_list("cluster")).alias("item"))
    long = long.withColumn("item", F.upper("item"))
    return long.groupBy("item").agg(F.array_sort(F.collect_set("name")).alias("groups"))


def with_mapping(values: DataFrame, spellings: DataFrame) -> DataFrame:
    """(value, mapping_id, mapping_name): the mapping a value already belongs to, NULL where none."""
    mapped = spellings.select(F.upper(strip("value")).alias("value"), "mapping_id", "mapping_name").distinct()
    return values.select(F.upper(strip("value")).alias("value")).distinct().join(mapped, "value", "left")


__all__ = [
    "close_pairs", "cluster_long", "contained_pairs", "fuzzy_category_pairs", "fuzzy_plan_pairs", "insurer_pairs",
    "item_index", "name_arrays", "norm_text", "present", "resolve_codes", "resolve_insurers", "resolve_models",
    "resolve_search_terms", "suggest_spellings", "with_mapping", "with_spellings", "word_pairs",
]
