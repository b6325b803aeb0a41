"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets a verified identifier, and documents are compared by their
ordered identifier lists. The texts themselves move once, as distinct chunks; only lists of identifiers are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecraft.session import stage

MIN_CHARS = 256
MAX_CHARS = 4096


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The chunks of a text: a cut comes after white space that follows punctuation, or after a line end, ``min_chars`` apart at
    least; where no such place comes within ``max_chars``, the cut is there. Chunks put together give the text."""
    pattern = rf"(?s).{{{min_chars},{max_chars}}}?(?:(?<=[.,;:!?]\s)|(?<=\n))|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A chunk's identifier is its hash, verified: hashes that stand for more than one content are found by grouping the
    contents themselves, and such chunks get a number within the hash besides. Equal lists of identifiers then mean equal
    texts. ``hash_bits`` below 64 is for tests of that path.

    Null texts count as empty, and all empty texts are equal. Of equal texts the largest id stays; a null id loses against
    any other. Rows that repeat both id and text count one by one in group_size and share one fate. Other columns are
    not looked at. An empty table gives no rows. A group of any size is only counted before the shuffle and joined by
    list, so no task gathers it.
    """
    read = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    identifier = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits)
    cut = read.select("doc_id", chunks(F.col("text"), min_chars, max_chars).alias("chunks"))
    contents = cut.select(F.explode("chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = stage(contents.groupBy("h").count().where("count > 1").select("h"))

    recipes = read.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text"), min_chars, max_chars), identifier).alias("recipe"),
    )
    empty = F.array().cast("array<struct<pos:int,number:int>>")
    if shared.isEmpty():
        recipes = recipes.withColumn("numbers", empty)
    else:
        numbered = contents.join(shared, "h", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        places = cut.select("doc_id", F.sha2(F.concat_ws("", "chunks"), 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk"))
        places = places.withColumn("h", identifier(F.col("chunk"))).join(numbered, ["h", "chunk"])
        # a document's own chunks, told from those of another row of the same id by the text's digest
        numbers = places.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "number"))).alias("numbers"))
        same = recipes["doc_id"].eqNullSafe(numbers["doc_id"]) & (recipes["text_sha256"] == numbers["text_sha256"])
        recipes = recipes.join(numbers, same, "left").select(recipes["*"], F.coalesce(numbers["numbers"], empty).alias("numbers"))
    recipes = stage(recipes)
    # written first, so that the join has two plain exchanges and a very large group can be split
    groups = stage(recipes.groupBy("recipe", "numbers").agg(F.max("doc_id").alias("largest"), F.count("*").alias("size")).where("size > 1"))
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return recipes.join(groups, ["recipe", "numbers"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
