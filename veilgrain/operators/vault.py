"""Vault numbering, masking and restoring.

A value gets a placeholder <TYPE_n> for its conversation: n counts values of a type in order of first
appearance, and a value keeps the type of its first mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = r"[A-Z][A-Z_]*_\d+"
OPENERS, CLOSERS = r"(?:&lt;|<|＜|⟨|〈|《|\[\[|\[|［［|［|⟦|\{\{|｛｛)", r"(?:&gt;|>|＞|⟩|〉|》|\]\]|\]|］］|］|⟧|\}\}|｝｝)"


def identity(value: Column) -> Column:
    """A value's identity inside the JVM: lower case, single blanks, trimmed.  `functions.normalize` has the
    full form with NFKC and case folding."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def numbered(spans: DataFrame, conversation: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """(conversation, norm, type, number, placeholder): one row for each value of a conversation.

    `spans` has (conversation, order columns, type, text).  `known` has mappings of earlier turns in the
    same form; numbering goes on from their largest number of a type."""
    own = spans.withColumn("norm", identity(F.col("text")))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(conversation, "norm").orderBy(*order))).where("_n = 1")
    if known is not None:
        first = first.join(known.select(conversation, "norm"), [conversation, "norm"], "left_anti")
    number = F.row_number().over(Window.partitionBy(conversation, "type").orderBy(*order))
    fresh = first.withColumn("number", number)
    if known is not None:
        top = known.groupBy(conversation, "type").agg(F.max("number").alias("_top"))
        fresh = fresh.join(top, [conversation, "type"], "left").withColumn("number", F.col("number") + F.coalesce("_top", F.lit(0)))
    columns = [conversation, "norm", "type", F.col("number").cast("long").alias("number"), F.concat(F.lit("<"), F.col("type"), F.lit("_"), F.col("number").cast("string"), F.lit(">")).alias("placeholder")]
    return fresh.select(*columns) if known is None else known.select(conversation, "norm", "type", "number", "placeholder").unionByName(fresh.select(*columns))


def masked(slots: DataFrame, spans: DataFrame, mappings: DataFrame, key: str, conversation: str, text: str = "text") -> DataFrame:
    """`slots` with the column `masked`: every span (key, start, end, text; not overlapping) replaced by its
    placeholder.  Rebuilt in the JVM: the pieces between spans and the placeholders, in order."""
    placed = spans.withColumn("norm", identity(F.col("text"))).join(mappings.select(conversation, "norm", "placeholder"), [conversation, "norm"])
    grouped = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(
        "_spans",
        start,
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), s["placeholder"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    return slots.join(grouped, key, "left").withColumn("masked", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(body)).drop("_spans")


def canonical(text: Column) -> Column:
    """Placeholders in any bracket style as <KEY>."""
    return F.regexp_replace(text, rf"{OPENERS}\s*({KEY})\s*{CLOSERS}", "<$1>")


def restored(slots: DataFrame, mappings: DataFrame, conversation: str, text: str = "text") -> DataFrame:
    """`slots` with the column `restored`: known placeholders replaced by `original` of `mappings`
    (conversation, placeholder, original); unknown ones stay.  Mappings of a conversation travel as one map."""
    maps = mappings.groupBy(conversation).agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "original"))).alias("_map"))
    parts = F.split(F.regexp_replace(canonical(F.col(text)), f"(<{KEY}>)", "\u0001$1\u0001"), "\u0001")
    whole = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(F.col("_map"), p), p)), "")
    return slots.join(maps, conversation, "left").withColumn("restored", F.when(F.col("_map").isNull(), F.col(text)).otherwise(whole)).drop("_map")


def only_placeholders(text: Column) -> Column:
    """Nothing but placeholders, digits and marks is left, so no model needs to look."""
    return ~F.rlike(F.regexp_replace(text, f"<{KEY}>", ""), F.lit(r"\p{L}"))


def add_missing(table: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore."""
    return table.unionByName(more.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def removed(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def loaded(mappings: DataFrame, conversation: str, at: str = "created_at") -> DataFrame:
    """(conversation, mappings): each conversation's mappings (original, type, action, value) in order of their time."""
    kept = F.array_sort(F.collect_list(F.struct(at, "original", "type", "action", "value")))
    return mappings.groupBy(conversation).agg(F.transform(kept, lambda m: F.struct(m["original"].alias("original"), m["type"].alias("type"), m["action"].alias("action"), m["value"].alias("value"))).alias("mappings"))


def reset(terms: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(no terms, no mappings, (terms_removed, mappings_removed)): a vault that has forgotten everything."""
    removed_ = terms.agg(F.count("*").alias("terms_removed")).crossJoin(mappings.agg(F.count("*").alias("mappings_removed")))  # a row each
    return terms.limit(0), mappings.limit(0), removed_


def conversation_id(first_message: Column) -> Column:
    return F.concat(F.lit("conv_"), F.substring(F.sha2(first_message, 256), 1, 24))
