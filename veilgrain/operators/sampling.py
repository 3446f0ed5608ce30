"""Stratified samples, splits and selections; choices follow a seeded hash, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(strata: DataFrame, n: int) -> DataFrame:
    """(stratum, size, chosen): n seats dealt by largest remainder; ties go to the larger stratum, then by
    name.  `strata` has one row for each stratum: (stratum, size)."""
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("size").over(whole)
    exact = F.least(F.lit(n), total) * F.col("size") / total
    df = strata.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    left = F.least(F.lit(n), total) - F.sum("_base").over(whole)
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_base")).desc(), F.col("size").desc(), "stratum"))
    return df.select("stratum", "size", (F.col("_base") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("chosen"))


def hash_order(seed: str, stratum: Column, item: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), stratum, item.cast("string")))


def stratified(df: DataFrame, stratum: Column, item: str, n: int, seed: str) -> DataFrame:
    """The rows of a stratified sample of n."""
    own = df.withColumn("stratum", stratum)
    counts = allocate(own.groupBy("stratum").agg(F.count("*").alias("size")), n)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(seed, F.col("stratum"), F.col(item)), item))
    return own.withColumn("_rank", rank).join(counts.select("stratum", "chosen"), "stratum").where(F.col("_rank") <= F.col("chosen")).drop("_rank", "chosen")


def split(df: DataFrame, stratum: Column, item: str, share: float, seed: str) -> DataFrame:
    """`df` with the column `part`: dev for the rounded share of each stratum (half to even), else test."""
    own = df.withColumn("stratum", stratum)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(seed, F.col("stratum"), F.col(item)), item))
    size = F.count("*").over(Window.partitionBy("stratum"))
    return own.withColumn("part", F.when(rank <= F.bround(size * F.lit(share)), "dev").otherwise("test"))


def selected(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a wanted key, and wanted keys that no row has."""
    return df.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(df, key, "left_anti")


def segments(df: DataFrame, text: str, language: Column, *keys: str) -> DataFrame:
    """(keys, segment_no, offset, segment_lang, n_lines): runs of lines of one language.  `language` is an
    expression of the column line; blank lines go with the line before."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    own = F.when(F.trim("line") != "", language)
    lines = lines.withColumn("segment_lang", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("en")))
    lines = lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = F.when(F.lag("segment_lang").over(w) == F.col("segment_lang"), 0).otherwise(1)
    lines = lines.withColumn("_new", new).withColumn("segment_no", F.sum("_new").over(w))
    return lines.groupBy(*keys, "segment_no").agg(F.min("offset").alias("offset"), F.first("segment_lang").alias("segment_lang"), F.count("*").alias("n_lines"))
