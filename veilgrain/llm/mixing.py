"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix has as many words as the input.  Its seats are blocks of `block` words.  Seats go to the
sources by highest quotients target / (2 s - 1); each source's seats go to its cells (hashed parts
of bounded size) by highest quotients again, which gives every cell an integer quota.  A cell's
documents, in hashed order, are one run of words cut into equal blocks; a seeded permutation says
which blocks are taken once more than the others.  Whether a block is taken is arithmetic on its
number, so no row is ever made for a block, and a window only ever spans one cell.  A block is of
about a paragraph's length; neighbouring blocks of a document are taken as one passage, as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep as stored
from veilgrain.llm.text import WORD

WEIGHTS = (5, 2, 1)
BLOCK = 128
MOST_COPIES = 3
CELL_WORDS = 2_000_000
STRIDE = 2147483629  # a prime, so it permutes the blocks of any cell that isn't a multiple of it
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of the parts and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code-point order, null last, weigh 5, 2, 1, repeating.  With a common factor f, a source
    gets min(f * weight, 3 * size), f being such that targets add up to all sizes: sources are taken in
    order of 3 * size / weight, and f is read off where the next source is no longer capped."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double"))
    capped = weighed.withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    levels = capped.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    factor = F.coalesce(F.max("level").over(everything), F.lit(0.0))
    return levels.withColumn("factor", factor).select("source", "source_size", "weight", F.least(F.col("factor") * F.col("weight"), F.col("cap")).alias("target"))


def apportioned(claims: DataFrame, group: list[str], key: list[str], claim: str, seats: str, name: str) -> DataFrame:
    """`claims` with the integer column `name`: `seats` of each group (a column, equal within it) dealt
    to its keys by highest quotients claim / (2 s - 1), ties by key.

    Rounding claim * seats / total gives each of n keys its seats within half a seat, and misses all seats by
    some number.  The divisor that misses none differs from that by so little that no key's seats change
    by more than claim * (missed + n) / total + 1, so that many of a key's next quotients are ranked: in all
    a few for each key, never all seats."""
    own = Window.partitionBy(*group) if group else Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(claim).over(own)
    ideal = F.when(total > 0, F.col(claim) * F.col(seats) / total).otherwise(0.0)
    df = claims.withColumn("_base", F.floor(ideal + 0.5).cast("long"))
    df = df.withColumn("_miss", F.col(seats) - F.sum("_base").over(own))
    df = df.withColumn("_reach", F.when(total > 0, F.ceil(F.col(claim) * (F.abs("_miss") + F.count("*").over(own)) / total) + 1).otherwise(F.abs("_miss")).cast("long"))
    # One candidate for each seat that a key might gain, or give back.
    one_seat = F.lit(1).cast("long")
    steps = F.when(F.col("_miss") > 0, F.sequence(one_seat, F.least("_miss", "_reach"))).when(F.col("_miss") < 0, F.sequence(one_seat - 1, F.greatest(F.col("_miss") + 1, 1 - F.col("_reach")), -one_seat))
    one = df.where("_miss <> 0").select(*group, *key, claim, "_base", "_miss", F.explode(steps).alias("_step"))
    one = one.withColumn("_quotient", F.col(claim) / (2 * (F.col("_base") + F.col("_step")) - 1)).where(F.col("_base") + F.col("_step") >= 1)
    up, keys = F.col("_miss") > 0, [F.col(k).asc_nulls_last() for k in key]
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = ranked.orderBy(F.when(up, -F.col("_quotient")).otherwise(F.col("_quotient")), *keys, F.abs("_step"))
    changed = one.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.abs("_miss"))
    changed = changed.groupBy(*[F.col(c).alias(f"_{c}") for c in (*group, *key)]).agg(F.sum(F.signum("_miss")).cast("long").alias("_change"))
    same = F.lit(True)
    for c in (*group, *key):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = df.join(changed, same, "left").withColumn(name, F.col("_base") + F.coalesce("_change", F.lit(0).cast("long")))
    return joined.drop("_base", "_miss", "_reach", "_change", *[f"_{c}" for c in (*group, *key)])


def plan(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` (with source, size, _order and _tie) with source_size, target, the words before the document in its
    cell (`offset`), the cell's words, blocks, quota and permutation shift.  The tables of sources and of cells, small ones,
    are stored on the way, so that no plan holds all steps."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(totals)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("cells", F.ceil(F.col("source_size") / F.lit(CELL_WORDS)).cast("long"))
    sources = sources.withColumn("seats", F.floor(F.sum("source_size").over(whole) / F.lit(block) + 0.5).cast("long"))
    sources = stored(apportioned(stored(sources), [], ["source"], "target", "seats", "source_seats"))
    named = sources.withColumnRenamed("source", "_source")
    placed = docs.join(named.select("_source", "source_size", "target", "cells"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    placed = placed.withColumn("cell", F.pmod("_order", F.greatest("cells", F.lit(1).cast("long"))))
    cells = placed.groupBy("source", "cell").agg(F.sum("size").alias("cell_words")).withColumn("blocks", F.greatest(F.lit(1.0), F.floor(F.col("cell_words") / block + 0.5)).cast("long"))
    cells = cells.withColumn("blocks", F.when(F.col("cell_words") > 0, F.col("blocks")).otherwise(F.lit(0).cast("long")))
    cells = cells.join(named.select("_source", "source_seats"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    most = F.sum("blocks").over(Window.partitionBy("source")) * MOST_COPIES
    cells = stored(cells.withColumn("_seats", F.least("source_seats", most)))
    cells = apportioned(cells, ["source"], ["cell"], "blocks", "_seats", "quota").withColumn("quota", F.least(F.col("quota"), F.col("blocks") * MOST_COPIES))
    cells = stored(cells.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), "cell_words", "blocks", "quota"))
    joined = placed.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell"))).drop("_source", "_cell")
    run = Window.partitionBy("source", "cell").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    shift = _hash(F.coalesce(F.col("source"), F.lit("")), F.col("cell").cast("string"))
    return joined.withColumn("offset", F.coalesce(F.sum("size").over(run), F.lit(0).cast("long"))).withColumn("shift", shift).drop("_order", "_tie", "cells")


def times(j: Column) -> Column:
    """How often block `j` of the row's cell is taken."""
    place = F.pmod(j * F.lit(STRIDE) + F.pmod(F.col("shift"), F.col("blocks")), F.col("blocks"))
    return F.floor(F.col("quota") / F.col("blocks")).cast("long") + (place < F.pmod(F.col("quota"), F.col("blocks"))).cast("long")


def block_of(word: Column) -> Column:
    """The block that holds a word of the cell, blocks being equal but for rounding."""
    return F.floor((word * F.col("blocks")) / F.col("cell_words")).cast("long")


def _pieces() -> Column:
    """(block, first word, end) of the row's words, positions counted in its cell."""
    first, last = block_of(F.col("offset")), block_of(F.col("offset") + F.col("size") - 1)

    def piece(j: Column) -> Column:
        begin = F.ceil((j * F.col("cell_words")) / F.col("blocks")).cast("long")
        end = F.ceil(((j + 1) * F.col("cell_words")) / F.col("blocks")).cast("long")
        return F.struct(
            times(j).alias("times"), F.greatest(begin, "offset").alias("begin"), F.least(end, F.col("offset") + F.col("size")).alias("end")
        )

    return F.when(F.col("size") > 0, F.transform(F.sequence(first, last), piece))


def mixed(docs: DataFrame, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces, and the columns `keep`) for each row of `docs`
    (doc_id, text, source).

    Size is the number of words, 0 for null.  `taken` counts the words that the mix takes from the row,
    repeats included, at most three times its size; `pieces` says which.  Rows without words take
    nothing; rows that repeat a doc_id are rows of their own, in the order of their texts' hashes; rows
    without an id are dealt by their text; an empty table gives an empty result; a null source is a
    source of its own, after all others."""
    text = F.col("text").cast("string")
    order = _hash(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit(""))))))
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), *[F.col(c).alias(f"keep_{c}") for c in keep], word_count("text").alias("size"), order.alias("_order"), F.xxhash64(text).alias("_tie"))
    df = plan(own if keep else stored(own), block).withColumn("pieces", _pieces())
    taken = F.coalesce(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["times"] * (p["end"] - p["begin"])), F.lit(0).cast("long"))
    return df.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "pieces", "offset", *[F.col(f"keep_{c}").alias(c) for c in keep])


def materialised(docs: DataFrame, columns: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """The mix itself, in the columns `columns` of `docs`: a row for each time that a document is taken whole,
    and one for each passage of it that is taken once more.  Passages are cut between words and are else as
    written, line breaks included."""
    df = mixed(docs, block, keep=tuple(c for c in columns if c != "doc_id")).where("taken > 0")
    df = df.withColumn("_whole", F.array_min(F.transform("pieces", lambda p: p["times"])).cast("int")).withColumn("_more", F.filter("pieces", lambda p: p["times"] > F.col("_whole")))
    # Neighbouring pieces are one passage: it begins where none ends, and ends where none begins.
    begins = F.filter("_more", lambda p, i: (i == 0) | (F.get("_more", i - 1)["end"] != p["begin"]))
    ends = F.filter("_more", lambda p, i: (i == F.size("_more") - 1) | (F.get("_more", i + 1)["begin"] != p["end"]))
    df = df.withColumn("_runs", F.zip_with(begins, ends, lambda x, y: F.struct((x["begin"] - F.col("offset") + 1).cast("int").alias("first"), (y["end"] - x["begin"]).cast("int").alias("n"))))
    blank = r"[\x20\x09-\x0D]"
    spaced = F.split(F.regexp_replace("text", f"^{blank}+", ""), rf"(?<={blank})(?=[^\x20\x09-\x0D])")  # each word with the blanks after it
    df = df.withColumn("_words", F.when(F.size("_runs") > 0, spaced))
    passages = F.transform("_runs", lambda r: F.regexp_replace(F.array_join(F.slice("_words", r["first"], r["n"]), ""), f"{blank}+$", ""))
    out = df.withColumn("_text", F.explode(F.concat(F.array_repeat("text", F.col("_whole")), passages)))
    shown = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in columns])
