"""Merkle dataset manifest: a hash tree over each language's documents, and one over the languages.

A row's leaf is a SHA-256 over its fields.  Leaves of a language stand in the order of their ids; every two
consecutive nodes (at the end of a level perhaps one) make the node above, until one is left.  The roots of
the languages make the last tree in the same way.

Leaves are numbered from a stored, range-partitioned table, so no language need fit in one task.  Aligned
blocks of 2**BLOCK_LEVELS leaves then meet in one Arrow table each, where DuckDB climbs a level with one
query, an ordered string_agg and its sha256.  Block roots are the nodes of the next tier, handled the same
way until each tree has one root.  A last pass gives each block the path from its root to the root of all,
which its rows share, so paths are never stored for single rows.
"""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep

BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7  # rows whose id's checksum it divides are tampered with
_connection: list[duckdb.DuckDBPyConnection] = []


def _duck() -> duckdb.DuckDBPyConnection:
    """This worker's engine; it sees one block at a time, in memory."""
    if not _connection:
        _connection.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}))
    return _connection[0]


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered): g orders the languages, null first; `tampered` is null where it is the leaf."""
    odd = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(odd, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    return docs.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("g"), "doc_id", leaf().alias("leaf"), tampered.alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with i, their number within g by `order`, and n, the rows of g.

    Rows are ranged by (g, order) and stored with their partition and place; a table of counts, a row for each
    partition and g, gives the offsets.  Rows equal in all of `order` may stand in any order; an arrival
    number parts them among ranges, if there are many."""
    arrived = rows.withColumn("_arrival", F.monotonically_increasing_id())
    placed = arrived.repartitionByRange("g", *order, "_arrival").sortWithinPartitions("g", *order, "_arrival").drop("_arrival").withColumn("_at", F.monotonically_increasing_id())
    placed = keep(placed.withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy("g", "_part").agg(F.count("*").alias("c"), F.min("_at").alias("_first"))
    counts = keep(counts).selectExpr("g", "_part", "_first", "sum(c) OVER (PARTITION BY g ORDER BY _part) - c AS _before", "sum(c) OVER (PARTITION BY g) AS n")
    out = placed.join(counts, ["g", "_part"])
    return out.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _climb(con: duckdb.DuckDBPyConnection, nodes: pa.Table, levels: int) -> list[str]:
    """Names of the block's tables (i, h), from its nodes to `levels` above them."""
    con.register("given", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT i, h FROM given")
    for k in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level_{k + 1} AS SELECT i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM level_{k} GROUP BY i // 2")
    return [f"level_{k}" for k in range(levels + 1)]


def _levels(n: int, most: int) -> int:
    """Levels that a block of a tree of n nodes climbs."""
    return min(most, (n - 1).bit_length())


def _roots(most: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        con, n = _duck(), block.column("n")[0].as_py()
        top = _climb(con, block.select(["i", "h"]), _levels(n, most))[-1]
        root = con.execute(f"SELECT h FROM {top}").fetchall()[0][0]
        size = 1 << most
        return pa.table({"g": [block.column("g")[0].as_py()], "i": pa.array([block.column("i")[0].as_py() >> most], pa.int64()), "n": pa.array([(n + size - 1) // size], pa.int64()), "h": [root]})

    return run


def _sides(levels: list[str]) -> tuple[str, str]:
    """SQL for a row's siblings s0, s1, ... in the block: their columns, and the joins that find them."""
    below = range(len(levels) - 1)
    return "".join(f", s{k}.h AS s{k}" for k in below), " ".join(f"LEFT JOIN {levels[k]} s{k} ON s{k}.i = xor(b.i >> {k}, 1)" for k in below)


PATH = "array<struct<left: boolean, h: string>>"


def _paths(most: int) -> Callable[[pa.Table], pa.Table]:
    """Each node's path inside its block, from below: `left` where the sibling stands left, h null where there is none."""

    def run(block: pa.Table) -> pa.Table:
        con, n = _duck(), block.column("n")[0].as_py()
        levels = _climb(con, block.select(["i", "h"]), _levels(n, most))
        columns, joins = _sides(levels)
        steps = ", ".join(f"{{'left': (i >> {k}) & 1 = 1, 'h': s{k}}}" for k in range(len(levels) - 1))
        con.register("given", block)
        return con.sql(f"SELECT g, i, [{steps}]::STRUCT(\"left\" BOOLEAN, h VARCHAR)[] AS path FROM (SELECT b.g, b.i{columns} FROM given b {joins})").to_arrow_table()

    return run


def outer_paths(nodes: DataFrame, most: int) -> DataFrame:
    """(g, i, path, root) of nodes (g, i, n, h): the steps from each node to its tree's root."""
    nodes = keep(nodes)
    block = F.shiftright("i", most).alias("block")
    above = nodes.groupBy("g", block).applyInArrow(_roots(most), "g string, i long, n long, h string")
    inner = nodes.groupBy("g", block).applyInArrow(_paths(most), f"g string, i long, path {PATH}")
    above = keep(above)
    if (above.agg(F.max("n")).first()[0] or 1) == 1:
        return inner.join(above.select("g", F.col("h").alias("root")), "g")
    up = outer_paths(above, most).select("g", F.col("i").alias("block"), F.col("path").alias("up"), "root")
    joined = inner.withColumn("block", F.shiftright("i", most)).join(up, ["g", "block"])
    return joined.select("g", "i", F.concat("path", "up").alias("path"), "root")


def _proved(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Proofs of a block's rows: steps inside it, and the path above that it was given."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        con, n = _duck(), block.column("n")[0].as_py()
        outer = above.column("path")[0].as_py()
        levels = _climb(con, block.select(["i", "leaf"]).rename_columns(["i", "h"]), _levels(n, most))
        columns, joins = _sides(levels)
        known = [f"s{k}" for k in range(len(levels) - 1)]
        sql = f"SELECT b.i, b.doc_id, b.leaf, coalesce(b.tampered, b.leaf) AS f{columns} FROM given b {joins}"
        for k, s in enumerate(known):  # each step folds once more over the query below it
            sql = f"SELECT * REPLACE (sha256(CASE WHEN (i >> {k}) & 1 = 1 THEN coalesce({s}, '') || f ELSE f || coalesce({s}, '') END) AS f) FROM ({sql})"
        bound: list[str] = []
        for step in outer:
            sql = f"SELECT * REPLACE (sha256(? || f || ?) AS f) FROM ({sql})"
            sibling = step["h"] or ""
            bound = [sibling, "", *bound] if step["left"] else ["", sibling, *bound]  # counted from the outermost query
        proof = "sha256(concat(" + "".join(f"coalesce({s}, ''), " for s in known) + "?))"
        con.register("given", block)
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        text = "".join(step["h"] or "" for step in outer)
        return con.sql(f"SELECT doc_id, leaf, ? AS subroot, ? AS root, {proof} AS proof_sha256, f AS folded_root, f = ? AS verified FROM ({sql})", params=[subroot, root, text, root, *bound]).to_arrow_table()

    return run


def manifest(docs: DataFrame, most: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of `docs`
    (doc_id, source, lang, n_chars, text; other columns are ignored).

    Null languages are one group, before the others; null ids come first.  Rows that share an id stand in the
    order of their leaves; equal rows are equal leaves, each with a place and a proof of its own.  A row
    without n_chars or without an id isn't tampered with.  A null text, source or language is `-`, an
    empty one `0:`.  An empty table has an empty manifest.  Blocks have 2**most leaves; the result doesn't
    depend on it."""
    rows = keep(numbered(keep(leaves(docs)), ["doc_id", "leaf"]))
    block = F.shiftright("i", most).alias("block")
    roots = keep(rows.select("g", "i", "n", F.col("leaf").alias("h")).groupBy("g", block).applyInArrow(_roots(most), "g string, i long, n long, h string"))
    within = keep(outer_paths(roots, most))  # a row for each block
    subroots = within.groupBy("g").agg(F.first("root").alias("h")).select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    ranked = keep(numbered(subroots, ["of"]))
    top = outer_paths(ranked.select("g", "i", "n", "h"), most).join(ranked.select("i", "of"), "i").select(F.col("of").alias("g"), F.col("path").alias("top"), F.col("root").alias("all"))
    above = within.join(top, "g").select("g", F.col("i").alias("block"), F.concat("path", "top").alias("path"), F.col("root").alias("subroot"), F.col("all").alias("root"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    own = rows.withColumn("block", F.shiftright("i", most))
    return own.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_proved(most), out)
