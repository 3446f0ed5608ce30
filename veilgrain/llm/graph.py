"""Connected components by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as a forest of stars: union by smallest id with path halving."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    pairs = [(x, find(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges`, whose first two columns are ids (long); root is the
    component's smallest id.

    Each partition first contracts its edges to stars.  Then large-star and small-star steps
    alternate until the edges are a forest of stars: every step only groups by a node and takes a
    minimum, so a hub costs a map-side combined aggregate.  An empty input gives an empty result.
    """
    a, b = edges.columns[:2]
    now = keep(
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    )  # a > b always
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every `a` has one `b`, and no `b` is an `a`."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    inner = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.union(inner).isEmpty()
