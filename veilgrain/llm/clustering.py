"""Centroid clustering on integers: float32 screening with rigorous intervals, exact decisions.

A vector's components become integers, floor(scale * x).  Every round assigns each vector to the nearest
centroid (squared Euclidean distance, ties to the smaller number) and replaces a centroid by the floor of
its vectors' mean.  All results are exact, so they depend on neither partitions nor machines:

* One float32 matrix product gives x.c for a block of vectors and all centroids.  Integers of at most
  2**23 are exact in float32, so only the product rounds, and by no more than g |x| |c|, where
  g = d u / (1 - d u) and u = 2**-24, whatever the order of its sums.  That makes an interval for
  |c|^2 - 2 x.c, which orders the centroids as the distance does.
* A centroid whose interval begins above the least upper end can't be nearest.  Where more than one is
  left, those distances are computed in 64-bit integers, and the least number of the nearest wins.
* Vectors, and centroids, with a larger component take the same decisions in Python's integers.

Tasks add up their vectors by cluster, so a round shuffles at most k (d + 1) sums from each task, and the
driver receives k (d + 1) numbers, however many vectors there are.  Sums are split in limbs of 32 bits, so
they can't overflow.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep

EXACT = 1 << 23  # largest component that the float32 screening takes
ROWS = 4096  # vectors screened by one product
LIMB = 32
_UNIT = 2.0**-24

Centroids = list[list[int]]


def eligible(vector: str | Column, dims: int) -> Column:
    """Exactly `dims` components, none null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & ~bad, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where all of them fit the screening, else Python's integers."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * scale)
    if not floors.size or np.abs(floors).max() <= EXACT:
        return floors.astype(np.int64)
    return np.array([[scale * int(x) if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in values.tolist()], dtype=object)


def _exact(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and distance of every row, by exact integers alone."""
    all_d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    near = all_d.argmin(axis=1).astype(np.int64)  # argmin takes the first of equals
    return near, all_d[np.arange(len(x)), near]


def _shortlists(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """True where a centroid may be nearest to a row: no other one is surely nearer."""
    dims = x.shape[1]
    product = (x.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
    g = dims * _UNIT / (1 - dims * _UNIT)
    squares = (centres * centres).sum(axis=1).astype(np.float64)  # exact: at most 2**53
    lengths = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)
    value = squares - 2 * product
    # The bound's own rounding, and that of `value`, are a few units of 2**-53.
    radius = 2 * g * lengths * (1 + 1e-12) + (squares + 2 * np.abs(product)) * 2.0**-50
    return value - radius <= (value + radius).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of `x`; exact."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if x.dtype == object or centres.dtype == object or x.shape[1] > 64:
        return _exact(x.astype(object), centres.astype(object))
    may = _shortlists(x, centres)
    near = may.argmax(axis=1)
    open_rows = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_rows):
        row, centre = np.nonzero(may[open_rows])
        d = ((x[open_rows[row]] - centres[centre]) ** 2).sum(axis=1)
        order = np.lexsort((centre, d, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        near[open_rows] = centre[first]
    return near, ((x - centres[near]) ** 2).sum(axis=1)


def _array(centroids: Centroids) -> np.ndarray:
    fits = max((abs(c) for row in centroids for c in row), default=0) <= EXACT
    return np.array(centroids, dtype=np.int64 if fits else object)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places in it, their integers); vectors that the screening can't take are blocks of their own."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            column = batch.column("vector")
            values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                wide = (np.abs(np.floor(values * scale)) > EXACT).any(axis=1)
            for where in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                if len(where):
                    yield batch, where, integers(values[where], scale)


def limbs(total: int) -> list[int]:
    """`total` as signed digits of LIMB bits, the least first."""
    out, sign, rest = [], 1 if total >= 0 else -1, abs(total)
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out or [0]


def _sums(centroids: Centroids, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _array(centroids)
        total: dict[tuple[int, int], int] = defaultdict(int)
        for _, _, x in _blocks(batches, dims, scale):
            near, _ = nearest(x, centres)
            for c in np.unique(near).tolist():
                own = x[near == c]
                total[c, -1] += len(own)
                for i, s in enumerate(own.sum(axis=0).tolist()):
                    total[c, i] += s
        rows = [(c, i, k, digit) for (c, i), s in total.items() for k, digit in enumerate(limbs(s))]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "limb", "total"])

    return run


def _assigned(centroids: Centroids, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _array(centroids)
        for batch, where, x in _blocks(batches, dims, scale):
            near, d = nearest(x, centres)
            kept = [int(v) if v < 1 << 63 else None for v in d.tolist()]
            ids = batch.column("vec_id").take(pa.array(where))
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(kept, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """The centroids after one round; those without vectors stay."""
    dims = len(centroids[0])
    sums = kept.mapInArrow(_sums(centroids, dims, scale), "cluster int, component int, limb int, total long")
    rows = sums.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k (dims + 1) times the limbs
    total: dict[tuple[int, int], int] = defaultdict(int)
    for r in rows:
        total[r.cluster, r.component] += int(r.total) << (LIMB * r.limb)
    return [[total[c, i] // total[c, -1] for i in range(dims)] if total[c, -1] else old for c, old in enumerate(centroids)]


def start(kept: DataFrame, k: int, scale: int, seed: str) -> Centroids:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`; null ids last, ties by the vectors themselves."""
    keyed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    rows = keyed.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return [integers(np.array([r.vector], dtype=np.float64), scale)[0].tolist() for r in rows]


def clusters(vectors: DataFrame, dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> tuple[DataFrame, Centroids]:
    """((vec_id, cluster, distance), centroids): one row for each vector of `vectors` (vec_id, embedding
    array of numbers; other columns are ignored) with exactly `dims` components, none null or non-finite;
    other rows, null vectors included, are left out.

    Fewer than k such vectors make as many centroids.  Equal vectors all get the smaller number of equal
    centroids, so a centroid may stay without vectors.  Repeated ids are vectors of their own; null ids
    start no centroid before all others do.  Components of any finite size are exact; a distance beyond 64
    bits is null.  No vector at all gives an empty result and no centroids.
    """
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(eligible("vector", dims))
    centroids = start(kept, k, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, scale)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(_assigned(centroids, dims, scale), f"vec_id {kind}, cluster int, distance long"), centroids


def described(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """`assigned` with each cluster's inertia, the inertia of all, and the SHA-256 of its centroid; sums
    beyond 64 bits, and sums over a distance that is null, are null."""
    spark = assigned.sparkSession
    assigned = keep(assigned)
    whole = F.try_sum(F.col("distance").cast("decimal(38,0)"))
    by = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("own")).collect()  # k rows
    own = {r.cluster: r.own for r in by}
    every = sum(own.values()) if all(v is not None for v in own.values()) else None
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    rows = [(c, fits(own.get(c)), fits(every), ",".join(map(str, centre))) for c, centre in enumerate(centroids) if c in own]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
