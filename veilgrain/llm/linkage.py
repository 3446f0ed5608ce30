"""Classes of similar items from banded buckets: star candidates, exact verification, union-find.

Every two items of a bucket are compared exactly, shown by a bound not to link, or of one class already:

1. every item against one centre, a member of one of its buckets;
2. every item against the centres of its other buckets, unless step 1 linked both to one centre;
3. in buckets that still hold several classes, all pairs of different classes.  A bucket of at most SMALL
   items gives its pairs, so SMALL / 2 for each item at most; pairs that several buckets give are compared
   once.  A larger one is dealt out in blocks of BLOCK_BYTES, each pair of blocks to a task, which leaves out
   pairs that can't link: similar items share a token among the rarest of either one.

Of the MOST_CROWDED buckets that a sample finds most crowded none comes together in one place: a sampled member is
its centre, sent to its rows where they are.  The others are streamed in order, the least member being the centre,
and nothing else of a bucket is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.graph import components
from veilgrain.llm.scratch import keep
from veilgrain.llm.text import small_batches, text_bytes

Similarity = Callable[[list[bytes], list[bytes]], np.ndarray]
Features = Callable[[list[bytes]], Iterable[tuple[np.ndarray, np.ndarray]]]
SMALL = 16
BLOCK_BYTES = 4 << 20  # of texts in a block of step 3
MOST_TOKENS = 4 << 20  # compared at a time in step 3
PAIR_BYTES = 256 << 10  # of pairs compared together
DENSE = 2 << 20  # cells of a table of items and tokens, and of a product, up to which a task's items are compared by products
SAMPLE, CROWDED, MOST_CROWDED = 16, 32, 1000  # one id in so many is sampled; rows of a crowded bucket among them; buckets, which bounds the broadcast


def _in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, centre) of the buckets with several ids, from rows (bucket, id, centre) in order of buckets and ids;
    rows that have a centre already pass.  A bucket's first id is its centre.  Of a bucket that goes on, only its
    centre and its last id are held, whatever its size."""
    held: tuple[int, int, int, bool] | None = None  # bucket, centre, last id, whether several ids were met
    for batch in batches:
        alone = batch.column("centre").is_null()
        if batch.column("centre").null_count < batch.num_rows:
            yield batch.filter(pc.invert(alone))
            batch = batch.filter(alone)
        if not batch.num_rows:
            continue
        bucket, item = batch.column("bucket").to_numpy(), batch.column("id").to_numpy()
        new = np.ones(len(bucket), dtype=bool)
        new[1:] = bucket[1:] != bucket[:-1]
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        goes_on = held is not None and held[0] == bucket[0]
        if goes_on:
            new[0], fresh[0] = False, item[0] != held[2]
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - (0 if goes_on else 1)  # run 0 is the held bucket, where it goes on
        centre, name = item[begin], bucket[begin]
        if goes_on:
            centre, name = np.insert(centre, 0, held[1]), np.insert(name, 0, held[0])
        later = fresh & ~new
        several = np.bincount(run[later], minlength=len(centre)) > 0
        first = several.copy()
        if goes_on:
            first[0] &= not held[3]
            several[0] |= held[3]
        columns = (np.concatenate([name[first], bucket[later]]), np.concatenate([centre[first], item[later]]), np.concatenate([centre[first], centre[run[later]]]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["bucket", "id", "centre"])
        held = int(name[-1]), int(centre[-1]), int(item[-1]), bool(several[-1])


def members_of(met: DataFrame) -> DataFrame:
    """(bucket, id, centre) of buckets with several ids, the centre being one of them; `met` has (bucket, id), and
    its rows may repeat.  The sample only decides how a bucket's rows meet and which of them is the centre."""
    some = met.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLE)) == 0).groupBy("bucket").agg(F.count_distinct("id").alias("n"), F.min("id").alias("centre"))
    crowded = keep(some.where(F.col("n") >= CROWDED).orderBy(F.desc("n"), "bucket").limit(MOST_CROWDED).select("bucket", "centre"))
    marked = met.join(F.broadcast(crowded), "bucket", "left").select("bucket", "id", "centre")
    place = F.when(F.col("centre").isNull(), F.col("bucket")).otherwise(F.col("id"))
    return marked.repartition(place).sortWithinPartitions("bucket", "id").mapInArrow(_in_company, "bucket long, id long, centre long")


def _linked(sets: list[tuple[np.ndarray, np.ndarray]], class_of: np.ndarray, probes: np.ndarray, targets: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (probe, target) that link and join two classes: all links of different classes between
    `probes` and `targets` (indexes of `sets`) are among the classes they make."""
    size = np.array([len(t) for t, _ in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    known, token = np.unique(np.concatenate([t for t, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    whole = np.array([w.sum() for _, w in sets])
    parent = list(range(int(class_of.max(initial=-1)) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    if len(sets) * len(known) <= DENSE:
        table = np.zeros((len(sets), len(known)))
        table[np.repeat(np.arange(len(sets)), size), token] = np.sqrt(weight)
        step = max(1, DENSE // max(1, len(targets)))
        for at in range(0, len(probes), step):  # a product has DENSE cells, too, or a row of targets
            some = probes[at : at + step]
            both = table[some] @ table[targets].T
            close = (both / (whole[some][:, None] + whole[targets] - both) >= threshold) & (class_of[some][:, None] != class_of[targets])
            for p, t in np.argwhere(close).tolist():
                i, j = int(some[p]), int(targets[t])
                x, y = find(int(class_of[i])), find(int(class_of[j]))
                if x != y:
                    parent[x] = y
                    out.append((i, j))
        return out
    wanted = np.zeros(len(sets), dtype=bool)
    wanted[targets] = True
    holder = np.repeat(np.arange(len(sets)), size)
    listed = np.flatnonzero(wanted[holder])
    listed = listed[np.argsort(token[listed], kind="stable")]
    held = np.searchsorted(token[listed], np.arange(len(known) + 1))
    count = np.diff(held)
    own = np.zeros(len(known))
    for i in probes.tolist():
        mine = slice(first[i], first[i + 1])
        tokens, weights = token[mine], weight[mine]
        rarest = np.argsort(count[tokens], kind="stable")
        # A partner must share more than 1 - threshold of the weight, so one of these tokens; the margin is for rounding.
        before = np.cumsum(weights[rarest]) - weights[rarest]
        probed = tokens[rarest[before <= (1 - threshold + 1e-9) * whole[i]]]
        near = [holder[listed[held[t] : held[t + 1]]] for t in probed.tolist() if count[t]]
        if not near:
            continue
        near = np.unique(np.concatenate(near))
        near = near[np.minimum(whole[near], whole[i]) >= (threshold - 1e-9) * np.maximum(whole[near], whole[i])]
        roots = np.array([find(c) for c in class_of[near].tolist()], dtype=np.int64)
        near = near[roots != find(int(class_of[i]))]
        if not len(near):
            continue
        own[tokens] = weights
        part = np.cumsum(size[near]) // MOST_TOKENS
        for some in np.split(near, np.flatnonzero(np.diff(part)) + 1):
            start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            at = np.arange(size[some].sum()) + np.repeat(first[some] - start, size[some])
            both = np.add.reduceat(own[token[at]], start)
            for j in some[both / (whole[some] + whole[i] - both) >= threshold].tolist():
                x, y = find(int(class_of[i])), find(int(class_of[j]))
                if x != y:
                    parent[x] = y
                    out.append((i, j))
        own[tokens] = 0
    return out


def _compared(features: Features, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Step 3 for one pair of blocks: links between items of `side` 0 or 2 and those of `side` 1 or 2."""

    def links(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        class_of = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        pairs: list[tuple[int, int]] = []
        if len(ids) and len(np.unique(class_of)) > 1:
            sets = list(features(text_bytes(table.column("text"))))
            pairs = _linked(sets, class_of, np.flatnonzero(side != 1), np.flatnonzero(side != 0), threshold)
        x = ids[np.array([p for p, _ in pairs], dtype=np.int64)]
        y = ids[np.array([q for _, q in pairs], dtype=np.int64)]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return links


def _dealt(now: DataFrame, held: DataFrame) -> DataFrame:
    """(bucket, i, j, side, id, root, text): each mixed bucket's pairs of blocks, i of loose items and j of
    loose items or, below zero, of the bucket's largest class.  `now` has (bucket, id, root)."""
    sized = held.withColumn("bytes", F.octet_length("text").cast("long"))
    by_class = now.join(sized.select("id", "bytes"), "id").groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    buckets = by_class.groupBy("bucket").agg(F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes")).where("classes > 1")

    def blocks(total: Column) -> Column:
        return F.ceil((total + 1) / F.lit(BLOCK_BYTES)).cast("int")

    many = buckets.select("bucket", F.col("main.root").alias("largest"), blocks(F.col("bytes") - F.col("main.bytes")).alias("loose_blocks"), blocks(F.col("main.bytes")).alias("main_blocks"))
    own = now.join(many, "bucket").withColumn("loose", F.col("root") != F.col("largest"))
    own = own.withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("loose"), F.col("loose_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    loose = F.sequence(F.lit(0), F.col("loose_blocks") - 1)
    main = F.sequence(F.lit(-1), -F.col("main_blocks"), F.lit(-1))

    def task(i: Column | str, j: Column | str, side: int | Column) -> Column:
        as_int = lambda c: (F.col(c) if isinstance(c, str) else c).cast("int")
        return F.struct(as_int(i).alias("i"), as_int(j).alias("j"), (F.lit(side) if isinstance(side, int) else side).cast("int").alias("side"))

    of_loose = F.concat(
        F.transform(loose, lambda x: task(F.least(F.col("k"), x), F.greatest(F.col("k"), x), F.when(x == F.col("k"), 2).when(x > F.col("k"), 0).otherwise(1))),
        F.transform(main, lambda x: task("k", x, 0)),
    )
    of_main = F.transform(loose, lambda x: task(x, -F.col("k") - 1, 1))
    tasks = own.select("bucket", "id", "root", F.explode(F.when(F.col("loose"), of_loose).otherwise(of_main)).alias("t"))
    return tasks.select("bucket", "t.i", "t.j", "t.side", "id", "root").join(held, "id")


def _scored(similarity: Similarity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, PAIR_BYTES):
            found = similarity(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """(a, b, similarity) of `pairs` (a, b); `texts` has (id, text)."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_scored(similarity), "a long, b long, similarity double")


def _pairs_of(crowd: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes within buckets of at most SMALL items; `crowd` has (bucket, id, root)."""
    together = crowd.groupBy("bucket").agg(F.collect_list(F.struct("id", "root")).alias("m"))
    partners = lambda x: F.filter("m", lambda y: (y["id"] > x["id"]) & (y["root"] != x["root"]))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(partners(x), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    return together.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def classes(met: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Similarity, threshold: float, features: Features) -> DataFrame:
    """(id, root) of the items that share a bucket with another; items of one class have one root.

    `met` has (bucket long, id long), a row for each bucket of an item; a row may repeat.  `texts(ids)`
    returns (id, text) of the given ids; `features` gives each text's distinct tokens and their weights,
    where `similarity` is the weight of shared tokens by that of all tokens of both."""
    members = keep(members_of(met))
    near = keep(members.groupBy("id").agg(F.min("centre").alias("least")))
    ids = near.select("id")
    held = keep(texts(ids))
    similar = F.col("similarity") >= threshold

    first = keep(verified(near.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")), held, similarity))
    linked = first.where(similar)
    own, other = linked.select(F.col("b").alias("id"), F.col("a").alias("root")), linked.select(F.col("b").alias("centre"), F.col("a").alias("other"))
    across = members.where("id <> centre").join(near, "id").where("centre <> least").select("id", "centre").distinct()
    across = across.join(own, "id", "left").join(other, "centre", "left").where(F.coalesce("root", "id") != F.coalesce("other", "centre"))
    second = keep(verified(across.select(F.col("centre").alias("a"), F.col("id").alias("b")), held, similarity))
    compared = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    roots = _rooted(ids, compared.where(similar))

    # Nothing is left to compare with a bucket's centre.
    now = members.where("id <> centre").select("bucket", "id").join(roots, "id")
    mixed = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    crowd = keep(now.join(mixed, "bucket"))
    pairs = _pairs_of(crowd.where(F.col("n") <= SMALL)).join(compared, ["a", "b"], "left_anti")
    third = verified(pairs, held, similarity)
    large = _dealt(crowd.where(F.col("n") > SMALL).drop("n"), held).groupBy("bucket", "i", "j").applyInArrow(_compared(features, threshold), "a long, b long")
    links = [x.where(similar).select("a", "b") for x in (compared, third)]
    return _rooted(ids, reduce(DataFrame.union, [*links, large]))


def _rooted(ids: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return keep(ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
