"""Mixing and sharding against plain versions, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from tests.llm.conftest import prose
from veilgrain.llm import mixing, sharding


def level(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over
        rest = sum(sizes.values()) - sum(target.values())


def rows_by_source():
    draw = random.Random(8)
    out = [(i, prose(i, draw.randint(1, 120)), draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    long = prose(3, 4000).split()
    return [*out, (900, None, "a"), (901, "", "b"), (902, "one", "tiny"), (903, "  " + "\n ".join(" ".join(long[i : i + 9]) for i in range(0, 4000, 9)), "b")]


def test_targets_and_taken(frame):
    rows = rows_by_source()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    want, source = level(total), {i: s for i, _, s in rows}
    out = mixing.mixed(frame(rows)).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.02 * want[s]) for s in want)
    again = {(r.doc_id, r.taken) for r in mixing.mixed(frame(rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    assert mixing.mixed(frame(rows).limit(0)).count() == 0


def test_rows_without_ids(frame):
    """Each row is one of its own, and reruns agree, whatever the order."""
    rows = [(None, prose(i, 30 + i), "a") for i in range(60)] + [(5, prose(100 + i, 40), "b") for i in range(30)]
    first = sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mixed(frame(rows)).collect())
    assert len(first) == 90 and first == sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mixed(frame(rows[::-1])).collect())
    texts = lambda x: sorted(r.text for r in mixing.materialised(frame(x), ("doc_id", "text")).collect())
    assert texts(rows) == texts(rows[::-1])


def test_highest_quotients(spark):
    draw = random.Random(3)
    for seats, n in ((1, 9), (7, 9), (50, 9), (30, 80), (41, 80)):
        claims = {f"k{i:02}": draw.randint(1, 500) if i else 9000 for i in range(n)}
        df = spark.createDataFrame([(k, float(c), seats) for k, c in claims.items()], "key string, claim double, seats long")
        got = {r.key: r.won for r in mixing.apportioned(df, [], ["key"], "claim", "seats", "won").collect()}
        want = dict.fromkeys(claims, 0)
        for _ in range(seats):
            want[max(claims, key=lambda k: (claims[k] / (2 * want[k] + 1), [-ord(c) for c in k]))] += 1
        assert got == want


def test_materialised(frame):
    rows = rows_by_source()
    taken = {r.doc_id: r.taken for r in mixing.mixed(frame(rows)).collect()}
    words = defaultdict(int)
    whole = {i: (t or "").split() for i, t, _ in rows}
    for r in mixing.materialised(frame(rows), ("doc_id", "text", "lang", "source", "n_chars")).collect():
        own = r.text.split()
        words[r.doc_id] += len(own)
        assert r.text in (dict((i, t) for i, t, _ in rows)[r.doc_id]) and r.n_chars == len(r.text)  # as written
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_shards(frame, odd):
    draw = random.Random(1)
    rows = [(i, prose(i, draw.randint(1, 60))) for i in range(600)] + [(i, "hot " * 20) for i in range(1000, 1400)] + odd
    out = sharding.sharded(frame(rows)).collect()
    assert len(out) == len(rows)
    sizes, slots, shards_of = defaultdict(int), defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in out:
        assert (r.size, r.text_crc32) in texts[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        shards_of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in shards_of.values()) == 1  # only the hot text is parted
    carried = sharding.sharded(frame(rows), carry=("doc_id", "text", "lang")).collect()
    assert sorted((repr(r.doc_id), r.shard, r.slot, zlib.crc32((r.text or "").encode())) for r in carried) == sorted((repr(r.doc_id), r.shard, r.slot, r.text_crc32) for r in out)
    even = [(i, prose(i, 40)) for i in range(2000)]
    for r in sharding.sharded(frame(even)).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.sharded(frame(rows).limit(0)).count() == 0


def test_same_for_any_sample(frame, monkeypatch):
    """Places follow from the order and exact sizes: a denser sample, which cuts light keys too, changes nothing."""
    draw = random.Random(11)
    rows = [(i, prose(i, draw.randint(1, 60))) for i in range(500)] + [(1000 + i, prose(900 + i // 7, 30)) for i in range(140)] + [(i, "hot " * 30) for i in range(2000, 2300)]
    found = lambda: sorted((r.doc_id, r.shard, r.slot) for r in sharding.sharded(frame(rows)).collect())
    want = plain_shards(rows)
    assert found() == want
    monkeypatch.setattr(sharding, "LEAST_RANGES", 900)
    assert found() == want


def plain_shards(rows):
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    order = sorted((key(t), i, len(t.encode()) + 1) for i, t in rows)
    total, own, first, at = sum(x[2] for x in order), defaultdict(int), {}, 0
    places = []
    for k, i, n in order:
        first.setdefault(k, at)
        own[k] += n
        places.append((k, i, at))
        at += n
    filled, out = defaultdict(int), []
    for k, i, at in places:
        s = min(15, (first[k] if own[k] <= sharding.WHOLE_SHARE * total / 16 else at) * 16 // total)
        out.append((i, s, filled[s]))
        filled[s] += 1
    return sorted(out)


def test_pipeline_of_odd_rows(spark, tmp_path, odd):
    """Null and repeated ids go through all stages; an empty table does."""
    import corpus_pipeline as cp

    rows = [(i, t, "en", "a", None) for i, t in [*odd, (None, prose(3, 40)), (None, prose(60, 40)), (None, prose(61, 40)), (9, prose(62, 50))]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, kind in (("documents", rows, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, prose(61, 40))], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    kept = {prose(k, n) for k, n in ((1, 60), (2, 20000), (3, 40), (4, 50), (5, 50), (60, 40), (62, 50))}
    assert {r.text for r in out} == kept and len(out) == len(kept)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    draw = random.Random(5)
    rows = [(i, prose(i, 60), "en", draw.choice("abc"), None) for i in range(120)]
    item = prose(999, 30)
    rows += [(200, rows[0][1], "en", "a", None), (201, prose(7000, 20) + " " + item + " " + prose(7001, 20), "en", "b", None), (202, None, "en", "a", None), (203, "too short", "en", "c", None)]
    rows += [(300 + i, " ".join(w + "$$$" for w in prose(300 + i, 50).split()), "en", "a", None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 300 else 0, 0) for i, *_ in rows if i < 100 or i >= 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(cp.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in good.collect()}
    assert set(range(120)) <= ids and not ids & {202, 203} and not any(i >= 300 for i in ids)
    alone = stages["near_dedup"](spark, good, str(tmp_path))
    assert {r.doc_id for r in alone.collect()} == ids - {200}
    clean = stages["decontamination"](spark, alone, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == ids - {200, 201}
    mix = stages["mixing"](spark, clean, str(tmp_path))
    assert mix.columns == list(cp.COLUMNS) and clean.columns == list(cp.COLUMNS)
    out = cp.run(spark, str(tmp_path)).collect()
    assert len(out) == mix.count() and {r.shard for r in out} <= set(range(16))
