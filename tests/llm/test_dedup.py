"""Line, substring and document dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm.conftest import prose
from veilgrain.llm import line_dedup, linkage, near_dedup, substring_dedup
from veilgrain.llm.fm_index import WaveletMatrix


def union(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def copies(seed, n, most):
    """Texts of which some are edited copies of others."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = prose(seed * 1000 + i % (n // 3), 70).split()
        for _ in range(draw.choice([0, 0, 1, 1, 2, most])):
            words[draw.randrange(len(words))] = "new" + str(draw.randrange(99))
        rows.append((i, " ".join(words)))
    return rows


def test_near_duplicates(frame, odd):
    rows = copies(1, 90, 12)
    docs = frame(rows)
    words = [t.split() for _, t in rows]  # idf and weights, plainly
    met = Counter(w for own in words for w in set(own))
    idf = {w: 1 + np.log((1 + len(rows)) / (1 + n)) / np.log(2 + len(rows)) for w, n in met.items()}
    sets = {i: Counter() for i, _ in rows}
    for (i, _), own in zip(rows, words, strict=True):
        for k in range(max(1, len(own) - 4)):
            run = tuple(own[k : k + 5])
            sets[i][run] += np.mean([idf[w] for w in run])

    def similar(a, b):
        both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
        return both / (sum(a.values()) + sum(b.values()) - both) >= near_dedup.THRESHOLD

    want = union([(i, j) for i in sets for j in range(i) if similar(sets[i], sets[j])], sets)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    out = near_dedup.near_duplicates(frame(odd)).collect()
    assert len(out) == len(odd)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.class_id)
    assert by[5] == by[6] == {5} and by[1] == {1} and by[2] == {2} and by[3] == {3} and by[9] == {9}
    assert sum(r.kept for r in out) == len(odd) - 2  # the three equal rows of 5 and 6 are one
    assert [(r.class_id, r.class_size, r.kept) for r in out if r.doc_id is None] == [(None, 1, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(frame):
    """Rows are told apart by more than their id: every text that is no copy stays, once."""
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(None, a), (None, b), (None, a + " x"), (7, c), (7, b + " y"), (8, c), (None, None), (3, "")]
    out = near_dedup.near_duplicates(frame(rows)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in out) == sorted(
        [(0, 0, 2, True), (0, 0, 2, False), (0, 7, 2, False), (7, 7, 2, True), (7, 7, 2, True), (8, 7, 2, False), (0, 0, 1, True), (3, 3, 1, True)]
    )
    stay = near_dedup.without_copies(frame([*rows, rows[0], rows[4], rows[7]])).collect()
    assert sorted(r.text or "" for r in stay if r.text not in (a, a + " x")) == sorted(["", "", b + " y", c]) and len(stay) == 5


def test_weighted_sampling():
    """Lanes agree with the probability of the weighted Jaccard similarity."""
    draw, equal, true = np.random.default_rng(1), [], []
    for _ in range(60):
        keys = draw.integers(1, 1 << 62, 40).astype(np.uint64)
        a, b = draw.uniform(0.5, 3, 40), draw.uniform(0.5, 3, 40)
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        equal.append((near_dedup.sampled(keys, np.log(a).astype(np.float32)) == near_dedup.sampled(keys, np.log(b).astype(np.float32))).mean())
    assert abs(np.mean(equal) - np.mean(true)) < 0.04


def plain_jaccard(a, b):
    runs = lambda x: {x[i : i + line_dedup.CHARACTERS] for i in range(max(1, len(x) - line_dedup.CHARACTERS + 1))}
    x, y = runs(a.decode()), runs(b.decode())
    return len(x & y) / len(x | y)


def test_line_similarity():
    draw = random.Random(9)
    lines = ["".join(draw.choice("abc é한") for _ in range(draw.randint(1, 40))) for _ in range(120)] + ["ab", "abcdef", "x" * 30]
    lines = [line_dedup.plain(x.encode()) or b"-" for x in lines]
    other = [x[: len(x) // 2] + y for x, y in zip(lines, lines[1:] + lines[:1], strict=True)]
    other = [x.decode("utf-8", "ignore").encode() for x in other]
    assert np.allclose(line_dedup.jaccard(lines, other), [plain_jaccard(a, b) for a, b in zip(lines, other, strict=True)])


def test_short_lines(frame):
    """One changed character in the middle of a line of sixty."""
    line = prose(5, 40)[:70]
    out = line_dedup.deduplicated(frame([(1, line), (2, line[:30] + "#" + line[31:])])).collect()
    assert sorted((r.n_removed, r.kept) for r in out) == [(0, line), (1, "")]


def test_recall():
    """Bands meet nearly all pairs at the threshold or above, of short and long lines."""
    draw, found = random.Random(3), defaultdict(list)
    for size in (40, 60, 100, 250, 800):
        for _ in range(150):
            a = prose(draw.randrange(1 << 30), size)[:size]
            b = a
            while plain_jaccard(a.encode(), b.encode()) > 0.86:
                k = draw.randrange(size)
                b = b[:k] + draw.choice("qxz#7") + b[k + 1 :]
            if plain_jaccard(a.encode(), b.encode()) >= 0.8:
                x, y = line_dedup.buckets(line_dedup.lanes_of([a.encode(), b.encode()]))
                found[size].append(bool(set(x.tolist()) & set(y.tolist())))
    assert all(np.mean(f) >= 0.95 for f in found.values() if len(f) > 30), {k: np.mean(f) for k, f in found.items()}


def test_crowded_buckets(spark, monkeypatch):
    """Buckets that the sample finds crowded give the same members as those that are streamed."""
    draw = random.Random(2)
    met = [(draw.randrange(40), draw.randrange(3000)) for _ in range(4000)] + [(7, i) for i in range(2000)] + [(99, 5), (99, 5), (98, 1)]
    want = {}
    for b, i in met:
        want.setdefault(b, set()).add(i)
    want = {b: own for b, own in want.items() if len(own) > 1}
    df = spark.createDataFrame(met, "bucket long, id long").repartition(5)
    for least in (1 << 30, 32, 2):
        monkeypatch.setattr(linkage, "CROWDED", least)
        got = [tuple(r) for r in linkage.members_of(df).select("bucket", "id", "centre").collect()]
        assert {(b, i) for b, i, _ in got} - {(99, 5), (98, 1)} == {(b, i) for b, own in want.items() for i in own}
        assert all(len({c for x, _, c in got if x == b}) == 1 for b in want) and all(c in want[b] for b, _, c in got if b in want)
        assert least < 1 << 30 or all(c == min(want[b]) for b, _, c in got)


def test_lines(frame, odd):
    draw, rows = random.Random(4), []
    lines = [prose(i, 12) for i in range(25)] + ["short", "x"]
    for i in range(40):
        own = [draw.choice(lines) for _ in range(4)]
        own = [x + " plus" if draw.random() < 0.2 else x.upper() if draw.random() < 0.2 else "  " + x for x in own]
        rows.append((i, "\n".join([*own, ""])))
    seen = [(i, k, line_dedup.plain(x.encode())) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in seen})
    pairs = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if plain_jaccard(a, b) >= line_dedup.THRESHOLD]
    root = union(pairs, distinct)
    first = {}
    for i, k, x in sorted(seen):
        first.setdefault(root[x], (i, k))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or first[root[line_dedup.plain(x.encode())]] == (i, k)) for i, t in rows}
    out = {r.doc_id: r for r in line_dedup.deduplicated(frame(rows)).collect()}
    assert {i: r.kept for i, r in out.items()} == want
    bare = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.deduplicated(frame(rows), with_text=False).collect()}
    assert bare == {i: (r.n_lines, r.n_removed) for i, r in out.items()}
    assert len(line_dedup.deduplicated(frame(odd)).collect()) == len(odd)
    assert line_dedup.deduplicated(frame(rows).limit(0)).count() == 0


def test_lines_digest(frame):
    """Without texts, the digest still tells which lines stay: the first of near copies, by (doc_id, line)."""
    a, b = prose(80, 15), prose(81, 15)
    want = {1: f"{a}\n\n{b}", 2: "only", 3: "", 4: None}
    out = line_dedup.deduplicated(frame([(1, want[1]), (2, f"{b} x\nonly\n{a.upper()}"), (3, b), (4, None)]), with_text=False).collect()
    assert {r.doc_id: r.kept_sha256 for r in out} == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def edited(line, *places):
    """`line` with other characters at (place, character)."""
    return "".join(dict(places).get(i, c) for i, c in enumerate(line))


def line_classes(spark, lines, met):
    """Roots of lines by `linkage`, ids being places in `lines`, and by brute force over shared buckets."""
    held = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    got = linkage.classes(spark.createDataFrame(met, "bucket long, id long"), lambda ids: held.join(ids, "id", "left_semi"), line_dedup.jaccard, line_dedup.THRESHOLD, line_dedup.run_sets)
    raw = [x.encode() for x in lines]
    both = [(i, j) for b in {b for b, _ in met} for i in (k for c, k in met if c == b) for j in (k for c, k in met if c == b) if j < i]
    links = [p for p, s in zip(both, line_dedup.jaccard([raw[i] for i, _ in both], [raw[j] for _, j in both]), strict=True) if s >= line_dedup.THRESHOLD]
    return {r.id: r.root for r in got.collect()}, union(links, range(len(lines)))


def test_partner_behind_links(spark):
    """x links four lines that are closer than y, which only x links and which never looks itself."""
    x = prose(70, 60)[:157]
    y = edited(x, (40, "1"), (80, "2"))
    closer = [x[:-3] + end for end in ("345", "456", "567", "678")]
    others = [edited(y, (60, str(k)), (110, str(k))) for k in range(6)]
    lines = [prose(71, 60)[:157], y, *others, x, *closer]
    got, want = line_classes(spark, lines, [(1, i) for i in range(len(lines))] + [(2, i) for i in range(1, 8)])
    assert got == want and want[1] == want[8]


def test_partner_behind_many(spark, monkeypatch):
    """Pairs x, y in a bucket with 150 lines that are nearly as close to each; whole and in blocks."""
    draw, base = random.Random(72), prose(73, 80)[:200]
    place = iter(draw.sample(range(10, 190), 170))
    lines = [edited(base, (draw.randrange(10, 190), draw.choice("12345"))) for _ in range(150)]
    for _ in range(25):
        own = [(next(place), "6") for _ in range(4)]
        lines += [edited(base, *own), edited(base, *own[:3], (next(place), "7"))]
    met = [(1, i) for i in range(len(lines))]
    got, want = line_classes(spark, lines, met)
    assert got == want and len(set(want.values())) > 10
    monkeypatch.setattr(linkage, "BLOCK_BYTES", 3000)
    assert line_classes(spark, lines, met)[0] == want


def brute_substrings(rows):
    met, out = set(), {}
    for i, t in sorted(rows):
        words, gone = t.split(), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in met:
                gone.update(range(k, k + 20))
            met.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(frame, odd, monkeypatch):
    draw, rows = random.Random(6), copies(2, 30, 3)
    passage = prose(77, 60).split()
    for i in range(30, 70):
        a, b = sorted((draw.randrange(60), draw.randrange(60)))
        rows.append((i, " ".join([prose(300 + i, draw.randint(0, 40)), *passage[a:b], prose(400 + i, 5)])))
    rows += [(70, "same " * 90), (71, "same " * 30), (72, rows[0][1]), (73, "few words")]
    want = brute_substrings(rows)
    run = lambda: {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicated(frame(rows), with_text=False).collect()}
    assert run() == want
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    assert run() == want
    whole = substring_dedup.deduplicated(frame(rows)).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 == want[r.doc_id][2] for r in whole)
    out = substring_dedup.deduplicated(frame(odd), with_text=False).collect()
    assert len(out) == len(odd) and {(r.n_words, r.n_removed) for r in out if r.doc_id == 6} == {(60, 60)}
    assert substring_dedup.deduplicated(frame(rows).limit(0)).count() == 0


def test_wavelet_rank():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 50, 700)
    matrix = WaveletMatrix(symbols, 49)
    s, i = draw.integers(0, 50, 300), draw.integers(0, 701, 300)
    assert matrix.rank(s, i).tolist() == [int((symbols[:k] == c).sum()) for c, k in zip(s, i, strict=True)]


def test_repeats_within_one_run():
    """A period shorter than a window: equal windows of one text must not hide in one run."""
    from veilgrain.llm.text import Words

    text = ("a b c d e " * 5).encode()
    _, start, size = substring_dedup.runs_of(Words([text]))
    assert len(start) > 1 and size.sum() == 6


def test_buckets_in_company_in_any_cut():
    """Streaming gives each bucket of several ids its rows once, with the least id, however rows are cut into batches."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    far = (1 << 62) + 1  # numbers that a double doesn't hold
    rows = sorted((int(b) + far, int(i) + far) for b, i in zip(draw.integers(0, 12, 80), draw.integers(0, 6, 80), strict=True))
    want = set()
    for b in {b for b, _ in rows}:
        ids = {i for k, i in rows if k == b}
        if len(ids) > 1:
            want |= {(b, i, min(ids)) for i in ids}
    for step in (1, 2, 3, 7, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + step]], pa.int64()), pa.array([r[1] for r in rows[k : k + step]], pa.int64()), pa.nulls(len(rows[k : k + step]), pa.int64())], ["bucket", "id", "centre"]) for k in range(0, 80, step)]
        got = [tuple(r.values()) for out in linkage._in_company(iter(batches)) for r in out.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_products_are_bounded(monkeypatch):
    """Many items over few tokens are compared in slices, with the same links."""
    draw = np.random.default_rng(5)
    sets = [(np.flatnonzero(draw.random(12) < 0.7), None) for _ in range(60)]
    sets = [(t, np.ones(len(t))) for t, _ in sets if len(t)]
    every = np.arange(len(sets))
    joined = lambda: {frozenset(p) for p in linkage._linked(sets, every, every, every, 0.8)}
    whole = joined()
    monkeypatch.setattr(linkage, "DENSE", len(sets) * 12 + 1)
    assert joined() == whole and whole


def test_kept_rows_have_all_columns_and_are_always_the_same(spark):
    rows = [(1, "a b c d e f g", k, f"s{k}", k) for k in range(6)] + [(None, None, 7, "x", 0), (None, None, 7, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _near_id string, _hash int")
    outs = [sorted(map(tuple, near_dedup.without_copies(df.repartition(n)).collect()), key=repr) for n in (1, 3, 5)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 2 and len(outs[0][0]) == 5


def test_runs_of_lines_are_known_by_sorting(monkeypatch):
    """Each line's distinct runs are those of the line alone, and no line's runs pass a hash table of their own."""
    lines = [b"", b"ab", b"abcdef", b"abcdefabcdefabcdef", b"abcdef", "日本語日本語日本語".encode(), "été à la plage".encode(), b"x" * 40]
    alone = [set(line_dedup.run_hashes([x])[0].tolist()) for x in lines]
    monkeypatch.setattr(np, "unique", None)
    sets = line_dedup.run_sets(lines)
    assert [set(x.tolist()) for x, _ in sets] == alone and all((x[1:] > x[:-1]).all() and len(w) == len(x) and (w == 1).all() for x, w in sets)
