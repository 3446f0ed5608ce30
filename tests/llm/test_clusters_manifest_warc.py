"""Centroid clustering, the Merkle manifest and WARC archives against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veilgrain.llm import clustering, manifest, warc

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance long"


def plain_clusters(rows, dims, k, rounds, scale):
    import math

    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else scale * int(x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centres)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centres


def test_clusters_match_plain_integers(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, [0.25] * 8) for i in range(40)]  # equal vectors, equal centroids
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] * 8), (None, [0.5] * 8), (7, [0.5] * 8), (7, [0.5] * 8)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    out, centres = clustering.clusters(df, dims=8, k=12, rounds=3)
    expected, plain = plain_clusters(rows, 8, 12, 3, 256)
    assert sorted(map(tuple, out.collect()), key=repr) == expected
    assert centres == plain
    facts = clustering.described(out, centres).collect()
    assert sum(r.distance for r in facts) == facts[0].inertia
    assert {r.centroid_sha256 for r in facts if r.cluster == 3} <= {hashlib.sha256(",".join(map(str, centres[3])).encode()).hexdigest()}


def test_huge_components_are_exact(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [-40000.0, 0.1]), (4, [3e9, 4e9]), (5, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)
    out, centres = clustering.clusters(df, dims=2, k=2, rounds=2)
    expected, plain = plain_clusters(rows, 2, 2, 2, 256)
    assert centres == plain
    assert sorted(map(tuple, out.collect())) == [(i, c, d if d < 2**63 else None) for i, c, d in expected]
    assert {r.inertia for r in clustering.described(out, centres).collect()} == {None}


def test_no_vectors(spark):
    out, centres = clustering.clusters(spark.createDataFrame([], VECTORS))
    assert centres == [] and clustering.described(out, centres).collect() == []


def test_screening_never_loses_the_nearest():
    draw = np.random.default_rng(3)
    centres = draw.integers(-3, 4, (40, 64))
    centres[20:] = centres[:20] + (draw.random((20, 64)) < 0.02)  # close pairs and equal ones
    for spread in (3, 300, clustering.EXACT):
        x = draw.integers(-spread, spread + 1, (500, 64))
        near, d = clustering.nearest(x, centres)
        plain = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (near == plain.argmin(axis=1)).all() and (d == plain.min(axis=1)).all()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, i long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, more=0):
        doc_id, text, lang, source, n = r
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + more, text)])

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        return [(i >> k & 1, level[i >> k ^ 1] if (i >> k ^ 1) < len(level) else "") for k, level in enumerate(levels[:-1])]

    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees = []
    for key in sorted(groups):
        own = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, climb([leaf(r) for r in own])))
    top, out = climb([t[-1][0] for _, t in trees]), []
    for at, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, at)
            f = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for left, s in steps:
                f = h(s, f) if left else h(f, s)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*[s for _, s in steps]), f, f == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 2, 12])
def test_manifest_matches_plain_tree(spark, most):
    rows = [(i, f"text {i} wörd", ["en", "de", None, "", "é"][i % 17 % 5], "s" if i % 3 else None, i if i % 4 else None) for i in range(70)]
    rows += [(None, None, "en", "s", 5), (None, None, "en", "s", 5), (None, "x", None, None, None), (5, "other", "en", "s", 1), (5, "other", "en", "s", 1), (900, "alone", "zz", "s", 3), (901, "y" * 100000, "en", "", 3)]
    df = spark.createDataFrame([(*r, "leaf", "root", 1) for r in rows], DOCS).repartition(3)
    assert sorted(map(tuple, manifest.manifest(df, most).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_little(spark):
    one = [(3, "a", "en", "s", 1)]
    assert [tuple(r) for r in manifest.manifest(spark.createDataFrame([(*one[0], "l", "r", 1)], DOCS)).collect()] == plain_manifest(one)
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []


PAGES = "page_id long, url string, html string, record_type string, path string, first string, n long"


def plain_pages(rows):
    groups = {}
    for i, url, html in rows:
        groups.setdefault(html or "", []).append((i is None, i or 0, url is not None, url or "", i))
    out = []
    for html, own in groups.items():
        own.sort()
        size, sha1 = len(html.encode()), warc.digest(html.encode())
        out += [(r[-1], size, sha1, "revisit" if n else "response", own[0][-1] if n else None) for n, r in enumerate(own)]
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "response", "p", "f", 1) for r in rows], PAGES).repartition(3)


ROWS = [(i, f"http://a.example/{i}", f"<p>{i % 20} é</p>" * (i % 7 + 1)) for i in range(60)]
ROWS += [(70, None, None), (71, "http://x/\r\nWARC-Type: x", ""), (None, "u", "<p>only</p>"), (None, "v", "<p>only</p>"), (72, "w", "<p>same</p>"), (72, "w", "<p>same</p>"), (72, "w", "<p>same</p>")]
ROWS += [(80, "big", "".join(chr(33 + (i * i * 7919 + i) % 90) for i in range(300000))), (81, "magic", "\x1f\u008b\x08 WARC/1.1\r\n\r\n")]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('warc')}/a"
    warc.write(pages(spark, ROWS), where)
    return [f"{where}/responses", f"{where}/revisits"]


def found(spark, paths, step):
    return sorted(map(tuple, warc.summary(warc.read(spark, *paths, range_bytes=step)).collect()), key=repr)


@pytest.mark.parametrize("step", [61, 1000, 1 << 20])
def test_round_trip_at_any_range(spark, archives, step):
    assert found(spark, archives, step) == plain_pages(ROWS)


def test_archives_are_plain_gzip_with_whole_payloads(spark, archives):
    import gzip

    whole = b""
    for r in spark.read.format("binaryFile").load(archives).collect():
        whole += gzip.decompress(bytes(r.content))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    payloads = {(r.headers.get("x-page-id"), bytes(r.payload).decode()) for r in warc.read(spark, *archives).collect() if r.type == "response"}
    assert ("80", ROWS[-2][2]) in payloads and ("81", ROWS[-1][2]) in payloads and ("70", "") in payloads
    ids = [r.headers["warc-record-id"] for r in warc.read(spark, *archives).collect()]
    refers = {r.headers.get("warc-refers-to") for r in warc.read(spark, *archives).collect()} - {None}
    assert len(set(ids)) == len(ROWS) and refers <= set(ids)


def test_other_members_and_broken_ones_are_passed_over(spark, tmp_path):
    import gzip

    good = warc.member(warc.record("response", 1, "u", 0, b"hello", warc.digest(b"hello"), 5, None))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # magic bytes inside a member
    inner = warc.record("response", 2, "u", 0, b"x" + warc.MAGIC + b"\x00" * 40, warc.digest(b""), 44, None)
    file = tmp_path / "x.warc.gz"
    file.write_bytes(b"junk" + good + gzip.compress(b"not a record") + warc.MAGIC + stored.compress(inner) + stored.flush() + good[:-9])
    for step in (7, 50, 1 << 20):
        rows = warc.read(spark, f"file://{file}", range_bytes=step).orderBy("offset").collect()
        assert [(r.offset, r.headers["x-page-id"]) for r in rows] == [(4, "1"), (4 + len(good) + len(gzip.compress(b"not a record")) + 3, "2")]


def test_no_pages(spark, tmp_path):
    warc.write(pages(spark, []), f"file://{tmp_path}/none")
    assert found(spark, [f"file://{tmp_path}/none/responses", f"file://{tmp_path}/none/revisits"], 100) == []
