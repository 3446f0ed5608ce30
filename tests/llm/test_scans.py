"""License scan and decontamination against plain versions."""

import random
import re

import pytest

from tests.llm.conftest import prose
from veilgrain.llm import decontaminate, license_scan

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [p[0] for p in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))


def test_base_columns(frame, odd):
    draw = random.Random(3)
    bits = ["CC", "by", "cc by", "all rights", "reserved", "All  Rights, Reserved.", "general public License", "é", "x", "\n", "cc-by", "İ"]
    rows = [(i, " ".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))) for i in range(150)] + odd
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(brute(t))
    out = license_scan.licenses(frame(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in texts[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    "text,label,hit",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", True),
        ("licensed under the apache license 2.0", "apache-2.0", True),
        ("Licensed under the Apache Software License, Version 2.0", "apache-2.0", False),
        ("Released under the terms of the MIT License", "mit", True),
        ("Copyright (c) 2019-2024 Some Holder Inc. All rights reserved.", "copyright", True),
        ("This work is licensed under the GNU General Public License, version 3, or (at your option) any later version.", "gpl-3.0", True),
        ("Licensed under CC BY-NC 4.0 International", "cc-by-nc-4.0", True),
        ("Licensed under CC BY-NC 3.0", "cc-by-nc-4.0", False),
        ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0", True),
        ("redistribute it and/or modify it under the terms of the GNU General Private License as published by the Free Software Foundation", "gpl-any", False),
        ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl", True),
    ],
)
def test_templates(text, label, hit):
    assert (label in license_scan.scan(text.encode())[5].split(",")) is hit


def test_full_texts():
    """Each template with its parts spelled out is accepted, and isn't without one mandatory word."""
    for label, template in license_scan.TEMPLATES:
        said = re.sub(r"<<var;[^>]*words=(\d+)-\d+>>", lambda m: "somebody " * max(1, int(m[1])), template)
        said = re.sub(r"<<alt;([^|>]*)[^>]*>>", r"\1", re.sub(r"<<(?:begin|end)Optional>>", "", said))
        found = license_scan.scan(f"Notice: {said.upper()}, and more.".encode())
        assert label in found[5].split(","), label
        mandatory = re.split(r"<<[^>]*>>", re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<alt[^>]*>>", "<<>>", template))
        word = (max(mandatory, key=len).split() or [""])[-1]
        if word and sum(x == label for x, _ in license_scan.TEMPLATES) == 1 and said.split().count(word) == 1:
            assert label not in license_scan.scan(" ".join(w for w in said.split() if w != word).encode())[5].split(","), label


def test_bad_markup():
    with pytest.raises(ValueError):
        license_scan.compiled("x", "a <<beginOptional>> b")


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_myers():
    draw = random.Random(1)
    for _ in range(200):
        p = bytes(draw.choice(b"ab c") for _ in range(draw.randint(1, 40)))
        t = bytes(draw.choice(b"ab c") for _ in range(draw.randint(0, 70)))
        k, want = draw.randint(0, len(p)), edits(p, t)
        got = decontaminate.myers(p, decontaminate.masks_of(p), t, k)
        assert (got[0] if got else None) == (want if want <= k else None)


def as_regex(template):
    """A template as a regular expression over words with a blank after each; nothing of the automata."""
    out, open_parts = [], 0
    for i, part in enumerate(re.split(r"<<([^<>]*)>>", template)):
        words = lambda t: "".join(f"{w} " for w in t.split())
        kind, _, rest = part.partition(";")
        if i % 2 == 0:
            out.append(words(part))
        elif kind == "beginOptional":
            out.append("(?:")
            open_parts += 1
        elif kind == "endOptional":
            out.append(")?")
        elif kind == "alt":
            out.append("(?:" + "|".join(map(words, rest.split("|"))) + ")")
        else:
            low, high = re.search(r"words=(\d+)-(\d+)", rest).groups()
            out.append(rf"(?:\S+ ){{{low},{high}}}")
    return "".join(out)


def test_labels_and_scores_match_regular_expressions():
    """Leftmost, longest, for each template by itself, on texts made of templates, broken and whole."""
    import regex

    draw = random.Random(11)
    patterns = [(label, regex.compile(f"(?p)(?<!\\S){as_regex(t)}")) for label, t in license_scan.TEMPLATES]
    for _ in range(150):
        words = []
        for _ in range(draw.randint(1, 3)):
            _, template = draw.choice(license_scan.TEMPLATES)
            some = re.sub(r"<<alt;([^|>]*)[^>]*>>", r" \1 ", re.sub(r"<<var;[^>]*>>", " ".join(["acme"] * draw.randint(0, 6)), template))
            some = re.sub(r"<<beginOptional>>|<<endOptional>>", " ", some).split()
            if draw.random() < 0.5:
                some[draw.randrange(len(some))] = draw.choice(["the", "acme", "version", "3"])
            words += ["lead"] * draw.randint(0, 2) + some
        text = " ".join(words)
        joined = "".join(f"{w.decode()} " for w in license_scan.words_of(text.encode()))
        covered, labels = set(), set()
        count = lambda at: joined.count(" ", 0, at)
        for phrase, label in license_scan.PHRASES:
            for m in regex.finditer(rf"(?<!\S){phrase} ", joined, overlapped=True):
                covered |= set(range(count(m.start()), count(m.end())))
                labels.add(label)
        for label, pattern in patterns:
            for m in pattern.finditer(joined):
                covered |= set(range(count(m.start()), count(m.end())))
                labels.add(label)
        got = license_scan.scan(text.encode())
        assert got[5] == ",".join(sorted(labels)), text
        assert got[6] == pytest.approx(len(covered) / len(words))
    assert license_scan.scan(b"licensed under the GNU Affero General Public License version 1 only")[5] == "agpl,gpl"


def test_contaminated(spark, frame, odd):
    draw = random.Random(2)
    items = [(i, prose(500 + i, 25)) for i in range(12)] + [(90, "too few words"), (91, None), (92, " . ")]
    rows = []
    for i in range(60):
        words = prose(i, 40).split()
        if i % 3 == 0:
            passage = list(items[i % 12][1])
            for _ in range(draw.randint(0, 14)):
                passage[draw.randrange(len(passage))] = draw.choice("xyz")
            words[10:10] = "".join(passage).split()
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(frame(rows), bench).collect()}
    for i, t in rows:
        want = {}
        for item, passage in items[:12]:
            own = decontaminate.plain(passage.encode())
            d = edits(own, decontaminate.plain(t.encode()))
            if d <= int(decontaminate.ERROR_SHARE * len(own)):
                want[item] = d
        assert (out[i].item_ids, out[i].distance) == (sorted(want), min(want.values(), default=None))
    assert sorted(r.doc_id for r in decontaminate.clean(frame(rows), bench).select("doc_id").collect()) == [i for i, r in sorted(out.items()) if not r.contaminated]
    assert len(decontaminate.contaminated(frame(odd), bench).collect()) == len(odd)
    assert not any(r.contaminated for r in decontaminate.contaminated(frame(rows), bench.limit(0)).collect())


def test_short_items(spark, frame):
    """An item without a budget of edits must stand word for word, any other one may differ by its budget, however few
    words it has."""
    bench = spark.createDataFrame([(1, "Blue wombat, 7"), (2, "blue wombat 7 sings"), (3, prose(600, 20))], "item_id long, text string")
    rows = [(1, "a blue WOMBAT 7 b"), (2, "blue wombats 7"), (3, "xblue wombat 7"), (4, "blue wombat 7"), (5, prose(600, 20)[:-1] + "q"), (6, "then blue wambat 7 sings"), (7, "then blue wambat 7 sangs")]
    assert {r.doc_id: r.item_ids for r in decontaminate.contaminated(frame(rows), bench).collect()} == {1: [1], 2: [], 3: [], 4: [1], 5: [3], 6: [2], 7: []}


def test_blocks(spark, frame, odd, monkeypatch):
    """One block and several give the same rows, null and repeated ids included."""
    items = [(i, prose(500 + i, 25)) for i in range(6)]
    rows = [(i, prose(i, 10) + " " + items[i][1]) for i in range(6)] + [(None, items[0][1] + " " + items[5][1]), (None, "clean"), (3, items[1][1]), *odd]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((repr(r.doc_id), r.contaminated, r.n_items, tuple(r.item_ids), repr(r.distance)) for r in decontaminate.contaminated(frame(rows), bench).collect())
    whole = found()
    assert ("None", True, 2, (0, 5), "0") in whole and ("3", True, 1, (1,), "0") in whole and len(whole) == len(rows)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert found() == whole
    assert decontaminate.clean(frame(rows), bench).count() == sum(not w[1] for w in whole)
