"""Quality rules, rule ensemble, toxicity: counts against brute force, held-out accuracy, odd rows."""

import random
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.conftest import prose
from veilgrain.llm import quality_rules, rule_ensemble, toxicity
from veilgrain.llm.labels import training_rows
from veilgrain.llm.text import Words, word_hashes


def labelled(spark, frame, n=400):
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 4 == 0
        text = prose(1000 + i, 80)
        if not good:
            text = " ".join(w + "$$$" for w in text.split()) if i % 2 else " | ".join(text.upper().split())
        if toxic:
            words = text.split(" ")
            for k in range(3):
                words.insert(10 * k + i % 7, ("zorbag" + random.Random(i + k).choice(["", "en", "ur"])) if i % 8 else "vilth")
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice(["a ", "b ", "é ", "\n", "$", "|x ", "a b c d e "]) for _ in range(draw.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))
        assert quality_rules.counts(text.encode()) == want


def test_quality_rules(spark, frame, odd):
    docs, labels = labelled(spark, frame)
    out = {r.doc_id: r for r in quality_rules.score(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].kept == (i % 3 != 0) for i in held]) > 0.95
    model = quality_rules.fit(docs, labels)
    for text in ("", "ab", "żółć – gęślą jaźń 1234 5", prose(7, 30), "한국어 글자 셋 넷"):  # the margin, feature by feature
        raw, words = text.encode(), text.split()
        parts = [[text[i : i + n] for i in range(len(text) - n + 1)] for n in (3, 4)] + [words, list(zip(words, words[1:], strict=False))]
        slots = [s[lo[0] : hi[0]] for s, (lo, hi) in quality_rules.features([raw], Words([raw]))]
        assert [len(s) for s in slots] == [len(p) for p in parts]
        for s, p in zip(slots, parts, strict=True):
            assert len({(x, int(y)) for x, y in zip(p, s, strict=True)}) == len(set(p))
        z = model.bias + sum(model.weights[f][s].mean() for f, s in enumerate(slots) if len(s))
        assert abs(model.probabilities([raw], Words([raw]))[0] - 1 / (1 + np.exp(-(model.scale * z + model.shift)))) < 1e-5
    rows = quality_rules.score(frame(odd), labels).collect()
    assert len(rows) == len(odd)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert all(r.kept for r in quality_rules.score(frame(odd), labels.limit(0)).collect() if not r.base_failed)
    assert quality_rules.score(docs.limit(0), labels).count() == 0
    assert sorted(quality_rules.kept(docs, labels).columns) == sorted(docs.columns)


def test_a_long_text_in_pieces_is_as_a_whole(monkeypatch):
    draw = random.Random(3)
    parts = ["a ", "b ", "é", "\n", "$", "|x ", "a b c d e ", "한국", "𝐯", "wordwithoutend", "\r\n", " "]
    for k in range(400):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60))).encode() if k % 4 else bytes(draw.choice([65, 32, 10, 0x80, 0xE2, 0xF0, 0xFF]) for _ in range(40))
        words, (slots, often) = Words([text]), quality_rules.sparse([text])[0]
        monkeypatch.setattr(quality_rules, "LONG_BYTES", draw.randint(1, 40))
        assert np.concatenate([words.hashes[:0], *word_hashes(quality_rules._pieces(text))]).tolist() == words.hashes.tolist()
        assert quality_rules.counts_of_long(text).tolist() == quality_rules.counts_of([text], words)[0].tolist()
        found = quality_rules.slots_of_long(text).ravel()
        assert np.flatnonzero(found).tolist() == slots.tolist() and found[slots].tolist() == often.tolist()
        monkeypatch.undo()


def test_memory_is_bounded_for_long_texts(spark, frame, monkeypatch):
    """A long text costs few times its size, and the one task that fits gets no texts."""
    text = (prose(8, 60_000) + " ").encode() * 10
    model = quality_rules.Model(np.random.default_rng(1).random((4, quality_rules.SLOTS)).astype(np.float32), 0.0, 1.0, 0.0)
    whole = model.probabilities([text], Words([text]))
    tracemalloc.start()
    stats, failed, p = quality_rules._judged(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stats[0, 0] == 600_000 and failed == [True] and abs(p - whole).max() < 1e-9
    assert len(text) > 4 * quality_rules.LONG_BYTES and peak < 25 * len(text)
    docs, labels = labelled(spark, frame, 60)
    gathered, kind = [], type(docs)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c, f=kind.repartition: gathered.append((n, self.columns)) or f(self, n, *c))
    assert quality_rules.fit(docs, labels)
    assert gathered and all("text" not in columns for n, columns in gathered if n == 1)


def test_the_first_stage_keeps_long_texts_apart(spark, frame, monkeypatch):
    """The pipeline's stage gathers no texts in one task, and judges a long text as `score` does."""
    sf_dir = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = frame([(1, prose(11, 250_000)), (2, (prose(12, 40) + " ") * 40_000), (3, prose(13, 40)), (4, None)]).union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 10", "text", "lang", "source", "n_chars", "'x'", "1L", "1", "1", "'p'"))
    gathered, kind = [], type(docs)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c, f=kind.repartition: gathered.append((n, self.columns)) or f(self, n, *c))
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()}
    assert kept == {r.doc_id for r in quality_rules.score(docs, labels).collect() if r.kept} and 2 not in kept and 4 not in kept
    assert gathered and all("text" not in columns for n, columns in gathered if n == 1)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    n, c, m = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    return {
        "log_words": np.log1p(len(words)),
        "word_length": sum(map(len, words)) / n,
        "symbol_share": sum(x in "#*$%&|<>" for x in text) / c,
        "upper_share": sum(unicodedata.category(x) == "Lu" for x in text) / c,
        "digit_share": sum(x in "0123456789" for x in text) / c,
        "mark_share": sum(x in "!?" for x in text) / c,
        "distinct_share": len(set(words)) / n,
        "echo_share": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "repeated_line_share": (len(lines) - len(set(lines))) / m,
        "words_per_line": np.log1p(n / m),
        "stop_share": sum(w.endswith(".") for w in words) / n,
        "lone_symbol_share": sum(len(w) == 1 and unicodedata.category(w)[0] not in "LN" for w in words) / n,
    }


def test_training_rows(spark, frame):
    """One row for each labelled id, whatever repeats: the least label, and one of its texts."""
    docs = frame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, None), (None, "d")])
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 1), (None, 1), (4, 0), (2, 7)], "doc_id long, quality int")
    got = {r.doc_id: (r.text, r.label) for r in training_rows(docs, marks, "quality", 10).collect()}
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert set(got) == {1, 2, 3} - held and all(len(x) == 2 for x in got.values())
    assert 1 in held or got[1][1] == 0 and got[1][0] in "ab"
    assert training_rows(docs, marks, "quality", 1).count() == 1


def test_rule_ensemble(spark, frame, odd):
    docs, labels = labelled(spark, frame)
    ensemble = rule_ensemble.fit(docs, labels)
    assert ensemble.rules and all(len(r) <= rule_ensemble.DEPTH for r in ensemble.rules)
    rows = rule_ensemble.score(docs, ensemble).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    texts = [*(t for _, t in odd if t), "A\n\nA\n b  b! $ x. y.", "ÀÉ 12 ?", ""]
    found = rule_ensemble.with_statistics(frame(list(enumerate(texts)))).collect()
    scores = {r.doc_id: r.score for r in rule_ensemble.score(frame(list(enumerate(texts))), ensemble).collect()}
    for r in found:
        want = plain_statistics(texts[r.doc_id])
        assert all(abs(r[k] - want[k]) < 1e-9 for k in rule_ensemble.STATISTICS)
        hit = lambda rule: all((want[rule_ensemble.STATISTICS[s]] > c) == up for s, up, c in rule)  # noqa: B023, E731
        z = ensemble.bias + sum(w for rule, w in zip(ensemble.rules, ensemble.weights, strict=True) if hit(rule))
        assert abs(scores[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    scored = rule_ensemble.score(frame(odd), ensemble).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert rule_ensemble.score(docs.limit(0), rule_ensemble.fit(docs, labels.limit(0))).count() == 0


def docs_text(docs, doc_id, known={}):  # noqa: B006
    if docs not in known:
        known[docs] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    return known[docs][doc_id]


def plain_evidence(text, lexicon):
    """Matches of every term at every place, by looking at words."""
    t = toxicity.folded(text)
    gone = [m.span() for x in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_]){re.escape(toxicity.folded(x))}(?![^\W_])", t)]
    total = 0.0
    for m in re.finditer(r"[^\W_]+", t):
        for x, w in [*lexicon.words.items(), *lexicon.stems.items()]:
            fits = m[0] == x if x in lexicon.words and lexicon.words[x] == w else m[0].startswith(x)
            if fits and not any(a <= m.start() and m.start() + len(x) <= b for a, b in gone):
                total += w
    return total / (len(text.split()) + 10) ** 0.5


def test_toxicity(spark, frame, odd):
    docs, labels = labelled(spark, frame)
    lexicon = toxicity.fit(docs, labels)
    assert "vilth".replace("l", "i") in lexicon.words
    held = [r for r in toxicity.score(docs, lexicon).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    base = prose(9, 30)
    writings = ["v1lth VІLTH vilth", "ｖｉｌｔｈ ｖｉｌｔｈ ｖｉｌｔｈ", "𝐯𝐢𝐥𝐭𝐡 vïlth v\u0301ilth", "vi\u200blth vil\u00adth vilth", "vιlτh ѵilth vilτh"]
    hidden = toxicity.score(frame([*((i, f"{base} {w}") for i, w in enumerate(writings)), (90, base)]), lexicon).collect()
    assert {r.doc_id: r.predicted for r in hidden} == {**dict.fromkeys(range(len(writings)), 1), 90: 0}
    for r in toxicity.score(docs, lexicon).collect()[:80]:
        assert abs(r.evidence - plain_evidence(docs_text(docs, r.doc_id), lexicon)) < 1e-9
    assert len(toxicity.score(frame(odd), lexicon).collect()) == len(odd)
    assert {r.predicted for r in toxicity.score(frame(odd), toxicity.Lexicon()).collect()} == {0}


def test_exceptions():
    lexicon = toxicity.Lexicon(words={toxicity.folded("trash"): 5.0})
    automaton = lexicon.automaton()
    assert toxicity.evidence("you are trash", automaton) > 0
    assert toxicity.evidence("the trash can is full", automaton) == 0
    assert toxicity.evidence("trashy", automaton) == 0
    assert toxicity.evidence("trash " + "the trash can " * 2000, automaton) > 0
    assert toxicity.evidence("the trash can " * 2000, automaton) == 0
