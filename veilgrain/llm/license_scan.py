"""License scans: template markup compiled to token automata.

A template is a license notice with markup:

    <<beginOptional>> words that may be missing <<endOptional>>
    <<var;name=holder;words=0-12>>      any words in place of the original ones
    <<alt;a|b c>>                       one of several wordings

All else is mandatory wording and must match word for word.  Each template becomes a
nondeterministic automaton over words; a text is accepted where a run of its words spells the
template from its first to its last word.  Words are lower-cased ASCII letters, digits and all
characters beyond ASCII, so case, punctuation and layout play no part.

A label says that a notice's wording stands in the text, not that the license applies: "not licensed under the
MIT license" holds the wording, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from veilgrain.llm.text import small_batches, text_bytes

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wordings that several notices share.
_GNU = "<<beginOptional>> you can <<endOptional>> redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation <<beginOptional>> either <<endOptional>>"
_LATER = "<<beginOptional>> or <<beginOptional>> at your option <<endOptional>> any later version <<endOptional>>"
_OWNERS = "<<alt;authors or copyright holders|copyright holders or contributors|author or copyright holder>>"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>> 1 <<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>> 2 <<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_AS_IS = "this software is provided by <<var;name=owner;words=1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name=owner;words=1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Notices by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<beginOptional>> version <<endOptional>> 2 0"),
    ("mit", "<<alt;released|licensed|distributed|available>> under the <<beginOptional>> terms of the <<endOptional>> mit license"),
    ("gpl-3.0", "<<alt;licensed|released|distributed|available>> under the <<beginOptional>> terms of the <<endOptional>> gnu general public license version 3 <<beginOptional>> or <<beginOptional>> at your option <<endOptional>> any later version <<endOptional>>"),
    ("gpl-2.0", "<<alt;licensed|released|distributed|available>> under the <<beginOptional>> terms of the <<endOptional>> gnu general public license version 2 <<beginOptional>> or <<beginOptional>> at your option <<endOptional>> any later version <<endOptional>>"),
    ("lgpl", "licensed under the gnu <<alt;lesser|library>> general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<alt;cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial>> 4 0 <<beginOptional>> international <<endOptional>>"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<alt;cc by sa|creative commons attribution sharealike>> 4 0 <<beginOptional>> international <<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<alt;cc by|creative commons attribution>> 4 0 <<beginOptional>> international <<endOptional>>"),
    ("cc0-1.0", "<<alt;cc0 1 0|creative commons zero>> <<beginOptional>> universal <<endOptional>>"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<beginOptional>> v <<endOptional>> <<beginOptional>> version <<endOptional>> 2 0"),
    ("copyright", "copyright <<beginOptional>> c <<endOptional>> <<var;name=years;words=1-4>> <<var;name=holder;words=0-8>> all rights reserved"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of <<alt;this software|the software>> and associated documentation files <<beginOptional>> the software <<endOptional>> to deal in the software without restriction"),
    ("gpl-2.0", f"{_GNU.format('general')} version 2 of the license {_LATER}"),
    ("gpl-3.0", f"{_GNU.format('general')} version 3 of the license {_LATER}"),
    ("lgpl", f"{_GNU.format('<<alt;lesser|library>> general')} version <<alt;2|2 1|3>> of the license {_LATER}"),
    ("agpl-3.0", f"{_GNU.format('affero general')} version 3 of the license {_LATER}"),
    ("gpl-any", f"{_GNU.format('general')}"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use <<alt;this file|these files|this software>> except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit-full", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {_OWNERS} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-full", f"permission to use copy modify and <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;name=owner;words=1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=owner;words=1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}"),
    ("bsd-3-clause", f"{_BSD} <<beginOptional>> 3 <<endOptional>> neither the name of <<var;name=owner;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(r"<<([^<>]*)>>")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; `on` has a state's next states by word, under None for any word."""

    label: str
    on: list[dict[bytes | None, set[int]]] = field(default_factory=list)
    skip: list[set[int]] = field(default_factory=list)
    end: int = 0
    anchor: bytes = b""  # mandatory words in a row, blanks around them
    starts: frozenset[int] = frozenset()

    def state(self) -> int:
        self.on.append({})
        self.skip.append(set())
        return len(self.on) - 1

    def spell(self, at: int, words: list[bytes]) -> int:
        for w in words:
            after = self.state()
            self.on[at].setdefault(w, set()).add(after)
            at = after
        return at

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run that begins at word `at`, or -1."""
        states, found = set(self.starts), -1
        for i in range(at, len(words)):
            w, after = words[i], set()
            for s in states:
                after |= self.on[s].get(w, ()) or set()
                after |= self.on[s].get(None, ()) or set()
            if not after:
                break
            states = self.closed(after)
            if self.end in states:
                found = i + 1
        return found


def compiled(label: str, template: str) -> Automaton:
    """The template's automaton.  Markup that isn't closed, or unknown, raises ValueError."""
    a = Automaton(label)
    at = a.state()
    open_at: list[int] = []
    runs: list[list[bytes]] = [[]]
    for i, part in enumerate(_MARKUP.split(template)):
        if i % 2 == 0:
            own = words_of(part.encode())
            at = a.spell(at, own)
            if not open_at:
                runs[-1] += own
            continue
        runs.append([])
        kind, _, rest = part.partition(";")
        if kind == "beginOptional":
            open_at.append(at)
        elif kind == "endOptional" and open_at:
            after = a.state()
            a.skip[at].add(after)
            a.skip[open_at.pop()].add(after)
            at = after
        elif kind == "var" and (m := re.search(r"words=(\d+)-(\d+)", rest)):
            after = a.state()
            for k in range(int(m[2])):
                if k >= int(m[1]):
                    a.skip[at].add(after)
                step = a.state()
                a.on[at].setdefault(None, set()).add(step)
                at = step
            a.skip[at].add(after)
            at = after
        elif kind == "alt" and rest:
            after = a.state()
            for wording in rest.split("|"):
                a.skip[a.spell(at, words_of(wording.encode()))].add(after)
            at = after
        else:
            raise ValueError(f"markup <<{part}>> in template {label}")
    if open_at:
        raise ValueError(f"an optional part is left open in template {label}")
    a.end = at
    longest = max(runs, key=lambda r: len(b" ".join(r)))
    a.anchor = b" " + b" ".join(longest) + b" " if longest else b""
    a.starts = frozenset(a.closed({0}))
    return a


@cache
def automata(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[Automaton, ...]:
    return tuple(compiled(label, t) for label, t in templates)


def accepted(words: list[bytes], joined: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, int, str]]:
    """(first word, end, label) of every accepted run, for each template from left to right without
    overlap; `joined` has the words with single blanks between and around them."""
    out = []
    for a in automata(templates):
        if a.anchor not in joined:
            continue
        firsts = {w for s in a.starts for w in a.on[s]}
        i = 0
        while i < len(words):
            if None in firsts or words[i] in firsts:
                end = a.longest(words, i)
                if end > i:
                    out.append((i, end, a.label))
                    i = end
                    continue
            i += 1
    return out


def scan(text: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple:
    """The columns of SCHEMA after doc_id."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES:
        mark = b" " + phrase.encode() + b" "
        at = joined.find(mark)
        known, counted = 0, 0  # words before byte `known`
        while at >= 0:
            counted += joined.count(b" ", known, at)
            known = at
            places.append((counted, counted + len(phrase.split())))
            base.add(label)
            at = joined.find(mark, at + 1)
    matches = accepted(words, joined, templates)
    covered = {i for a, b, *_ in [*places, *matches] for i in range(a, b)}
    labels = base | {m[2] for m in matches}
    starts = [p[0] for p in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0


def _scanner(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in small_batches(batches):
            rows = [scan(t or b"", templates) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], _NAMES)

    return run


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): places of the base
    phrases, labels of phrases and accepted templates, and as score the share of the text's words
    that lie in either.  A null text counts as empty: no words, empty label strings, score 0, null
    positions.  Repeated rows each get a row; an empty table gives an empty result."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scanner(templates), SCHEMA)
