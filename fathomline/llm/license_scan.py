"""License scans (operator 4): template-markup matching.

A template is wording with markup: <<opt>> ... <<end>> may be left out, <<alt>> a <<or>> b <<end>> is replaceable
by either, <<var N>> stands for up to N words of any kind. Templates compile into token automata: a state has
transitions by word, and empty ones. A text is accepted where the mandatory wording matches word for word.
Automata start only at places of a template's first word, in texts that have one of the template's anchors.

Null counts as the empty text: no words, no labels, score 0. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_batches, plain_words

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording that several texts share. Fixed values.
_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution"
)
_NAMES = (
    "neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from"
    " this software without specific prior written permission"
)
_NO_WARRANTY = (
    "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied"
    " warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any"
    " direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute"
    " goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in"
    " contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if"
    " advised of the possibility of such damage"
)
_ITEM = "<<opt>> <<var 1>> <<end>>"
#: Label and wording. The wording of public licences and of notices that name them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license <<opt>> version <<end>> 2 0"),
    ("apache-2.0", "apache license version 2 0 <<opt>> january 2004 <<end>>"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may"
     " obtain a copy of the license at <<var 12>> unless required by applicable law or agreed to in writing software distributed under the"
     " license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for"
     " the specific language governing permissions and limitations under the license"),
    ("mit-notice", "<<alt>> released <<or>> licensed <<or>> distributed <<or>> available <<end>> under the <<opt>> terms of the <<end>> mit license"),
    ("mit-clause", "permission is hereby granted free of charge to any person obtaining a copy of this <<var 3>> and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<var 3>> and associated documentation files"
     " <<opt>> the <<alt>> software <<or>> materials <<end>> <<end>> to deal in the <<alt>> software <<or>> materials <<end>> without restriction including without"
     " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<alt>> software <<or>> materials <<end>> and to permit"
     " persons to whom the <<alt>> software <<or>> materials <<end>> <<alt>> is <<or>> are <<end>> furnished to do so subject to the following conditions the above copyright notice and this"
     " permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the <<alt>> software <<or>> materials <<end>>"
     " the <<alt>> software is <<or>> materials are <<end>> provided as is without warranty of any kind express or implied including but not limited to the warranties of"
     " merchantability fitness for a particular purpose and noninfringement in no event shall <<var 12>> be liable for any claim damages or"
     " other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<alt>> software <<or>> materials <<end>>"
     " or the use or other dealings in the <<alt>> software <<or>> materials <<end>>"),
    ("gpl-3.0", "gnu general public license <<opt>> as published by the free software foundation either <<end>> version 3"),
    ("gpl-2.0", "gnu general public license <<opt>> as published by the free software foundation either <<end>> version 2"),
    ("lgpl", "gnu <<alt>> lesser <<or>> library <<end>> general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-4.0", "<<opt>> licensed under <<end>> cc by 4 0"),
    ("cc-by-nc-4.0", "<<opt>> licensed under <<end>> cc by nc 4 0"),
    ("cc-by-sa-4.0", "<<opt>> licensed under <<end>> cc by sa 4 0"),
    ("bsd-clause", _CONDITIONS),
    ("bsd-2-clause", f"{_CONDITIONS} {_ITEM} {_SOURCE} {_ITEM} {_BINARY} {_NO_WARRANTY}"),
    ("bsd-3-clause", f"{_CONDITIONS} {_ITEM} {_SOURCE} {_ITEM} {_BINARY} {_ITEM} {_NAMES} {_NO_WARRANTY}"),
    ("mpl-2.0", "mozilla public license <<opt>> v <<end>> <<opt>> version <<end>> 2 0"),
    ("isc-clause", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify <<opt>> and or <<end>> <<opt>> and <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above"
     " copyright notice and this permission notice appear in all copies the software is provided as is and <<var 8>> disclaims all warranties"
     " with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 8>> be liable for"
     " any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in"
     " an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the <<alt>> authors <<or>> author <<end>> be held liable for any"
     " damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial"
     " applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-clause", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or"
     " distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]


class Automaton:
    """States with word transitions, empty transitions and wild ones (any word)."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, set[int]]] = []
        self.empty: list[set[int]] = []
        self.wild: list[set[int]] = []
        self.start = self._state()
        parts = re.findall(r"<<var \d+>>|<<\w+>>|[^\s<]+", template)
        at, i = self.start, 0
        at, i = self._sequence(parts, i, at, ())
        if i != len(parts):
            raise ValueError(f"markup is not closed: {template}")
        self.final = at
        self.mandatory = self._mandatory(parts)
        self.first = {w for s in self._closure({self.start}) for w in self.words[s]}
        self.open = any(self.wild[s] for s in self._closure({self.start}))

    def _state(self) -> int:
        for x, kind in ((self.words, dict), (self.empty, set), (self.wild, set)):
            x.append(kind())
        return len(self.words) - 1

    def _sequence(self, parts: list[str], i: int, at: int, stop: tuple[str, ...]) -> tuple[int, int]:
        while i < len(parts) and parts[i] not in stop:
            p = parts[i]
            if p == "<<opt>>":
                end, i = self._sequence(parts, i + 1, at, ("<<end>>",))
                self.empty[at].add(end)
                at = end
            elif p == "<<alt>>":
                begin, join = at, self._state()
                while parts[i] != "<<end>>":
                    branch = self._state()
                    self.empty[begin].add(branch)
                    end, i = self._sequence(parts, i + 1, branch, ("<<or>>", "<<end>>"))
                    self.empty[end].add(join)
                at = join
            elif p.startswith("<<var"):
                join, k = self._state(), int(p[6:-2])
                for _ in range(k):
                    nxt = self._state()
                    self.empty[at].add(join)
                    self.wild[at].add(nxt)
                    at = nxt
                self.empty[at].add(join)
                at = join
            else:
                nxt = self._state()
                self.words[at].setdefault(p.encode(), set()).add(nxt)
                at = nxt
            i += 1
        return at, i

    @staticmethod
    def _mandatory(parts: list[str]) -> list[bytes]:
        depth, out = 0, []
        for p in parts:
            depth += p in ("<<opt>>", "<<alt>>")
            depth -= p == "<<end>>"
            if not depth and not p.startswith("<<"):
                out.append(p.encode())
        return out

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts_at(self, words: list[bytes], i: int) -> int | None:
        """End of the longest match that starts at word i."""
        states, found = self._closure({self.start}), None
        while True:
            if self.final in states:
                found = i
            if i >= len(words) or not states:
                return found
            w = words[i]
            states = self._closure({t for s in states for t in (*self.words[s].get(w, ()), *self.wild[s])})
            i += 1


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, Automaton, bytes]]:
    """With the longest mandatory word as anchor."""
    out = []
    for label, text in TEMPLATES:
        a = Automaton(text)
        out.append((label, a, max(a.mandatory, key=len)))
    return out


def scan(text: bytes) -> dict:
    words = plain_words(text)
    joined = b" " + b" ".join(words) + b" "
    places, base, labels = [], set(), set()
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, word, seen = joined.find(sought), 0, 0
        while at >= 0:
            word, seen = word + joined.count(b" ", seen, at), at
            places.append(word)
            base.add(label)
            at = joined.find(sought, at + 1)
    spans = []
    for label, automaton, anchor in automata():
        if anchor in joined:
            for i, w in enumerate(words):
                if (w in automaton.first or automaton.open) and (end := automaton.accepts_at(words, i)) is not None:
                    labels.add(label)
                    spans.append((i, end, label))
    score = 1.0 if spans else 0.5 if places else 0.0
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score, "spans": [f"{a}-{b}:{c}" for a, b, c in spans]}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (start-end:label in words)."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan(t) for t in as_bytes(batch, text_col)]
        return {id_col: batch.column(id_col)} | {n: [x[n] for x in found] for n in names}

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} bigint,n_words bigint,n_base bigint,first_word bigint,last_word bigint,base_labels string,labels string,score double,spans array<string>")


def digest(result: DataFrame) -> DataFrame:
    return result.drop("spans")
