"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is a text with markup: <<optional>>...<<end>> may be left out, <<any N>> stands for at
most N words of any kind.  Everything else is mandatory wording.  It is compiled to an automaton
over words; a text is accepted where the automaton reaches its end from some word on.  Each automaton names
its longest mandatory word; it is walked only in texts that hold that word.  A statement right behind a negation keeps its
label, as it names the licence, but scores NEGATED.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from scholarframe.llm.decontaminate import FOLD, fold

#: Phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_WARRANTY = "including but not limited to <<optional>>the<<end>> "
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<any 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "<<any 2>> neither the name of <<any 12>> nor the names of <<any 6>> contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_TAIL = (
    "<<any 1>> this software is provided by <<any 12>> as is and any express or implied warranties " + _WARRANTY + "implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)


def _gnu_notice(kind: str, version: str) -> str:
    """The notice that a GNU licence asks for in each file, of one version or of later ones too."""
    return (
        f"free software you can redistribute it and or modify it under the terms of the gnu {kind} as published by the free software foundation "
        f"<<optional>>either<<end>> version {version} <<optional>>of the license<<end>> <<optional>>or at your option any later version<<end>> "
        "<<any 4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        f"see the gnu {kind} for more details"
    )


_GPL, _LGPL, _AGPL = ("general public license", "lesser general public license", "affero general public license")

#: Licences by the identifiers that files name them with, and the labels they get.
_SPDX = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc", "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "bsl 1 0": "boost-1", "zlib": "zlib", "unlicense": "unlicense",
    "cc0 1 0": "cc0-1", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}
#: Words right before a statement that take it back, and what it scores then.
NEGATIONS, NEGATED = {b"not", b"never", b"nor", b"cannot", b"longer"}, 0.25
_LICENSED = "<<optional>>licensed<<end>> <<optional>>released<<end>> <<optional>>distributed<<end>> <<optional>>available<<end>> under <<optional>>the<<end>> <<optional>>terms of the<<end>> "

#: Label, score, template.  Words are compared after folding, so case and punctuation don't matter.  Labels that end in
#: -text or -notice have the whole mandatory wording; openings without the rest score 0.75, and statements that
#: name a licence score 1.
TEMPLATES = (
    ("mit", 1.0, "<<optional>>this <<any 2>> is<<end>> released under the <<optional>>terms of the<<end>> mit license"),
    ("mit", 1.0, "licensed under the <<optional>>terms of the<<end>> mit license"),
    ("mit", 0.75, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-text", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
     "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied " + _WARRANTY + "warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", 1.0, "licensed under the apache license version 2 <<optional>>0<<end>>"),
    ("apache-2-notice", 1.0, "licensed under the apache license version 2 0 the license you may not use <<any 4>> except in compliance with the license "
     "you may obtain a copy of the license at <<optional>>http<<end>> <<optional>>https<<end>> <<optional>>www<<end>> apache org licenses license 2 0 <<optional>>txt<<end>> <<optional>>html<<end>> "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
     "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", 1.0, "licensed under the gnu general public license <<any 2>> version 3"),
    ("lgpl-3", 1.0, "licensed under the gnu lesser general public license <<any 2>> version 3"),
    ("agpl-3", 1.0, "licensed under the gnu affero general public license <<any 2>> version 3"),
    ("gpl-2", 1.0, "licensed under the gnu general public license <<any 2>> version 2"),
    *((f"{label}-{version.replace(' ', '.')}", 0.75, f"under the terms of the gnu {kind} as published by the free software foundation <<optional>>either<<end>> version {version} <<optional>>of the license<<end>>")
      for label, kind, version in (("gpl", _GPL, "2"), ("gpl", _GPL, "3"), ("lgpl", _LGPL, "2 1"), ("lgpl", _LGPL, "3"), ("agpl", _AGPL, "3"))),
    *((f"{label}-{version.replace(' ', '.')}-notice", 1.0, _gnu_notice(kind, version))
      for label, kind, version in (("gpl", _GPL, "2"), ("gpl", _GPL, "3"), ("lgpl", _LGPL, "2 1"), ("lgpl", _LGPL, "3"), ("agpl", _AGPL, "3"))),
    ("cc-by-nc", 1.0, "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc <<optional>>4 0<<end>>"),
    ("cc-by-nc", 1.0, "licensed under <<any 2>> creative commons attribution noncommercial <<optional>>4 0<<end>> <<optional>>international<<end>> license"),
    *((f"cc-by-nc-{short}", 1.0, f"licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc {short} <<optional>>4 0<<end>>") for short in ("sa", "nd")),
    *((f"cc-by-nc-{short}", 1.0, f"licensed under <<any 2>> creative commons attribution noncommercial {long} <<optional>>4 0<<end>> <<optional>>international<<end>> license")
      for short, long in (("sa", "sharealike"), ("nd", "noderivatives"))),
    ("cc-by-sa", 1.0, "licensed under <<any 2>> creative commons attribution sharealike <<optional>>4 0<<end>> <<optional>>international<<end>> license"),
    ("cc-by", 1.0, "licensed under <<any 2>> creative commons attribution <<optional>>4 0<<end>> <<optional>>international<<end>> license"),
    ("bsd", 0.75, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-text", 1.0, _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-text", 1.0, _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("isc", 0.75, "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-text", 1.0, "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies "
     "the software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
     "in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
     "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    *((label, 1.0, f"spdx license identifier {words}") for words, label in _SPDX.items()),
    *((f"{label}-{version}", 1.0, _LICENSED + f"gnu {name} <<any 2>> {word}{version}") for label, name in (("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl")) for version in ("2", "3") for word in ("v", "version ")),
    *((f"{label}-{version}", 1.0, f"licensed under the terms of the gnu {kind} <<any 2>> version {version}") for label, kind in (("gpl", _GPL), ("lgpl", _LGPL), ("agpl", _AGPL)) for version in ("2", "3")),
    *((f"bsd-{k}", 1.0, _LICENSED + f"bsd {k} clause <<optional>>new<<end>> <<optional>>simplified<<end>> license") for k in ("2", "3")),
    ("cc-by", 1.0, "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by 4 0"),
    ("cc-by-sa", 1.0, "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by sa <<optional>>4 0<<end>>"),
    ("mpl-2", 1.0, _LICENSED + "mozilla public license <<any 2>> 2 0"),
    ("mpl-2-notice", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http<<end>> <<optional>>https<<end>> <<optional>>www<<end>> mozilla org mpl 2 0"),
    ("epl-2", 1.0, _LICENSED + "eclipse public license <<any 2>> 2 0"),
    ("unlicense", 0.75, "this is free and unencumbered software released into the public domain"),
    ("unlicense-text", 1.0, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
     "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
     "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
     "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
     "the software is provided as is without warranty of any kind express or implied " + _WARRANTY + "warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("cc0-1", 1.0, "to the extent possible under law <<any 12>> waived all copyright and related or neighboring rights to <<any 12>> work"),
    ("boost-1", 1.0, "<<optional>>distributed<<end>> <<optional>>licensed<<end>> under the boost software license version 1 0"),
    ("boost-1", 0.75, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 0.75, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-text", 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
     "<<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
     "<<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
     "<<any 1>> this notice may not be removed or altered from any source distribution"),
    ("all-rights-reserved", 1.0, "copyright <<any 8>> all rights reserved"),
)

_MARKUP = re.compile(r"<<(optional|end|any (\d+))>>|([^<]+)")


class TokenAutomaton:
    """States are numbers; `step[s]` maps a word to the next states, `free[s]` are next states for any
    word, `skip[s]` states reached without one."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.skip: list[list[int]] = [[]]
        #: Words that every accepted text holds.
        self.mandatory: set[bytes] = set()
        opened, at = [], 0
        for kind, count, words in _MARKUP.findall(template):
            if kind == "optional":
                opened.append(at)
            elif kind == "end":
                self.skip[opened.pop()].append(at)
            elif count:
                here = [at]
                for _ in range(int(count)):
                    at = self._state()
                    self.free[here[-1]].append(at)
                    here.append(at)
                for s in here[:-1]:
                    self.skip[s].append(at)
            else:
                for word in fold(words.encode()):
                    new = self._state()
                    self.step[at].setdefault(word, []).append(new)
                    at = new
                    if not opened:
                        self.mandatory.add(word)
        self.end = at
        self.first = self._first()
        #: The longest mandatory word with a space on either side; of no such word, what every text holds.
        self.sign = b" %b " % max(self.mandatory, key=lambda w: (len(w), w)) if self.mandatory else b" "

    def _state(self) -> int:
        for part, empty in ((self.step, {}), (self.free, []), (self.skip, [])):
            part.append(empty)
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            new = [t for t in self.skip[todo.pop()] if t not in states]
            states.update(new)
            todo += new
        return states

    def _first(self) -> set[bytes]:
        return {w for s in self._closed({0}) for w in self.step[s]}

    def accepts(self, words: list[bytes], at: int) -> int:
        """One past the last word of the longest match that begins at `at`; 0 if there is none."""
        states, best = self._closed({0}), 0
        for k in range(at, len(words)):
            states = self._closed({t for s in states for t in (*self.step[s].get(words[k], ()), *self.free[s])})
            if not states:
                break
            if self.end in states:
                best = k + 1
        return best


@cache
def _compiled() -> tuple[list[tuple[str, float, TokenAutomaton]], list[tuple[bytes, str]]]:
    automata = [(label, own, TokenAutomaton(template)) for label, own, template in TEMPLATES]
    return automata, [(b" " + p.encode() + b" ", label) for p, label in BASE_PHRASES.items()]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
    """n_words, n_base, first_word, last_word, base labels, all labels, score of one text."""
    automata, phrases = _compiled()
    flat = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    n_words = flat.count(b" ") - 1 if len(flat) > 2 else 0
    places, base = [], set()
    for padded, label in phrases:
        at, seen, words_before = flat.find(padded), 0, 0
        while at >= 0:
            words_before += flat.count(b" ", seen, at)
            places.append(words_before)
            base.add(label)
            seen, at = at, flat.find(padded, at + 1)
    labels, score = set(base), 0.5 if base else 0.0
    seen_signs = {sign for sign in {a.sign for *_, a in automata} if sign in flat}
    if seen_signs:
        words = flat.split()
        at = {}
        for k, word in enumerate(words):
            at.setdefault(word, []).append(k)
        for label, own, automaton in automata:
            if automaton.sign not in seen_signs:
                continue
            taken_back = False
            for k in (k for w in automaton.first for k in at.get(w, ())):
                if automaton.accepts(words, k):
                    labels.add(label)
                    taken_back = bool(k) and words[k - 1] in NEGATIONS
                    if not taken_back:
                        score = max(score, own)
                        break
            if taken_back:
                score = max(score, NEGATED)
    return n_words, len(places), min(places, default=None), max(places, default=None), base, labels, score


_SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document.

    docs has doc_id (long) and text; other columns are ignored.  A null or empty text has no words,
    no places (first_word and last_word null), empty labels and score 0.  score is the best of the
    accepting templates', 0.5 where only a base phrase stands, else 0.  Repeated rows each give a row, null ids too;
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            joined = [pa.array([",".join(sorted(x)) for x in c], pa.string()) for c in cols[4:6]]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *joined, pa.array(cols[6], pa.float64())], [x.split()[0] for x in _SCANNED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SCANNED)
