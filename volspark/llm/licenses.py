"""License scans: phrases, and templates whose optional and replaceable regions become token automata.

Markup of a template: words outside marks are mandatory, ``<<optional>> ... <<end>>`` may be absent as a whole (and
nests), ``<<var N>>`` stands for one to N words of any kind, ``<<any N>>`` for none to N. A template compiles to an automaton over words
(one state per mandatory word, empty moves over optional regions, counting states for replaceable ones); a text is
accepted where, from some word on, the automaton reaches its end, so mandatory wording must match exactly and only
punctuation, case of A-Z and white space are free. Automata start only at words that can begin their template and run only in texts
that hold the template's longest mandatory word. Templates hold whole licence texts (MIT, BSD, ISC) and the notices that files of
the others carry.

Defined cases: null is the empty text; empty texts have no labels and score 0; repeated rows get a row each; a very long text takes some
100 bytes a word, once. The score is 1 with an accepted
template, 0.5 with base phrases only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from volspark.llm.common import WORD_TABLE, slices, table

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_WARRANTY_MIT = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<var 2>> "
    "in no event shall the <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = "<<any 1>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_FSF = "as published by the free software foundation either version <<var 2>> of the license or <<optional>> at your option <<end>> any later version"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"

#: Wording of public licence texts and notices, with replaceable and optional regions marked up.
TEMPLATES = {
    "agpl-3.0": f"{_FREE} affero general public license as published by the free software foundation either version 3 of the license or <<optional>> at your option <<end>> any later version <<optional>> <<any 12>> {_NO_WARRANTY} affero general public license for more details <<end>>",
    "apache-2.0": "<<optional>> licensed under <<end>> the apache license version 2 0 <<optional>> the license you may not use this file except in compliance with the license "
    "<<optional>> you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license <<end>> <<end>>",
    "bsd-2-clause": f"{_BSD_START} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_START} {_BSD_THIRD} {_BSD_END}",
    "cc-by-4.0": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<optional>> creative commons attribution <<optional>> 4 0 international <<end>> license <<end>> cc by 4 0",
    "cc-by-nc-4.0": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc 4 0",
    "cc-by-nc-named": "creative commons attribution noncommercial <<optional>> sharealike <<end>> <<optional>> noderivatives <<end>> <<var 2>> <<optional>> international <<end>> license",
    "cc-by-named": "creative commons attribution <<optional>> sharealike <<end>> <<optional>> noderivatives <<end>> <<any 2>> <<optional>> international <<end>> license",
    "cc0-1.0": "<<optional>> to the extent possible under law <<var 12>> <<optional>> has <<end>> <<optional>> have <<end>> waived all copyright and related or neighboring rights to <<var 12>> <<end>> cc0 1 0 <<optional>> universal <<end>>",
    "gpl-3.0": "<<optional>> licensed under <<end>> the <<optional>> terms of the <<end>> gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3",
    "gpl-notice": f"{_FREE} general public license {_FSF} <<optional>> <<any 12>> {_NO_WARRANTY} general public license for more details <<end>>",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software",
    "lgpl-notice": f"{_FREE} lesser general public license {_FSF} <<optional>> <<any 12>> {_NO_WARRANTY} lesser general public license for more details <<end>>",
    "lgpl-2.0-notice": f"{_FREE} library general public license {_FSF} <<optional>> <<any 12>> {_NO_WARRANTY} library general public license for more details <<end>>",
    "mit-notice": "<<optional>> this <<var 4>> is <<end>> <<optional>> released <<end>> <<optional>> licensed <<end>> <<optional>> distributed <<end>> under the <<optional>> terms of the <<end>> mit license",
    "mit-text": "<<optional>> <<optional>> the <<end>> mit license <<optional>> mit <<end>> <<end>> <<optional>> copyright <<optional>> c <<end>> <<var 12>> <<end>> "
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    f"the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software {_WARRANTY_MIT}",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http <<any 1>> mozilla org mpl 2 0",
    "spdx-tag": "spdx license identifier <<var 3>>",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


class TemplateAutomaton:
    """words[s] is the word that leaves state s (None: any word), empty[s] the states reached from it without a word."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.empty: dict[int, list[int]] = {}
        open_: list[int] = []
        depth_words: list[bytes] = []
        tokens = template.replace("<<var ", "<<var_").replace("<<any ", "<<any_").split()
        for tok in tokens:
            at = len(self.words)
            if tok == "<<optional>>":
                open_.append(at)
            elif tok == "<<end>>":
                self.empty.setdefault(open_.pop(), []).append(at)
            elif tok.startswith(("<<var_", "<<any_")):
                n = int(tok[6:].rstrip(">"))
                self.words += [None] * n
                first = at if tok.startswith("<<any_") else at + 1
                for s in range(first, at + n):
                    self.empty.setdefault(s, []).append(at + n)
            else:
                self.words.append(tok.encode())
                if not open_:
                    depth_words.append(self.words[-1])
        if open_:
            raise ValueError(f"unclosed optional region: {template}")
        if not depth_words:
            raise ValueError(f"no mandatory word: {template}")
        self.end = len(self.words)
        self.needs = max(depth_words, key=len)
        if self.end in self._closed({0}):
            raise ValueError(f"nothing of it is mandatory: {template}")
        self.first = {self.words[s] for s in self._closed({0}) if s < self.end}

    def _closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self._closed({0})
        while self.end not in states:
            if at >= len(words) or not states:
                return False
            w = words[at]
            states = self._closed({s + 1 for s in states if self.words[s] is None or self.words[s] == w})
            at += 1
        return True

    def accepts(self, words: list[bytes]) -> bool:
        anywhere = None in self.first
        return any((anywhere or w in self.first) and self.accepts_at(words, i) for i, w in enumerate(words))


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(label, b" " + p.encode() + b" ") for label, p in sorted(phrases.items())]
        self.templates = [(label, TemplateAutomaton(t)) for label, t in sorted(templates.items())]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for label, p in self.phrases:
            at = line.find(p)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = line.find(p, at + 1)
        more = {label for label, t in self.templates if b" " + t.needs + b" " in line and t.accepts(words)}
        first = last = None
        if places:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            first, last = (int(np.searchsorted(spaces, x)) for x in (min(places), max(places)))
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score. No shuffle."""
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for b in slices(batches):
            rows = [scanner.scan(t.as_py()) for t in b.column(1)]
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True))], names=[id_col, *(n for n, _ in kinds)])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"{id_col} {source.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def template_pattern(template: str) -> str:
    """The template as a regular expression over words, each followed by a space: for SQL."""
    out = []
    for tok in template.replace("<<var ", "<<var_").replace("<<any ", "<<any_").split():
        if tok == "<<optional>>":
            out.append("(?:")
        elif tok == "<<end>>":
            out.append(")?")
        elif tok.startswith("<<"):
            out.append(f"(?:[^ ]+ ){{{0 if tok.startswith('<<any_') else 1},{tok[6:].rstrip('>')}}}")
        else:
            out.append(f"{tok} ")
    return " " + "".join(out)


_PLACES = " UNION ALL ".join(f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + {len(p.split())}) = {p.split()!r})) AS i FROM d" for label, p in sorted(PHRASES.items()))
_MORE = " UNION ALL ".join(f"SELECT r, '{label}' AS label FROM d WHERE regexp_matches(line, '{template_pattern(t)}')" for label, t in sorted(TEMPLATES.items()))
OP6_SQL = rf"""
WITH e AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM e),
p AS ({_PLACES}), m AS ({_MORE}),
b AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM p GROUP BY r),
t AS (SELECT DISTINCT r FROM m),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(b.ls, '') AS base_labels, coalesce(l.ls, '') AS labels, CAST(CASE WHEN t.r IS NOT NULL THEN 1 WHEN n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN t USING (r)
"""
