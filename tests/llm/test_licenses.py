import random
import re

from tests.llm.fixtures import EDGE, docs, words
from volspark.llm import licenses as L


def brute(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    places, labels = [], set()
    for label, p in L.PHRASES.items():
        x = p.encode().split()
        for i in range(len(w) - len(x) + 1):
            if w[i : i + len(x)] == x:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [*EDGE, "MIT-License, mit license", "x General Public\nLicense y Apache License", "mit licenses", "smit license", "mit license " * 3, words(3, 50) + " apache license", "é mit license"]


def test_base_equals_brute_force(spark):
    rows = L.scan_licenses(docs(spark, TEXTS)).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1
    assert L.scan_licenses(docs(spark, TEXTS).limit(0)).count() == 0


def test_templates():
    s = L.Scanner(L.PHRASES, L.TEMPLATES)
    labels = lambda t: s.scan(t)[5]
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("Licensed under an Apache License, Version 2.0.") == "apache"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("licensed under the terms of the GNU General Public License version 3") == "gpl,gpl-3.0"
    assert labels("Released under the MIT License.") == "mit,mit-notice"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0"
    assert labels("SPDX-License-Identifier: MIT") == "spdx-tag"
    assert labels("SPDX-License-Identifier:") == ""


def test_automaton():
    a = L.TemplateAutomaton("a <<optional>> b <<optional>> c <<end>> <<end>> <<var 2>> d")
    yes = ["a x d", "a x y d", "a b x d", "a b c x d", "q a d d"]
    no = ["a d", "a x y z d", "a b c", ""]
    assert all(a.accepts([w.encode() for w in t.split()]) for t in yes)
    assert not any(a.accepts([w.encode() for w in t.split()]) for t in no)
    assert L.TemplateAutomaton("a <<any 2>> d").accepts([b"a", b"d"])


MIT = """MIT License

Copyright (c) 2024 Some One <a@b.org>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL2 = """This file is part of Foo. Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD3 = """Copyright 2020 X. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_texts():
    s = L.Scanner(L.PHRASES, L.TEMPLATES)
    labels = lambda t: s.scan(t)[5]
    assert labels(MIT) == "mit,mit-text"
    assert labels(MIT.replace("without limitation", "with limitation")) == "mit"
    assert labels(MIT.split("THE SOFTWARE IS")[0]) == "mit"
    assert labels("x " + BSD3) == "bsd-3-clause"
    assert labels(BSD3.replace("3. Neither", "Neither").replace("prior written", "prior")) == ""
    two = BSD3.split("3. Neither")[0] + "THIS SOFTWARE" + BSD3.split("THIS SOFTWARE", 1)[1]
    assert labels(two) == "bsd-2-clause"
    assert labels(GPL2) == "gpl,gpl-notice"
    assert labels(GPL2.replace("GNU General", "GNU Lesser General")) == "gpl,lgpl-notice"
    assert labels(GPL2.replace("GNU General", "GNU Affero General").replace("version 2", "version 3")) == "agpl-3.0,gpl"
    assert labels(GPL2.replace("; either version 2 of the License, or (at your option) any later version", ", version 2")) == "gpl"


def meets(tokens, words, at):
    """Ends of the matches of a template from words[at] on, by trying every choice."""
    if not tokens:
        return {at}
    head, rest = tokens[0], tokens[1:]
    if head == "<<optional>>":
        depth, k = 1, 0
        while depth:
            depth += {"<<optional>>": 1, "<<end>>": -1}.get(rest[k], 0)
            k += 1
        return meets(rest[k:], words, at) | {z for e in meets(rest[: k - 1], words, at) for z in meets(rest[k:], words, e)}
    if head.startswith("<<"):
        low, n = (0 if head.startswith("<<any") else 1), int(head[6:-2])
        return {z for k in range(low, n + 1) if at + k <= len(words) for z in meets(rest, words, at + k)}
    return meets(rest, words, at + 1) if at < len(words) and words[at] == head else set()


def test_automata_equal_brute_force():
    r = random.Random(5)
    for seed in range(300):
        parts = ["<<optional>>", "a", "<<end>>", "b", "<<var_2>>", "c", "<<optional>>", "a", "<<optional>>", "<<any_1>>", "d", "<<end>>", "<<end>>", "b"]
        if seed % 2:
            parts = ["a", "<<any_2>>", "<<optional>>", "b", "c", "<<end>>", "a"]
        template = " ".join(parts).replace("_", " ")
        w = [r.choice("abcd") for _ in range(r.randint(0, 9))]
        want = any(meets([p.replace("var_", "var ").replace("any_", "any ") for p in parts], w, i) for i in range(len(w) + 1))
        assert L.TemplateAutomaton(template).accepts([x.encode() for x in w]) == want
        assert bool(re.search(L.template_pattern(template), " " + "".join(x + " " for x in w))) == want
