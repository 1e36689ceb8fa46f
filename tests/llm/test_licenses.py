import re

import pytest

from sheaf.llm.licenses import PHRASES, TEMPLATES, Automaton, Scanner, license_report, words_of

S = Scanner(PHRASES, TEMPLATES)
labels = lambda t: sorted({v for v, *_ in S.scan(t)[2]})


def test_mandatory_wording_must_match():
    assert labels("Released under the MIT License.") == ["mit-notice"]
    assert labels("released UNDER the terms of the mit-license") == ["mit-notice"]
    assert labels("Released to the MIT License.") == []
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0-notice"]
    assert labels("Licensed under the Apache License, Version 1.1.") == []
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-notice"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    header = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {} except in compliance with the License. You may obtain a copy of the License at {} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    assert "apache-2.0-header" in labels(header.format("file", "")) and "apache-2.0-header" in labels(header.format("work of art", "https://www.apache.org/licenses/LICENSE-2.0"))
    assert "apache-2.0-header" not in labels(header.format("a b c d", ""))


def as_regex(t):
    """The same template as a regular expression over space-joined words."""
    out = ""
    for p in re.findall(r"<<[^>]*>>|[^<]+", t):
        if p == "<<optional>>":
            out += "(?:"
        elif p == "<<end>>":
            out += ")?"
        elif p.startswith("<<var;"):
            out += r"(?:\S+ ){0,%s}" % p[6:-2]
        elif p.startswith("<<any;"):
            out += "(?:" + "|".join("".join(w + " " for w in words_of(x)) for x in p[6:-2].split("|")) + ")"
        else:
            out += "".join(w + " " for w in words_of(p))
    return out


@pytest.mark.parametrize("label", TEMPLATES)
def test_automaton_accepts_what_the_regex_accepts(label):
    a, r = Automaton(TEMPLATES[label]), re.compile(as_regex(TEMPLATES[label]))
    whole = re.sub(r"<<any;([^|>]*)[^>]*>>", r"\1", TEMPLATES[label])
    kept, dropped = re.sub(r"<<[^>]*>>", "", whole), whole
    while (shorter := re.sub(r"<<optional>>((?!<<optional>>|<<end>>).)*<<end>>", "", dropped, flags=re.S)) != dropped:
        dropped = shorter
    for text in (kept, re.sub(r"<<[^>]*>>", "", dropped)):
        words = words_of(text)
        for i in range(-1, len(words)):
            w = words[:i] + ["zzz"] + words[i + 1 :] if i >= 0 else words
            m = r.match("".join(x + " " for x in w))
            # the regex takes its first way, the automaton the longest: they agree on acceptance
            assert (m is not None) == (a.longest(w, 0) is not None)


def test_bad_markup():
    for t in ("a <<optional>> b", "a <<end>>", "<<var;3>>", "<<huh>> a"):
        with pytest.raises(ValueError):
            Automaton(t)


def test_report(spark):
    texts = [None, "", "mit license MIT-License mit  License; mitlicense mit x license", "é😀 general public license " + "w " * 30_000 + "Apache license", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(4, texts[4], "z")], "doc_id long, text string, labels string")
    rows = sorted(license_report(docs).collect())
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows}
    assert len(rows) == 6 and rows[4] == rows[5]
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2] == (10, 3, 0, 4, "mit", "mit", 0.5)
    assert got[3] == (30_006, 2, 1, 30_004, "apache,gpl", "apache,gpl", 0.5)
    assert got[4] == (5, 1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert license_report(docs.limit(0)).count() == 0


def test_whole_texts():
    mit = TEMPLATES["mit-text"].replace("<<optional>>", "").replace("<<end>>", "").replace("<<any;authors|author>>", "AUTHORS").replace("<<any;holders|holder>>", "HOLDERS")
    assert set(labels("MIT License\n\nCopyright (c) 2020 X\n\n" + mit)) == {"mit-text", "mit-grant"}
    assert labels(mit.replace("free of charge", "for a fee")) == []
    assert labels("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.") == ["unlicense-text"]
    assert labels("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.") == ["mpl-2.0-notice"]
    assert labels("distributed under the terms of the GNU Lesser General Public License, version 2.1") == ["lgpl-notice"]
