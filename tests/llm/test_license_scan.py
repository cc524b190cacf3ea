import math
import random
import re
from collections import Counter

import pytest
from llm_helpers import prose

from quern.llm import license_scan as ls

APACHE, MIT = "Licensed under the Apache License, Version 2.0", "The MIT License (MIT)"
GRANT = ls.TEMPLATES["MIT"][4]


class Plain:
    """Every span of every template, each with its own Counter."""

    def __init__(self):
        self.docs = [(k, ls._WORD.findall(t.lower())) for k, ts in ls.TEMPLATES.items() for t in ts]
        n = Counter(w for _, ws in self.docs for w in set(ws))
        self.idf = lambda w: 1 + math.log((1 + len(self.docs)) / (1 + n[w]))

    def vector(self, words):
        return {w: (1 + math.log(k)) * self.idf(w) for w, k in Counter(words).items()}

    def scan(self, text):
        words = ls._WORD.findall((text or "").lower())
        best, out, hit = 0.0, (None, 0.0), set()
        for name, ws in self.docs:
            t, size = self.vector(ws), min(len(ws), len(words))
            norm = math.sqrt(sum(x * x for x in t.values()))
            for at in range(len(words) - size + 1) if size else ():
                v = self.vector(words[at : at + size])
                c = sum(x * t.get(w, 0) for w, x in v.items()) / norm / math.sqrt(sum(x * x for x in v.values()))
                if c >= ls.MATCH - 1e-9:
                    hit.update(range(at, at + size))
                    if c * c * norm > best + 1e-6:
                        best, out = c * c * norm, (name, c)
        return *out, len(hit) / max(len(words), 1)


def brute(rows):
    """Plain walk up the tree, over plain scans."""
    plain, own, governs = Plain(), [], {}
    for i, p, t in rows:
        o, c, share = plain.scan(t)
        own.append(o)
        if o and p is not None and (share >= ls.MOSTLY or re.search(ls._NAME.replace("(?i)", ""), p, re.I)):
            d = p.rpartition("/")[0]
            rank = (-round(c, 9), i is None, i or 0, o)
            if d not in governs or rank < governs[d][0]:
                governs[d] = (rank, o)
    out = []
    for (i, p, _), o in zip(rows, own):
        if o:
            out.append((i, p, o, "own", None))
            continue
        d = None if p is None else p.rpartition("/")[0]
        while d is not None and d not in governs:
            d = d.rpartition("/")[0] if d else None
        out.append((i, p, governs[d][1] if d is not None else None, "inherited" if d is not None else "none", d))
    return sorted(out, key=str)


DEEP = "/".join(f"d{k}" for k in range(40))
ROWS = [
    (1, "LICENSE", MIT), (2, "a.c", "int main;"), (3, "lib/x/y/z.c", "code"), (4, "lib/LICENSE.txt", "some words\n" + APACHE + "\nmore and more words of the text"), (5, "lib/x/note.md", "# " + MIT),
    (6, "lib/x/y/h.c", "/* " + APACHE + " */\n" + "code " * 50), (7, "other/deep/down/f", None), (8, None, MIT), (9, None, "nothing"), (None, "lib/x/q", ""), (10, "solo/COPYING", APACHE), (11, "solo/NOTICE", MIT),
    (12, "solo/a", "x"), (12, "solo/a", "x"), (13, "/abs/file", "x"), (14, "lib2/a", "x"), (15, "tail", "Released under the MIT License."),
    (20, f"{DEEP}/x/LICENSE", MIT), (21, f"{DEEP}/x/in.txt", "t"), (22, f"{DEEP}/y/a.txt", "t"), (23, f"{DEEP}/x/y/z/w.txt", "t"), (24, f"{DEEP}/LICENSE", APACHE), (25, "d0/d1/c.txt", "t"),
    (26, "long/LICENSE", "Copyright (c) 2019 Foo Inc.\n" + GRANT), (27, "long/t.txt", prose(1, 3000)),
]


def run(spark, rows):
    df = spark.createDataFrame([(i, p, t, "z", 1) for i, p, t in rows], "doc_id long, path string, text string, own string, _depth int").repartition(3)
    return sorted(((r.doc_id, r.path, r.license, r.basis, r.inherited_from) for r in ls.licenses(df).collect()), key=str)


def test_matches_a_plain_walk(spark):
    got = run(spark, ROWS)
    assert got == brute(ROWS)
    by = {r[0]: r for r in got}
    assert by[22][2:] == ("Apache-2.0", "inherited", DEEP) and by[23][2:] == ("MIT", "inherited", f"{DEEP}/x")


def test_a_folder_with_most_files_is_split(spark):
    rows = [(0, "all/LICENSE", MIT)] + [(i, f"all/f{i}", "x") for i in range(1, 3000)] + [(5000 + i, f"all/s{i}/f", "x") for i in range(1500)] + [(None, None, "x")] * 1200
    got = run(spark, rows)
    assert len(got) == len(rows) and sum(r[3] == "inherited" for r in got) == 4499


def test_empty_table(spark):
    assert run(spark, []) == []


def test_spans_are_those_of_a_plain_scan():
    index, plain, r = ls.TemplateIndex(ls.TEMPLATES), Plain(), random.Random(4)
    words = [w for _, ws in plain.docs for w in ws]
    texts = [None, "", "!!", "the", "license " * 30, "All rights reserved"]
    for _ in range(40):
        t = [r.choice(words) for _ in range(r.randrange(1, 60))]
        name = r.choice(list(ls.TEMPLATES))
        notice = r.choice(ls.TEMPLATES[name]).split()
        if r.random() < 0.7:
            for _ in range(r.randrange(3)):
                notice[r.randrange(len(notice))] = "changed"
            t[r.randrange(len(t)) : 0] = notice
        texts.append(" ".join(t))
    for t in texts:
        got, want = index.scan(t), plain.scan(t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2]), t


def test_notices_are_found_among_other_words():
    index = ls.TemplateIndex(ls.TEMPLATES)
    for name, texts in ls.TEMPLATES.items():
        for t in texts:
            assert index.scan(t.upper() + ".")[0] == name and index.scan(t)[1] > 0.999, t
            assert index.scan(f"{prose(3, 30)}\n# {t}\n{prose(4, 30)}")[0] == name, t
    for text, name in (
        ("Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Copyright (c) 2019 Foo Inc. All rights reserved.", "LicenseRef-Proprietary"),
        ("This article is released under the MIT License and may be copied by anyone.", "MIT"), ("Copyright (c) 2001 Foo. All rights reserved. " + ls.TEMPLATES["BSD-3-Clause"][3], "BSD-3-Clause"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), (GRANT[:300], "MIT"), ("This program is free software; " + ls.TEMPLATES["GPL-2.0"][3][31:], "GPL-2.0"),
    ):
        assert index.scan(text)[0] == name, text
    assert index.scan("the license of the work was given to the public in the year of the great version")[0] is None
    assert index.scan("")[0] is None


def test_documents_become_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ls.licenses(ls.document_files(docs)).collect()
    assert len(got) == docs.count()
    assert all((r.basis == "own") == (r.own is not None) for r in got) and any(r.basis == "own" for r in got)
