"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory (operator 9).

Every span of every file is compared with templates: one-line notices, standard headers and the grants and
conditions of whole licences. A span has as many words as the template (or is the whole text, if that is shorter),
so words around a notice cannot hide it and a licence file is compared as a whole. Words weigh
(1 + ln frequency) times their inverse frequency among the templates; words that no template has weigh most. Of
the spans whose cosine reaches MATCH, the one with the most evidence (cosine squared times the template's norm, so a
whole licence outweighs a phrase inside it) names the file's own license. A file is a license file of its directory if it is
named like one or if its matched spans make up most of its words. Files without a license of their own take that of
the nearest ancestor directory that has a license file.

A span can only reach MATCH if it holds one of the template's anchors: its rarest and longest words, without which
the rest of the template is too light. So only spans around anchors are compared, and none that could match is left
out.

Ancestors are found by path joins: every distinct directory, with each of its ancestors however deep, is looked up
in the table of licensed directories, which has one row per directory. Both tables are made with map-side partial
aggregation and joined by hot_join, so a directory that holds a third of all files, or is above a third of them, is
split.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, staged, trim
from quern.operators.skew import hot_join

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)


def _gpl(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


#: Notices, headers and bodies as they stand in files, by SPDX id. Public texts; a parameter of the scan.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License", "The MIT License (MIT)", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only", _gpl("General Public License", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", _gpl("General Public License", "2")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", _gpl("Lesser General Public License", "3")],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only", _gpl("Affero General Public License", "3")],
    "BSD-2-Clause": ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", _BSD],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "ISC License", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "LicenseRef-Proprietary": ["All rights reserved"],
}
MATCH, MOSTLY = 0.75, 0.5
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


class TemplateIndex:
    """The templates' TF-IDF vectors and, by anchor, the templates that a span around it may match."""

    def __init__(self, templates: dict[str, list[str]], match: float = MATCH) -> None:
        texts = [(k, _WORD.findall(t.lower())) for k, ts in templates.items() for t in ts]
        docs = [(k, w) for k, w in texts if w]
        frequency = Counter(w for _, ws in docs for w in set(ws))
        self.match = match
        self.unseen = 1 + math.log(1 + len(docs))
        self.idf = {w: 1 + math.log((1 + len(docs)) / (1 + n)) for w, n in frequency.items()}
        self.names = [k for k, _ in docs]
        self.sizes = [len(ws) for _, ws in docs]
        self.vectors: list[dict[str, float]] = []
        self.norms: list[float] = []
        self.anchors: dict[str, list[int]] = {}
        for i, (_, ws) in enumerate(docs):
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in Counter(ws).items()}
            self.vectors.append(v)
            total = rest = sum(x * x for x in v.values())
            self.norms.append(math.sqrt(total))
            for w in sorted(v, key=lambda w: (frequency[w], -len(w), w)):
                if rest < match * match * total - 1e-9:
                    break
                self.anchors.setdefault(w, []).append(i)
                rest -= v[w] * v[w]

    def spans(self, words: list[str], i: int, first: int, last: int):
        """(cosine, start) of every span of template i that starts from first to last; counts slide along."""
        size, vector, idf, unseen = min(self.sizes[i], len(words)), self.vectors[i], self.idf, self.unseen
        counts: dict[str, int] = {}
        dot = square = 0.0

        def move(w, by):
            nonlocal dot, square
            n = counts.get(w, 0)
            weight = idf.get(w, unseen)
            before, after = (1 + math.log(n) if n else 0.0), (1 + math.log(n + by) if n + by else 0.0)
            square += (after * after - before * before) * weight * weight
            dot += (after - before) * weight * vector.get(w, 0.0)
            counts[w] = n + by

        for w in words[first : first + size]:
            move(w, 1)
        for at in range(first, last + 1):
            yield dot / (math.sqrt(square) * self.norms[i]) if square > 1e-9 else 0.0, at
            if at < last:
                move(words[at], -1)
                move(words[at + size], 1)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(license, its cosine, share of words in matched spans); (None, 0, 0) where no span matches.

        Of equal evidence the earlier template counts, then the earlier span.
        """
        words = _WORD.findall((text or "").lower())
        have = set(words)
        may = {i for w in have & self.anchors.keys() for i in self.anchors[w]}
        # Words that the whole text lacks cannot be in a span: what is there must weigh enough.
        may = {i for i in may if sum(x * x for w, x in self.vectors[i].items() if w in have) >= (self.match * self.norms[i]) ** 2 - 1e-6}
        if not may:
            return None, 0.0, 0.0
        anchors, seen = self.anchors, {}
        for p, w in enumerate(words):
            for i in anchors.get(w, ()):
                if i in may:
                    seen.setdefault(i, []).append(p)
        best, name, cosine, covered = 0.0, None, 0.0, []
        for i in sorted(seen):
            size = min(self.sizes[i], len(words))
            top = len(words) - size
            ranges: list[list[int]] = []
            for p in seen[i]:
                lo, hi = max(0, p - size + 1), min(p, top)
                if ranges and lo <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(hi, ranges[-1][1])
                else:
                    ranges.append([lo, hi])
            for lo, hi in ranges:
                for c, at in self.spans(words, i, lo, hi):
                    if c >= self.match - 1e-9:
                        covered.append((at, at + size))
                        found = c * c * self.norms[i]
                        if found > best + 1e-6:
                            best, name, cosine = found, self.names[i], c
        done = end = 0
        for s, e in sorted(covered):
            done += max(0, e - max(s, end))
            end = max(end, e)
        return name, cosine, done / len(words) if covered else 0.0


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: dict[str, list[str]] | None = None, match: float = MATCH) -> DataFrame:
    """Per row: doc_id, path, own (license or null), cosine (of its span, else 0), share (of words in matched spans)."""
    small_batches(files.sparkSession)
    index_of = templates or TEMPLATES

    def work(batches):
        index = TemplateIndex(index_of, match)
        for b in batches:
            got = [index.scan(t) for t in b.column("text").to_pylist()]
            own, cosine, share = ([g[k] for g in got] for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())], names=["doc_id", "path", "own", "cosine", "share"])
        trim()

    rows = files.select(files[id_col].cast("long").alias("doc_id"), files[path_col].cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, path string, own string, cosine double, share double")


def licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: dict[str, list[str]] | None = None, match: float = MATCH, mostly: float = MOSTLY) -> DataFrame:
    """Per row of files: doc_id, path, own, cosine, license, basis (own, inherited or none), inherited_from.

    Of several license files in one directory the highest cosine counts, then the smallest id, then the license's
    name. Null paths have no directories; null and empty texts have no license. Null ids come last; repeated rows
    are answered once each. An empty table gives an empty result; other columns are ignored.
    """
    rows = staged(scan(files, path_col, text_col, id_col, templates, match), "license-scan")
    at = F.regexp_replace("path", r"/[^/]*$|^[^/]*$", "")
    governs = rows.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & ((F.col("share") >= mostly) | F.col("path").rlike(_NAME)))
    governs = governs.select(at.alias("dir"), "own", F.struct(-F.round("cosine", 9), F.col("doc_id").isNull(), "doc_id", "own").alias("_rank"))
    governs = governs.groupBy("dir").agg(F.min_by("own", "_rank").alias("dir_license"))
    # Distinct directories of files without a license, then each with its ancestors, one row at a time.
    need = staged(rows.filter("own is null and path is not null").groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n_files")), "directories")
    depth = F.when(F.col("at") == "", 0).otherwise(F.octet_length("at") - F.octet_length(F.replace("at", F.lit("/"), F.lit(""))) + 1)
    up = need.select("at", F.explode(F.sequence(F.lit(0), depth)).alias("level"))
    up = up.withColumn("dir", F.when(F.col("level") == 0, "").otherwise(F.expr("substring_index(at, '/', level)")))
    governs = staged(governs.join(up.groupBy("dir").agg(F.count(F.lit(1)).alias("n_below")), "dir"), "licensed")
    nearest = hot_join(up, governs, ["dir"], "n_below").groupBy("at").agg(F.max_by(F.struct("dir", "dir_license"), "level").alias("_from"))
    nearest = staged(nearest.join(need, "at"), "nearest")
    rows = hot_join(rows.withColumn("at", F.when(F.col("own").isNull(), at)), nearest, ["at"], "n_files", "left")
    return rows.select(
        "doc_id", "path", "own", "cosine",
        F.coalesce("own", "_from.dir_license").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("_from").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.col("_from.dir").alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: source/language/block of a hundred ids/id.txt."""
    block = F.format_string("%06d", F.coalesce(F.floor(F.col("doc_id") / 100), F.lit(0)))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), block, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
