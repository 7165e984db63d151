"""Licence scan: windows of text compared with licence templates by the Dice coefficient over word bigrams.

Words are runs of ASCII letters and digits, A-Z lower-cased, whatever lines they stand on; a window is a run of words, taken
as the set of its adjacent word pairs. Dice is twice the shared pairs over the sum of both sizes, so a template of b pairs can
reach the threshold t only with windows that share t*b/(2-t) pairs with it and are of at most (2-t)*b/t pairs. Templates with
too few of their pairs in reach of each other are given up; for the others all windows that begin and end with one of
their pairs are compared, as cutting a foreign pair off either end only raises the coefficient. So a notice is found
inside a long line, wrapped over lines, or in the middle of a file, and a full licence text like a short notice.

Texts are read in pieces that overlap by the largest window. Defined results: a null text is an empty text without
matches; texts with fewer than two words have none; for each template the best window counts, the first one of several; of
templates with equal Dice the first one in the list is the best; rows with a null id come back with a null id;
repeated rows repeat; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm.simhash import LOWER
from riffle.session import table

# Notices that licences tell their users to apply, and full texts of short licences without their copyright line, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
]
THRESHOLD = 0.8
WORDS = re.compile(rb"[a-z0-9]+")
#: Bytes of a text that are read at a time.
PIECE = 1 << 20


def pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    """The templates with their size bounds, and the templates of each pair."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.sizes: list[int] = []
        self.known: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (_, text) in enumerate(templates):
            own = pairs(WORDS.findall(text.encode().translate(LOWER)))
            self.sizes.append(len(own))
            for p in own:
                self.known.setdefault(p, []).append(k)
        self.least = [threshold * b / (2 - threshold) - 1e-9 for b in self.sizes]
        self.most = [longest(b, threshold) for b in self.sizes]
        self.reach = max(self.most)

    def matches(self, data: bytes) -> list[tuple[int, float, int, int]]:
        """Template, Dice, and first and last word of the best window of each template that reaches the threshold."""
        out: dict[int, tuple[float, int, int]] = {}
        words: list[bytes] = []
        before = at = 0
        while at < len(data):
            end = at + PIECE
            while end < len(data) and WORDS.match(data, end - 1) and WORDS.match(data, end):  # never inside a word
                end += 1
            keep = min(len(words), self.reach + 1)
            before += len(words) - keep
            words = words[len(words) - keep :] + WORDS.findall(data, at, end)
            at = end
            places: dict[int, list[int]] = {}
            for i, of in enumerate(map(self.known.get, zip(words, words[1:], strict=False))):
                if of:
                    for k in of:
                        places.setdefault(k, []).append(i)
            for k, found in places.items():
                if len(found) >= self.least[k]:
                    self._windows(k, found, words, before, out)
        return [(k, *out[k]) for k in sorted(out)]

    def _windows(self, k: int, places: list[int], words: list[bytes], before: int, out: dict[int, tuple[float, int, int]]) -> None:
        end = 0
        for x, i in enumerate(places):
            while end < len(places) and places[end] < i + self.most[k]:
                end += 1
            if end - x < self.least[k]:
                continue
            seen: set[tuple[bytes, bytes]] = set()
            shared: set[tuple[bytes, bytes]] = set()
            at = i
            for j in places[x:end]:
                seen.update(zip(words[at : j + 1], words[at + 1 : j + 2], strict=True))
                at = j + 1
                shared.add((words[j], words[j + 1]))
                dice = 2 * len(shared) / (len(seen) + self.sizes[k])
                if dice >= self.threshold and (k not in out or dice > out[k][0]):
                    out[k] = dice, before + i, before + j + 1
            if k in out and out[k][0] == 1:
                return


def longest(b: int, threshold: float) -> int:
    """Pairs of the longest window that a template of ``b`` pairs is compared with."""
    return int(b * (2 - threshold) / threshold + 1e-9)


def licence_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, matches``: an array of ``template`` (place in the list), ``licence``, ``dice``, ``first`` and ``last`` (words of the text, from 0)."""
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known, threshold)
        for batch in batches:
            found = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER)
                found.append([{"template": k, "licence": known[k][0], "dice": d, "first": a, "last": b} for k, d, a, b in matcher.matches(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    kind = pa.list_(pa.struct([("template", pa.int32()), ("licence", pa.string()), ("dice", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, matches array<struct<template:int,licence:string,dice:double,first:bigint,last:bigint>>")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("matches")
    best = F.array_max(F.transform(m, lambda x: F.struct(F.round(x["dice"], 9).alias("dice"), (-x["template"]).alias("order"), x["licence"].alias("licence"))))
    return licence_matches(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size(m).cast("long").alias("n_matches"), best["licence"].alias("licence"), best["dice"].alias("dice"), F.array_join(F.sort_array(F.array_distinct(F.transform(m, lambda x: x["licence"]))), ",").alias("licences")
    )


QUERIES = {"op2_licence_scan": op2_licence_scan}

_LOWER_SQL = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAIRS_SQL = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
ORACLES = {
    "op2_licence_scan": f"""WITH templates AS (SELECT k, licence, {_PAIRS_SQL} AS b FROM (SELECT k, licence, regexp_extract_all({_LOWER_SQL % "t"}, '[a-z0-9]+') AS w
  FROM (VALUES {", ".join("(%d, '%s', '%s')" % (k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))}) v(k, licence, t))),
docs AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS ps
  FROM (SELECT doc_id, regexp_extract_all({_LOWER_SQL % "coalesce(text, '')"}, '[a-z0-9]+') AS w FROM documents)),
places AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS pair FROM docs),
hits AS (SELECT doc_id, k, pos FROM places JOIN (SELECT k, unnest(b) AS pair FROM templates) USING (pair)),
enough AS (SELECT doc_id, k FROM hits JOIN templates USING (k) GROUP BY doc_id, k HAVING count(*) >= {THRESHOLD} * max(len(b)) / {2 - THRESHOLD} - 1e-9),
ends AS (SELECT a.doc_id, a.k, a.pos AS x, z.pos AS y FROM hits a JOIN enough USING (doc_id, k) JOIN templates t USING (k)
  JOIN hits z ON z.doc_id = a.doc_id AND z.k = a.k AND z.pos >= a.pos AND z.pos - a.pos < floor(len(t.b) * {2 - THRESHOLD} / {THRESHOLD} + 1e-9)),
windows AS (SELECT doc_id, k, licence, b, list_distinct(ps[x:y]) AS a FROM ends JOIN docs USING (doc_id) JOIN templates USING (k)),
hit AS (SELECT doc_id, k, licence, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM windows),
found AS (SELECT doc_id, k, licence, round(max(dice), 9) AS dice FROM hit WHERE dice >= {THRESHOLD} GROUP BY doc_id, k, licence)
SELECT d.doc_id, count(f.doc_id) AS n_matches, first(f.licence ORDER BY f.dice DESC, f.k) AS licence, max(f.dice) AS dice, coalesce(string_agg(DISTINCT f.licence, ',' ORDER BY f.licence), '') AS licences
FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id""",
}
