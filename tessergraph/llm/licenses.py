"""License scans by patience alignment.

Texts and templates are lower-case words. Where a text has runs of a template's word pairs, that part of it is aligned with
the template: words that both hold exactly once are anchors, the longest increasing run of them is kept, and the gaps
between anchors are aligned in the same way, down to common ends. The share of the template's words that align is its
coverage. Templates are whole licenses (the files of ``license_texts`` and TEMPLATES), and their openings, disclaimers,
headers and notices. No list of words decides which texts are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from tessergraph.llm.common import bounded_batches, plain_id, restored, table

#: Share of a template's words that must align, and the longest aligned part as a multiple of the template.
MIN_COVERAGE, MAX_STRETCH = 0.8, 1.5
#: Parts for longer templates are first counted word by word, as an alignment takes long.
LONG = 400
#: Parts that are tried for one length of a template, at most.
STRIDES = 50
_WORD = re.compile(r"[^\W_]+")

# Wording of public licenses and of their customary notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the terms of the MIT license.",
    "Apache-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-notice": "Licensed under CC BY-SA 4.0.",
    "CC-long-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "Apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "All-rights-reserved": "All rights reserved.",
    "MIT-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "BSD-no-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense-dedication": """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
        to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
        of all present and future rights to this software under copyright law.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
    "GPL-2-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
}
#: Whole texts put together of the parts above.
WHOLE = {
    "MIT-text": ("MIT", "MIT-disclaimer"),
    "ISC-text": ("ISC", "ISC-disclaimer"),
    "BSD-2-text": ("BSD", "BSD-disclaimer"),
    "BSD-3-text": ("BSD", "BSD-no-endorsement", "BSD-disclaimer"),
    "Unlicense-text": ("Unlicense", "Unlicense-dedication", "Unlicense-disclaimer"),
}


@lru_cache(1)
def all_templates() -> dict[str, str]:
    """TEMPLATES, the whole texts of WHOLE, and the files of license_texts as NAME-text."""
    files = {f"{f.stem}-text": f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return TEMPLATES | {name: " ".join(TEMPLATES[p] for p in parts) for name, parts in WHOLE.items()} | files


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first number, a longest run with increasing second numbers."""
    tops: list[int] = []
    heads: list[int] = []
    before = [-1] * len(pairs)
    for at, (_, second) in enumerate(pairs):
        pile = bisect_left(tops, second)
        before[at] = heads[pile - 1] if pile else -1
        tops[pile:] = [second, *tops[pile + 1 :]]
        heads[pile:] = [at, *heads[pile + 1 :]]
    out, at = [], heads[-1] if heads else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words, increasing on both sides, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        seen: dict[str, list[int]] = {}
        for side, words, low, high in ((0, left, a, b), (1, right, c, d)):
            for at in range(low, high):
                seen.setdefault(words[at], [0, 0, 0, 0])
                seen[words[at]][side] += 1
                seen[words[at]][2 + side] = at
        anchors = longest_increasing(sorted((x[2], x[3]) for x in seen.values() if x[0] == x[1] == 1))
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


@lru_cache(1)
def _index() -> tuple[dict[str, list[str]], dict[tuple[str, str], list[str]], dict[str, Counter]]:
    templates = {name: words_of(text) for name, text in all_templates().items()}
    pairs: dict[tuple[str, str], list[str]] = defaultdict(list)
    for name, words in templates.items():
        for pair in sorted(set(zip(words, words[1:]))):
            pairs[pair].append(name)
    return templates, pairs, {name: Counter(words) for name, words in templates.items()}


def widened(words: list[str], template: list[str], hits: list[int], low: int, matched: list[tuple[int, int]], reach: int) -> tuple[list[tuple[int, int]], int, int]:
    """(alignment, first word, word after the last) of a part that matches from ``low``, or of a better one that begins soon after.

    A part may begin in other text, before its license, and then end too soon. So it is aligned anew from its own first word
    as long as that is better, and where it is not yet whole also from hits within the template's length.
    """
    start, end = low + matched[0][0], low + matched[-1][0] + 1
    tried, step = start, max(1, len(template) // 10)
    for begin in [start, *hits]:
        if len(matched) == len(template) or begin > start + len(template):
            break
        if begin != start and begin < tried + step:
            continue
        tried = begin
        while len(better := align(words[begin : begin + reach], template)) > len(matched):
            matched, start, end = better, begin + better[0][0], begin + better[-1][0] + 1
            begin = start
    return matched, start, end


def scan(text: str | None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, word after the last) of parts of a text that match, in order, without overlaps."""
    if not text:
        return []
    templates, pairs, counts = _index()
    words = words_of(text)
    hits: dict[str, list[int]] = defaultdict(list)
    for at, pair in enumerate(zip(words, words[1:])):
        for name in pairs.get(pair, ()):
            hits[name].append(at)
    found = []
    held = Counter(words) if hits else Counter()
    for name, at in hits.items():
        template = templates[name]
        # No part can align with more words than the text has of the template's.
        if sum(min(n, held[w]) for w, n in counts[name].items()) < MIN_COVERAGE * len(template):
            continue
        # Parts that are tried begin ``stride`` words apart or more, and are that much longer than the longest that may match.
        least, stride = MIN_COVERAGE * len(template), max(1, len(template) // STRIDES)
        reach = int(len(template) * MAX_STRETCH) + stride
        done = wait = 0
        for k, first in enumerate(at):
            if first < max(done, wait):
                continue
            # The part from this hit; a hit that no alignment uses leaves a later one to begin its own.
            low, high = max(done, first - len(template) // 4), min(len(words), first + reach)
            if bisect_left(at, high) - k < max(1, len(template) // 8):
                continue
            if len(template) > LONG and (bound := (Counter(words[low:high]) & counts[name]).total()) < least:
                wait = first + max(stride, int(least - bound))
                continue
            matched = align(words[low:high], template)
            if len(matched) >= least:
                matched, start, end = widened(words, template, at[k : bisect_left(at, first + reach + len(template))], low, matched, reach)
                found.append((len(matched), len(matched) / len(template), name, start, end))
                done = end
            else:  # a part that reaches d words further has d aligned words more at most
                wait = first + max(stride, int(least - len(matched)))
    found.sort(key=lambda f: (-f[0], -f[1], f[2], f[3]))
    kept: list[tuple[str, float, int, int]] = []
    for _, coverage, name, start, end in found:
        if all(end <= s or start >= e for _, _, s, e in kept):
            kept.append((name, coverage, start, end))
    return sorted(kept, key=lambda f: f[2])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license part of each whole text: doc_id, license, coverage, start_word, end_word.

    A document without any, with a null or an empty text, has one row of nulls. Repeated rows give repeated results; a null
    id stays null (as does the one id -2**63); an empty table gives no rows. Texts of any length are scanned whole: an
    alignment takes a part of at most MAX_STRETCH times its template, and such a part also holds an eighth of the template's
    word pairs. Of parts that overlap, the one with most aligned words stays. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                rows += [(doc, name, round(cover, 6), start, end) for name, cover, start, end in scan(text)] or [(doc, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start_word", "end_word"])
            yield out.astype({"doc_id": batch["doc_id"].dtype, "coverage": "float64", "start_word": "Int64", "end_word": "Int64"})

    bounded_batches(docs)
    picked = docs.select(plain_id(docs[id_col]).alias("doc_id"), docs[text_col].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, license string, coverage double, start_word long, end_word long"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
