"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest increasing run of them is aligned,
and the gaps between are aligned the same way. The share of the template's words that align is its coverage. Where words of the
template repeat, as in a notice that stands twice, all alignments are compared instead.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from ratecraft.llm.common import map_rows

COVERAGE = 0.8
SLACK = 1.25  # a stretch may be longer than its template by this factor, and eight words
_WORD = re.compile(r"\w+")

#: fixed values: public notices of licenses
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "GPL-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    # long license texts are known by how they open
    "GPL-2.0-opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-2.1-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0-opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Apache-2.0-opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "MPL-2.0-opening": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (a, b) pairs, sorted by a, with rising b: cards dealt to piles, each remembering the pile before."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before[k] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words of two lists, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[k]: k for k in range(b0, b1)}
        anchors = _rising([(k, where[a[k]]) for k in range(a0, a1) if in_a[a[k]] == 1 == in_b.get(a[k], 0)])
        if anchors:
            out += anchors
            for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                if x1 - x0 > 1 and y1 - y0 > 1:
                    todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def _first_copy(own: list[str], template: list[str], least: int, reach: int) -> tuple[int, int, int] | None:
    """(aligned words, first, one past the last) of the first stretch of at most ``reach`` words that aligns ``least`` words.

    For windows in which words of the template come too often to be anchors, as where a notice stands twice: all alignments
    are kept, each by its number of words and, among equal ones, its latest start.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        at.setdefault(w, []).append(j)
    base = len(own) + 1
    best = np.full(len(template), -1, dtype=np.int64)  # by the last template word aligned or passed
    found = None
    for i, w in enumerate(own):
        if w not in at:
            continue
        places = np.array(at[w])
        before = np.where(places > 0, best[places - 1], -1)
        best[places] = np.maximum(best[places], np.where(before < 0, i, before) + base)
        best = np.maximum.accumulate(best)
        count, start = divmod(int(best[-1]), base)
        if found and (count <= found[0] or start != found[1]):
            if start >= found[2]:
                break
            continue
        if count >= least and i + 1 - start <= reach:
            found = count, start, i + 1
    return found


def _nearest(found: list[tuple[str, float, int, int]], sizes: dict[str, int]) -> list[tuple[str, float, int, int]]:
    """Without hits on a stretch of which another template aligns more words, or as many and a greater share of its own.

    Templates that differ by a word or a clause cover each other's notices. Stretches are the same if they share COVERAGE of the
    longer one; a sentence within a full text is a stretch of its own.
    """
    rank = lambda x: (round(x[1] * sizes[x[0]]), x[1])
    same = lambda x, y: min(x[3], y[3]) - max(x[2], y[2]) >= COVERAGE * max(x[3] - x[2], y[3] - y[2])
    near: list[tuple[str, float, int, int]] = []
    lost = set()
    for hit in sorted(found, key=lambda x: x[2]):
        near = [y for y in near if y[3] > hit[2]]
        for other in near:
            if same(hit, other) and rank(hit) != rank(other):
                lost.add(min(hit, other, key=rank))
        near.append(hit)
    return [hit for hit in found if hit not in lost]


def scan(own: list[str], templates: dict[str, list[str]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, one past the last) of every stretch that covers enough of a template.

    A stretch can cover the share only if it holds as many of the template's words; of those words, the one that is rarest in the
    text says where stretches lie.
    """
    counts = Counter(own)
    found = []
    places: dict[str, list[int]] = {}
    for name, template in templates.items():
        least = math.ceil(coverage * len(template) - 1e-9)  # the fewest words that cover the share
        if not template or sum(w in counts for w in template) < least:
            continue
        # enough rarest words that a stretch can't cover the share without one of them
        need, rare = len(template) - least + 1, []
        for w in sorted(set(template), key=lambda w: (counts.get(w, 0), w)):
            rare.append(w)
            need -= template.count(w)
            if need <= 0:
                break
        if any(w in counts for w in rare) and not places:
            for k, w in enumerate(own):
                places.setdefault(w, []).append(k)
        reach = int(len(template) * SLACK) + 8
        usual = Counter(template)
        best: list[tuple[float, int, int]] = []
        low = 0
        for at in sorted({k for w in rare for k in places.get(w, [])}):
            if at < low:
                continue
            start = max(low, at - reach)
            window = own[start : at + reach]
            here = Counter(w for w in window if w in usual)
            if sum((here & usual).values()) < least:
                continue
            copy = _first_copy(window, template, least, reach) if any(n > usual[w] for w, n in here.items()) else None
            if not copy:
                pairs = patience(window, template)
                copy = (len(pairs), pairs[0][0], pairs[-1][0] + 1) if len(pairs) >= least else None
            if copy:
                best.append((copy[0] / len(template), start + copy[1], start + copy[2]))
                low = best[-1][2]
        found += [(name, *b) for b in best]
    return _nearest(found, {name: len(template) for name, template in templates.items()})


def licenses(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word), one row per stretch of a document that holds a license notice.

    Whole texts are searched. Null, empty and wordless texts hold nothing; a text may hold several notices, and one notice several
    times. A stretch that several templates cover counts for the one with most aligned words. Templates without words find nothing. Repeated rows give repeated results. Other columns are not looked at. An empty
    table gives no rows.
    """
    split = {name: words(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    kind = dict(documents.dtypes)["doc_id"]

    def run(ids, texts):
        rows = [(one, *hit) for one, text in zip(ids, texts) for hit in scan(words(text), split, coverage)]
        return [list(column) for column in zip(*rows)] if rows else [[]] * 5

    return map_rows(documents.select("doc_id", "text"), run, f"doc_id {kind}, license string, coverage double, first_word int, last_word int", rows=128)
