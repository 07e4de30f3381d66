"""License scans by patience alignment.

A license matches where patience alignment covers ``COVERAGE`` of its template's words or more: anchors are words that
occur once in both texts, the longest increasing subsequence of anchors is kept, and the gaps between anchors are
aligned likewise, as are equal words beside an anchor.

Only passages that can reach the coverage are aligned. A template of n words that is covered so far misses at
most ``n - needed`` words, so of any larger set of its words one is there; the longest words are that set, and each
place of one of them gives a passage of the template's length and ``SLACK`` of it on both sides.

Words are runs of letters and digits, lower-cased. Templates are parameters; the built-in ones are common notices
and permission texts. Words that tell a license from its relatives (``DECIDING``) must be covered, however much else is, and words
that make a relative of it (``FORBIDDEN``) may not stand between the first and the last covered word. Where passages overlap, of one license or several, the one with more covered words is kept, then the better covered, then the first.

Defined cases: null and empty text give no row; every passage that matches gives a row; repeated rows are scanned one by
one; very long texts are scanned whole; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

COVERAGE, SLACK = 0.8, 0.3

#: Published license notices and permission texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "MIT-line": "is MIT licensed",
    "GPL-3.0-line": "GNU General Public License version 3",
    "GPL-2.0-line": "GNU General Public License version 2",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Words of a template that a passage must have.
DECIDING = {
    "MIT-notice": "mit", "Apache-2.0-notice": "apache 2", "GPL-3.0-notice": "general 3", "GPL-2.0-notice": "general 2", "CC-BY-NC-4.0-notice": "nc 4", "CC-BY-4.0-short": "cc by 4", "CC-BY-4.0-notice": "attribution 4",
    "CC-BY-SA-4.0-notice": "attribution sharealike 4", "Apache-2.0": "apache", "GPL-3.0-or-later": "general 3 later", "GPL-2.0-or-later": "general 2 later", "LGPL-2.1-or-later": "lesser 2 1 later",
    "AGPL-3.0-or-later": "affero 3 later", "MPL-2.0": "mozilla", "BSD-3-Clause": "neither endorse", "ISC": "permission fee",
    "CC-BY-SA-4.0-short": "cc by sa 4", "CC-BY-ND-4.0-short": "cc by nd 4", "CC-BY-NC-SA-4.0-short": "cc by nc sa 4", "CC-BY-NC-ND-4.0-short": "cc by nc nd 4", "MIT-line": "mit licensed", "GPL-3.0-line": "general 3", "GPL-2.0-line": "general 2",
}
_NC, _SA, _ND = "nc noncommercial", "sa sharealike", "nd noderivatives noderivs"
#: Words that make another license of a passage, and so may not stand in it.
FORBIDDEN = {
    "CC-BY-4.0-short": f"{_NC} {_SA} {_ND}", "CC-BY-4.0-notice": f"{_NC} {_SA} {_ND}", "CC-BY-SA-4.0-notice": f"{_NC} {_ND}", "CC-BY-NC-4.0-notice": f"{_SA} {_ND}", "CC-BY-SA-4.0-short": f"{_NC} {_ND}", "CC-BY-ND-4.0-short": f"{_NC} {_SA}",
    "CC-BY-NC-SA-4.0-short": _ND, "CC-BY-NC-ND-4.0-short": _SA, "GPL-3.0-notice": "lesser affero library", "GPL-2.0-notice": "lesser affero library", "GPL-3.0-line": "lesser affero library", "GPL-2.0-line": "lesser affero library",
    "GPL-3.0-or-later": "lesser affero", "GPL-2.0-or-later": "lesser affero",
}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = sorted((i, once_b[w]) for w, i in once_a.items() if w in once_b)
        last = (a0, b0)
        for i, j in _increasing(anchors):
            out.append((i, j))
            stack.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if last != (a0, b0):
            stack.append((last[0], a1, last[1], b1))
    return sorted(out)


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for k in range(lo, hi):
        seen[words[k]] = -1 if words[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in the second place too."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before.append(piles[p - 1] if p else -1)
        tops[p : p + 1], piles[p : p + 1] = [j], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, deciding: dict[str, str] = DECIDING, forbidden: dict[str, str] = FORBIDDEN):
        self.templates = {name: w for name, t in templates.items() if (w := words_of(t))}
        self.needed = {name: max(1, -int(-coverage * len(w) // 1)) for name, w in self.templates.items()}
        self.deciding = {name: set(words_of(deciding.get(name, ""))) for name in self.templates}
        self.forbidden = {name: set(words_of(forbidden.get(name, ""))) for name in self.templates}
        self.seeds: dict[str, list[tuple[str, int]]] = {}
        for name, w in self.templates.items():
            order = sorted(range(len(w)), key=lambda k: (-len(w[k]), k))
            for k in order[: len(w) - self.needed[name] + 1]:
                self.seeds.setdefault(w[k], []).append((name, k))
        self.any = re.compile("|".join(sorted(map(re.escape, self.seeds), key=len, reverse=True)) or r"(?!)")

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word)."""
        if not text or not self.any.search(low := text.lower()):
            return []
        doc = _WORD.findall(low)
        spots: dict[str, set[int]] = {}
        for p, w in enumerate(doc):
            for name, k in self.seeds.get(w, ()):
                spots.setdefault(name, set()).add(p - k)
        found = {(len(pairs), name, lo + pairs[0][1], lo + pairs[-1][1] + 1) for name, starts in spots.items() for lo, pairs in self._passages(name, sorted(starts), doc)}
        kept: list[tuple[int, int, str, float]] = []  # in order of place; none overlap
        for n, name, a, b in sorted(found, key=lambda x: (-x[0], -x[0] / len(self.templates[x[1]]), x[2], x[1], x[3])):
            k = bisect_left(kept, (a,))
            if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
                insort(kept, (a, b, name, n / len(self.templates[name])))
        return [(name, share, a, b) for a, b, name, share in kept]

    def _passages(self, name: str, starts: list[int], doc: list[str]):
        """(first word, alignment) of each place where the template is covered."""
        template, deciding = self.templates[name], self.deciding[name]
        slack = int(len(template) * SLACK) + 1
        for s in starts:
            lo, hi = max(0, s - slack), min(len(doc), s + len(template) + slack)
            pairs = patience(template, doc[lo:hi])
            if len(pairs) >= self.needed[name] and deciding <= {template[i] for i, _ in pairs} and self.forbidden[name].isdisjoint(doc[lo + pairs[0][1] : lo + pairs[-1][1]]):
                yield lo, pairs


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per matching passage: id, license, coverage, start, end (words, end exclusive)."""
    scanner = Scanner(templates, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<license: string, coverage: double, start: bigint, end: bigint>>")
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("license", "coverage", "start", "end"), r, strict=True)) for r in scanner.scan(t)] for t in texts.to_pylist()], kind)

    return small_batches(df).select(df[id_col].alias("__id"), F.explode(scan(df[text_col].cast("string"))).alias("x")).select(F.col("__id").alias(id_col), "x.*")
