"""License texts in documents, found by patience alignment.

Text and template are compared word by word. Words that occur once in both are anchors; the longest
chain of anchors in the order of both is kept, and the gaps between them are aligned the same way,
down to gaps without an anchor, where equal words at either end still count. The aligned share of the
template is its coverage. A text is looked at in regions in which rare words of the template crowd,
so that a notice in a long text, or the same notice twice, is aligned by itself.

Coverage alone would take a license for its neighbour, as most of their words are the same. So the words
that tell them apart (name, version, NC or SA) are marked in the templates as phrases, and every phrase
has to stand in the aligned stretch word for word, one right after the other. A template without a
phrase goes by its coverage alone. A license may have several wordings under one name.

A document's match is the template with the largest coverage of at least COVERAGE, on a tie the one
with more words, then the earlier name.

Defined cases: a null or empty text matches nothing. Case and punctuation do not count. Repeated rows
each get their row. An empty table gives an empty result. Templates without words are ignored. Extra
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Parameters: the least coverage, and the least words of a template that must be aligned.
COVERAGE = 0.8
LEAST_WORDS = 3
BATCH = 512

# License lines in the usual wordings, notices, and bodies (of Apache, GPL,
# LGPL-3.0 and AGPL an opening passage). Words between « and » tell a license from its neighbours.
LINES = {
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0", "GNU AGPL v3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD": ["under the BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0", "Creative Commons Zero 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0", "GNU GPL v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"],
    "Unlicense": ["under the Unlicense"],
}
for _kind, _long in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        LINES[f"CC-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"Creative Commons {_long} {_version}"]


def _wordings(name: str) -> list[str]:
    """The lines a license is usually named in."""
    if name.startswith("under "):
        return [f"Licensed «{name}».", f"Released «{name}»."]
    frames = "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}."
    return [frame.format(f"«{name}»") for frame in frames]


_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the «{name}» "
    "as published by the Free Software Foundation, either «version {version} of the License», or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the «{name}» for more "
    "details."
)
_GPL, _LESSER, _AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the "
)
_BSD_END = (
    'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD_NAME = (
    "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. THIS SOFTWARE "
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)

TEMPLATES: dict[str, str | list[str]] = {
    **{license: [line for name in names for line in _wordings(name)] for license, names in LINES.items()},
    **{f"{license} identifier": f"SPDX-License-Identifier: «Identifier: {license}»" for license in LINES if license not in ("BSD",)},
    "AGPL-3.0 notice": _GNU_NOTICE.format(name=_AFFERO, version=3),
    "AGPL-3.0 text": (
        "The «GNU Affero General Public License is a free, copyleft license for software» and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software."
    ),
    "Apache-2.0 notice": (
        'Licensed under the «Apache License, Version 2.0» (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "Apache-2.0 text": (
        "«TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION» 1. Definitions. \"License\" shall mean the terms and "
        "conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall "
        "mean the copyright owner or entity authorized by the copyright owner that is granting the License."
    ),
    "BSD-2-Clause text": f"{_BSD_TERMS}«distribution. THIS SOFTWARE» {_BSD_END}",
    "BSD-3-Clause text": [f"{_BSD_TERMS}«distribution. 3. Neither» {_BSD_NAME}{_BSD_END}", f"{_BSD_TERMS}«distribution. Neither» {_BSD_NAME}{_BSD_END}"],
    "BSD-4-Clause text": (
        f"{_BSD_TERMS}distribution. 3. «All advertising materials mentioning features» or use of this software must display "
        f"the following acknowledgement: 4. Neither {_BSD_NAME}{_BSD_END}"
    ),
    "CC0-1.0 notice": (
        "To the extent possible under law, the person who associated «CC0» with this work has waived all copyright and related "
        "or neighboring rights to this work."
    ),
    "GPL-2.0 notice": [
        _GNU_NOTICE.format(name=_GPL, version=2),
        f"This program is free software; you can redistribute it and/or modify it under the terms of the «{_GPL} version 2» "
        "as published by the Free Software Foundation.",
    ],
    "GPL-2.0 text": (
        "«The licenses for most software are designed» to take away your freedom to share and change it. By contrast, the "
        "«GNU General Public License is intended» to guarantee your freedom to share and change free software--to make sure the "
        "software is free for all its users."
    ),
    "GPL-3.0 notice": _GNU_NOTICE.format(name=_GPL, version=3),
    "GPL-3.0 text": (
        "The «GNU General Public License is a free, copyleft license for software» and other kinds of works. The licenses for most "
        "software and other practical works are designed to take away your freedom to share and change the works."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "«provided that the above copyright notice and this permission notice appear in all copies»."
    ),
    "0BSD text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "«hereby granted. THE SOFTWARE IS PROVIDED» AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
    ),
    "LGPL-2.1 notice": _GNU_NOTICE.format(name=_LESSER, version="2.1"),
    "LGPL-3.0 notice": _GNU_NOTICE.format(name=_LESSER, version=3),
    "LGPL-3.0 text": (
        "This version of the «GNU Lesser General Public License incorporates the terms» and conditions of version 3 of the GNU "
        "General Public License, supplemented by the additional permissions listed below."
    ),
    "MIT text": (
        f"{_MIT_GRANT}, «subject to the following conditions»: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-0 text": f"{_MIT_GRANT}. THE SOFTWARE IS PROVIDED".replace("to do so. THE SOFTWARE", "«to do so. THE SOFTWARE»"),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the «Mozilla Public License, v. 2.0». If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense text": (
        "«This is free and unencumbered software released into the public domain». Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
}
TEMPLATES["CC-BY-4.0"] = [*TEMPLATES["CC-BY-4.0"], "This work is licensed under a «Creative Commons Attribution 4.0» International License."]

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
# version 2.0 is version 2
ZEROS = re.compile(r"(?<=[0-9])(?:\.0)+$")
PHRASE = re.compile("«(.*?)»", re.DOTALL)


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(ZEROS.sub("", m[0].lower()), m.start(), m.end()) for m in WORD.finditer(text)]


def _joined(words: list[str]) -> str:
    """Words as one string to look phrases up in, in which both spellings of license are the same."""
    return " " + " ".join("license" if w == "licence" else w for w in words) + " "


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in both, of pairs sorted by the first: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        below.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[at], piles[at] = b, n
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = below[n]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, rising in both."""
    aligned: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            aligned.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            aligned.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + k for k, w in enumerate(template[c:d]) if there[w] == 1}
        anchors = _chain([(a + k, place[w]) for k, w in enumerate(text[a:b]) if w in place and here[w] == 1])
        if not anchors:
            continue
        aligned += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:])]
    return sorted(aligned)


class Scanner:
    """Templates prepared for scanning many texts."""

    def __init__(self, templates: dict[str, str | list[str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.forms = []  # name, words, distinct words with their counts, phrases
        for name, wordings in sorted(templates.items()):
            for text in [wordings] if isinstance(wordings, str) else wordings:
                words = [w for w, _, _ in words_of(text)]
                if words:
                    phrases = {_joined([w for w, _, _ in words_of(p)]) for p in PHRASE.findall(text)}
                    self.forms.append((name, words, Counter(words), sorted(phrases)))
        self.any = {w for _, words, *_ in self.forms for w in words}

    def _regions(self, places: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Where template words stand close together; a long stretch is cut into overlapping parts."""
        start = last = places[0]
        for place in [*places[1:], None]:
            if place is not None and place - last <= max(4, size // 4):
                last = place
                continue
            reach = 2 * size
            for at in range(start, max(start + 1, last + 2 - size), size):
                yield at, min(at + reach, last + 1)
            start = last = place

    def matches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, start, end, words of the template) of every region that holds enough of a template."""
        found = words_of(text)
        plain = [w for w, _, _ in found]
        held = self.any.intersection(plain)
        joined, seen = _joined(plain), {}
        made = []
        for name, template, own, phrases in self.forms:
            for p in phrases:
                if p not in seen:
                    seen[p] = p in joined
            if not all(seen[p] for p in phrases):
                continue
            # no alignment can hold more than all occurrences of the words the text has
            most = sum(n for w, n in own.items() if w in held)
            if most / len(template) < self.coverage or most < min(LEAST_WORDS, len(template)):
                continue
            places = [k for k, w in enumerate(plain) if w in own]
            for a, b in self._regions(places, len(template)):
                if b - a < self.coverage * len(template) * 0.9:
                    continue
                pairs = align(plain[a:b], template)
                share = len(pairs) / len(template)
                if share < self.coverage or len(pairs) < min(LEAST_WORDS, len(template)):
                    continue
                first, last = a + pairs[0][0], a + pairs[-1][0]
                # one word more, as a last "licence" is not aligned with "license"
                near = _joined(plain[first : last + 2])
                if all(p in near for p in phrases):
                    made.append((name, share, found[first][1], found[last][2], len(template)))
        return made

    def best(self, text: str | None) -> tuple[str | None, float, int | None, int | None, int]:
        made = self.matches(text) if text else []
        if not made:
            return None, 0.0, None, None, 0
        name, share, start, end, _ = min(made, key=lambda m: (-m[1], -m[4], m[0], m[2]))
        return name, share, start, end, len({m[0] for m in made})


RESULT = "doc_id bigint, license string, coverage double, start bigint, end bigint, n_licenses bigint"


def scan(documents: DataFrame, templates: dict[str, str | list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, license, coverage, start and end (code points), n_licenses."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = [scanner.best(t) for t in batch["text"]]
            made = pd.DataFrame(rows, columns=["license", "coverage", "start", "end", "n_licenses"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made.astype({"start": "Int64", "end": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(scanned, RESULT)
