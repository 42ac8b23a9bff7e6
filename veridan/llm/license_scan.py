"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; a shingle is two words. For templates of about the same
length L the text is cut into windows of three blocks of L/2 words, one block further each time, so any
passage of up to L words lies inside some window. Windows and templates get ``HASHES`` MinHash values in
bands; the rows of a band are as many as keep the probability that a window with a matching passage shares
a band at ``PROBABILITY`` or more (a template for which no choice does is an error). What is found is verified:
the share of the template's shingles in the window must be ``CONTAINED`` or more.

The words that carry a license's name, version or clauses are marked in its templates (braces): a match counts as that license
only if these phrases stand in the window word for word, no further digit behind a version, and no phrase that the license
bars (``BARRED``). Any other match of 0.8 is a text that resembles the license and is not it, or not known to be: it is reported
as ``unknown variant of`` its family, as are passages that several licenses of a family begin with.

Licenses that differ in a few words match one passage together: ``best`` tells which of a text's
licenses has a match that no other license's match in an overlapping window surpasses: a decided one surpasses an
undecided one, then containment counts, then the number of shingles matched.

Texts are scanned whole, many at a time and a long one in overlapping stretches, so memory is bounded; only the
templates, a fixed list, go to all tasks.

Defined cases: null and word-less texts match nothing; a text shorter than a window is one window. A
license found several times in a text is one row, the best and then the first window. Rows with the same
doc_id each give their own rows. Null doc_ids are returned as null. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import WordHashes, _mixed, kept_columns, slices, trim

HASHES, PROBABILITY, CONTAINED = 32, 0.999, 0.8
#: Words of one stretch of text, about, that is looked at at once.
AT_ONCE = 60_000
#: Bits of a shingle's hash that tell whether it may be a template's.
MARK_BITS = 20
#: Characters of text that are cut into words at once.
CHARS = 2_000_000


def _gnu(name: str, version: str, program: str = "program") -> list[str]:
    """Notices of the GNU licenses, by their public wording."""
    later = f"either {{version {version}}} of the License, or (at your option) any later version."
    free = f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {{{name}}} as published by the Free Software Foundation, "
    old = f"This {program} is free software; you can redistribute it and/or modify it under the terms of the {{{name}}} as published by the Free Software Foundation; "
    return [
        f"This work is licensed under the {{{name}, version {version}}}.", f"Licensed under the {{{name} version {version}}}.",
        free + later, old + later, free + f"{{version {version}}}.", old + f"{{version {version}}}.", f"{{{name} Version {version}}}",
    ]


def _creative(kind: str, short: str, version: str) -> list[str]:
    place = {"4.0": "International ", "3.0": "Unported ", "2.0": "Generic ", "2.5": "Generic "}.get(version, "")
    name = f"{{Creative Commons {kind} {version}}} {place}License"
    return [
        f"Licensed under {{CC {short} {version}}}.", f"This work is licensed under a {name}.", f"This work is licensed under the {name}. To view a copy of this license, visit",
    ]


#: The kinds and versions of the Creative Commons licenses.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_ADVERTISING = "All {advertising materials mentioning features} or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be {used to endorse or promote products} derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_END = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "{provided that the above copyright notice} and this permission notice appear in all copies. "
_MAY_NOT = "(the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_UNKNOWN = "unknown variant of "
#: Fixed values, by their public wording: notices by which texts state their license, and bodies of short licenses. In braces: what decides.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the {Apache License, Version 2.0}.", "Licensed under the {Apache License, Version 2.0} " + _MAY_NOT],
    "Apache-1.1": [
        "Licensed under the {Apache Software License, Version 1.1}.", "Licensed under the {Apache License, Version 1.1}.",
        _BSD + "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the {Apache Software Foundation}. "
        "Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear. The names Apache and Apache Software Foundation must not be used to "
        "endorse or promote products derived from this software without prior written permission. Products derived from this software {may not be called Apache}, nor may Apache appear in their name, without "
        "prior written permission of the Apache Software Foundation.",
    ],
    "Apache-1.0": ["Licensed under the {Apache License, Version 1.0}.", "Licensed under the {Apache Software License, Version 1.0}."],
    "ECL-2.0": ["Licensed under the {Educational Community License, Version 2.0}.", "Licensed under the {Educational Community License, Version 2.0} " + _MAY_NOT],
    "MIT": ["Released under the {MIT License}.", "Licensed under the {MIT License}.", _MIT_GRANT + _MIT_NOTICE.replace("this permission notice shall be included", "{this permission notice shall be included}") + _MIT_END],
    "MIT-0": [_MIT_GRANT.replace(", subject to the following conditions: ", ". ") + _MIT_END],
    "ISC": ["Licensed under the {ISC License}.", _ISC_GRANT + ", " + _ISC_NOTICE, _ISC_GRANT + ", " + _ISC_NOTICE + _ISC_END],
    "0BSD": [_ISC_GRANT.replace("fee is hereby granted", "{fee is hereby granted. THE SOFTWARE IS PROVIDED}").removesuffix("THE SOFTWARE IS PROVIDED") + _ISC_END.removeprefix("THE SOFTWARE IS PROVIDED")],
    "BSD-2-Clause": [_BSD + _BSD_END, "Licensed under the {BSD 2-Clause License}."],
    "BSD-3-Clause": [_BSD + _BSD_NAMES + _BSD_END, "Licensed under the {BSD 3-Clause License}."],
    "BSD-4-Clause": [_BSD + _BSD_ADVERTISING + _BSD_NAMES + _BSD_END, "Licensed under the {BSD 4-Clause License}."],
    "GPL-1.0": _gnu("GNU General Public License", "1"),
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "LGPL-2.0": _gnu("GNU Library General Public License", "2", "library"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "library"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the {Mozilla Public License, version 2.0}.",
    ],
    **{f"MPL-{v}": [
        f"The contents of this file are subject to the {{Mozilla Public License Version {v}}} " + _MAY_NOT, f"Licensed under the {{Mozilla Public License, version {v}}}.",
    ] for v in ("1.0", "1.1")},
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0} which is available at",
        "This program and the accompanying materials are made available under the terms of the {Eclipse Public License v. 2.0} which is available at", "Licensed under the {Eclipse Public License, version 2.0}.",
    ],
    "EPL-1.0": [
        "This program and the accompanying materials are made available under the terms of the {Eclipse Public License v1.0} which accompanies this distribution, and is available at",
        "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 1.0} which accompanies this distribution, and is available at",
        "Licensed under the {Eclipse Public License, version 1.0}.",
    ],
    **{f"EUPL-{v}": [
        f"Licensed under the {{EUPL, Version {v}}} or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
        f"Licensed under the {{EUPL, Version {v}}}.", f"Licensed under the {{European Union Public Licence, version {v}}}.",
    ] for v in ("1.0", "1.1", "1.2")},
    **{f"Artistic-{v}": [f"Licensed under the {{Artistic License {v}}}.", f"This program is free software; you can redistribute it and/or modify it under the terms of the {{Artistic License {v}}}."] for v in ("1.0", "2.0")},
    "BSL-1.0": [
        "Distributed under the {Boost Software License, Version 1.0}.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "Licensed under {CC0 1.0}.",
    ],
    **{f"CC-{short}-{v}": _creative(kind, short, v) for short, kind in _CC.items() for v in _CC_VERSIONS},
    # What several licenses of a family begin with.
    _UNKNOWN + "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that"],
    _UNKNOWN + "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    _UNKNOWN + "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
}
#: Phrases that show another license of the family.
BARRED = {
    "MIT": ["shall be used for good", "shall not be used in advertising"], "MIT-0": ["permission notice shall be included", "shall be used for good", "shall not be used in advertising"],
    "ISC": ["the name of the author may not be used"], "0BSD": ["provided that the above copyright notice"],
    "BSD-2-Clause": ["advertising materials", "to endorse or promote products", "patent rights", "end user documentation"],
    "BSD-3-Clause": ["advertising materials", "patent rights", "end user documentation"], "BSD-4-Clause": ["patent rights"],
}


def family(name: str) -> str:
    """The license's name without version and number of clauses."""
    return re.sub(r"-(\d+(\.\d+)*)(-Clause)?$", "", name)


_WORD = re.compile(r"[^\W_]+")
_MULTIPLY = [np.uint64(xxhash.xxh3_64_intdigest(f"minhash {i}") | 1) for i in range(HASHES)]


class _Words(WordHashes):
    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def shingles(text: str) -> np.ndarray:
    """Hash of each pair of neighbouring words, in order; of the word itself if there is but one."""
    w = _WORD.findall(text.lower())
    h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    return _mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES rows: every shingle under every hash function (32 bits)."""
    out = np.empty((HASHES, len(s)), np.uint32)
    for i, m in enumerate(_MULTIPLY):
        out[i] = (s * m) >> np.uint64(32)
    return out


#: Shingles of a phrase in order, and those that may not follow.
Phrase = tuple[np.ndarray, np.ndarray]


@dataclass
class Group:
    """Templates of about the same length, the windows' block, the rows of a band, the templates' band keys, and what decides or bars each."""

    block: int
    rows: int
    keys: dict[int, list[int]]
    sets: list[np.ndarray]
    members: list[frozenset[int]]
    names: list[str]
    decide: list[list[Phrase]]
    bar: list[list[Phrase]]

    def decided(self, i: int, window: np.ndarray) -> bool:
        """Whether what decides template i stands in the window, and nothing that its license bars."""
        if self.names[i].startswith(_UNKNOWN) or any(_stands(window, *x) for x in self.bar[i]):
            return False
        return all(_stands(window, *x) for x in self.decide[i])


def _band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """bands x windows: one key for each band of each column's MinHash values."""
    bands = len(m) // rows
    m = m[: bands * rows].reshape(bands, rows, -1).astype(np.uint64)
    k = np.full((bands, m.shape[2]), 17, np.uint64)
    for r in range(rows):
        k = k * np.uint64(0x9E3779B97F4A7C15) + m[:, r]
    return _mixed(k + np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))


def band_rows(template: int, window: int, contained: float, hashes: int = HASHES, least: float = PROBABILITY) -> int:
    """Most rows of a band so that a window with the share ``contained`` of a template is found with probability ``least``."""
    both = contained * template
    j = both / (window + template - both)
    able = [r for r in (1, 2, 3, 4) if 1 - (1 - j**r) ** (hashes // r) >= least]
    if not able:
        raise ValueError(f"no bands of {hashes} hashes find a template of {template} shingles with probability {least}")
    return max(able)


def _phrase(text: str) -> Phrase:
    """A phrase of two words or more; after a digit at its end no further one may follow: that is another version."""
    last = _WORD.findall(text.lower())[-1]
    return shingles(text), np.array([shingles(f"{last} {d}")[0] for d in range(1, 10)] if last[-1].isdigit() else [], np.uint64)


def _stands(window: np.ndarray, phrase: np.ndarray, barred: np.ndarray) -> bool:
    """Whether the phrase is in the window word for word, once at least without a ``barred`` shingle behind it."""
    n = len(phrase)
    at = np.flatnonzero(window[: max(0, len(window) - n + 1)] == phrase[0])
    for j in range(1, n):
        at = at[window[at + j] == phrase[j]]
    after = at[at + n < len(window)]
    return len(after) < len(at) or bool((~np.isin(window[after + n], barred)).any())


def grouped(templates: dict[str, list[str]], contained: float = CONTAINED) -> list[Group]:
    own = []
    for name, ts in templates.items():
        for t in ts:
            s = shingles(re.sub("[{}]", "", t))
            if len(s):
                own.append((name, np.unique(s), len(s), [_phrase(x) for x in re.findall(r"\{([^}]*)\}", t)], [_phrase(x) for x in BARRED.get(name, [])]))
    own.sort(key=lambda x: x[2])
    groups, at = [], 0
    while at < len(own):
        end = at
        while end < len(own) and own[end][2] <= max(own[at][2] + 2, 1.5 * own[at][2]):
            end += 1
        part = own[at:end]
        block = -(-part[-1][2] // 2)
        rows = min(band_rows(len(s), 3 * block, contained) for _, s, *_ in part)
        keys: dict[int, list[int]] = {}
        for i, (_, s, *_) in enumerate(part):
            for k in _band_keys(minhashes(s).min(1)[:, None], rows).ravel().tolist():
                keys.setdefault(k, []).append(i)
        groups.append(Group(block, rows, keys, [x[1] for x in part], [frozenset(x[1].tolist()) for x in part], [x[0] for x in part], [x[3] for x in part], [x[4] for x in part]))
        at = end
    return groups


def _windows(low: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of windows of three blocks from those of blocks; ``first``: the block that ends each block's text."""
    win, at = low.copy(), np.arange(low.shape[1])
    for d in (1, 2):
        own = np.flatnonzero(at + d < first)
        win[:, own] = np.minimum(win[:, own], low[:, own + d])
    return win


Match = tuple[int, str, int, int, float, int, bool]


def _matches(s: np.ndarray, bounds: np.ndarray, groups: list[Group], contained: float) -> list[Match]:
    """(text, license, first word, word after the last, containment, shingles matched, decided) of verified windows.

    ``s``: shingles of many texts, one after another; text i has those from bounds[i] to bounds[i + 1].
    """
    out: list[Match] = []
    if not len(s):
        return out
    # Shingles that may be a template's, counted up: most windows with a hash in common hold too few of them.
    marks = np.zeros(1 << MARK_BITS, bool)
    for g in groups:
        for x in g.sets:
            marks[x >> np.uint64(64 - MARK_BITS)] = True
    marked = np.concatenate([[0], np.cumsum(marks[s >> np.uint64(64 - MARK_BITS)])])
    m, sizes = minhashes(s), np.diff(bounds)
    own = np.flatnonzero(sizes)
    for g in groups:
        blocks = -(-sizes[own] // g.block)
        ends = np.cumsum(blocks)
        begins = ends - blocks
        text = np.repeat(np.arange(len(own)), blocks)
        inside = (np.arange(int(ends[-1])) - begins[text]) * g.block
        low = np.minimum.reduceat(m, bounds[own][text] + inside, axis=1)
        begin = bounds[own][text] + inside
        held = marked[np.minimum(begin + 3 * g.block, bounds[own + 1][text])] - marked[begin]
        able = np.flatnonzero(held >= contained * min(len(x) for x in g.sets))
        if not len(able):
            continue
        keys = _band_keys(_windows(low, ends[text])[:, able], g.rows)
        known = np.sort(np.fromiter(g.keys, np.uint64, len(g.keys)))
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        hits = {(int(able[w]), i) for b, w in np.argwhere(known[at] == keys) for i in g.keys[int(keys[b, w])] if held[able[w]] >= contained * len(g.sets[i])}
        at_window, held_now = -1, frozenset()
        for w, i in sorted(hits):
            t = int(own[text[w]])
            begin = int(inside[w])
            end = min(begin + 3 * g.block, int(sizes[t]))
            window = s[bounds[t] + begin : bounds[t] + end]
            if w != at_window:
                at_window, held_now = w, frozenset(window.tolist())
            same = len(g.members[i] & held_now)
            if same >= contained * len(g.sets[i]):
                sure = g.decided(i, window)
                name = g.names[i] if sure else _UNKNOWN + family(g.names[i].removeprefix(_UNKNOWN))
                out.append((t, name, begin, end, same / len(g.sets[i]), same, sure))
    return out


def _decided(matches: list[Match]) -> list[tuple[str, float, int, bool]]:
    """(license, containment, first word, best) of one text; ``best``: no other license's overlapping match surpasses it."""
    best: dict[str, tuple[bool, float, int]] = {}
    order = sorted(matches, key=lambda x: x[2])
    longest = max(x[3] - x[2] for x in order)
    for j, (_, name, a, b, c, n, sure) in enumerate(order):
        beaten = False
        for step in (-1, 1):
            k = j + step
            while not beaten and 0 <= k < len(order) and (order[k][2] < b if step > 0 else order[k][2] > a - longest):
                _, other, a2, b2, c2, n2, sure2 = order[k]
                beaten = other != name and a2 < b and a < b2 and (sure2, c2, n2) > (sure, c, n)
                k += step
        best[name] = max(best.get(name, (False, 0.0, 0)), (not beaten, c, -a))
    return sorted((name, c, -at, first) for name, (first, c, at) in best.items())


def found(texts: list[str | None], groups: list[Group], contained: float = CONTAINED, at_once: int = AT_ONCE) -> Iterator[tuple[int, str, float, int, bool]]:
    """(text, license, containment, first word of the window, best) of each license in each text."""
    held: list[np.ndarray] = []
    first = 0
    for i, t in enumerate([*texts, None]):
        last = i == len(texts)
        s = shingles(t) if t else np.empty(0, np.uint64)
        if held and (last or sum(map(len, held)) + len(s) > at_once):
            bounds = np.cumsum([0, *map(len, held)])
            by_text: dict[int, list[Match]] = {}
            for x in _matches(np.concatenate(held), bounds, groups, contained):
                by_text.setdefault(x[0], []).append(x)
            for j, own in sorted(by_text.items()):
                yield from ((first + j, *x) for x in _decided(own))
            held, first = [], i
        if last:
            return
        if len(s) > at_once:
            # A long text by itself, group by group, in stretches that begin at a block and overlap by two.
            own = []
            for g in groups:
                stretch = g.block * max(1, at_once // g.block)
                for a in range(0, len(s), stretch):
                    part = s[a : a + stretch + 2 * g.block]
                    # Windows that begin in the overlap belong to the next stretch.
                    own += [(0, n, b + a, e + a, c, k, d) for _, n, b, e, c, k, d in _matches(part, np.array([0, len(part)]), [g], contained) if b < stretch]
            if own:
                yield from ((i, *x) for x in _decided(own))
            held, first = [], i + 1
        else:
            held.append(s)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, first_word, best: a row for each license that a text holds."""
    groups = grouped(templates or TEMPLATES, contained)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, CHARS):
                ids = part["doc_id"].astype("Int64").tolist()
                rows = [(ids[i], *x) for i, *x in found(part["text"].tolist(), groups, contained)]
                yield pd.DataFrame(rows, columns=["doc_id", "license", "containment", "first_word", "best"]).astype({"doc_id": "Int64"})
            trim()

    return kept_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, license string, containment double, first_word long, best boolean")
