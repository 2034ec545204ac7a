"""Operator 4: license notices by conditional compression of candidate blocks, confirmed by the exact wording."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_2 = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
_BSD_3 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_4 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_5 = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str, subject: str = "program") -> str:
    return f"""This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General
    Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option)
    any later version. This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
    the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for
    more details. You should have received a copy of the GNU {kind} General Public License along with this {subject}. If not,
    see <https://www.gnu.org/licenses/>."""


def _gpl(version: str) -> str:
    return f"This work is licensed under the GNU General Public License, version {version}."


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {name}" for name in names)


def _creative(kind: str, short: str, version: str, port: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {short} {version}.",
        f"This work is licensed under a Creative Commons {kind} {version} {port} License.",
        *_spdx(f"CC-{short}-{version}"),
    )


#: The kinds, versions and ports of the Creative Commons licenses.
_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_PORTS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Words that name a license, its family or a clause that tells two of them apart.
NAMES = frozenset(
    """affero advertising agpl apache artistic attribution boost bsd cc cc0 eclipse endorse epl gnu gpl gplv2 gplv3 isc lesser lgpl mit
    mozilla mpl nc nd noderivatives noderivs noncommercial sa sharealike unlicense zlib""".split()
)


#: Notices as their licenses word them, the short one first, then headers and full texts.
TEMPLATES: dict[str, str | Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ),
    "Apache-1.1": ("Licensed under the Apache Software License, Version 1.1.", *_spdx("Apache-1.1")),
    "GPL-1.0": (_gpl("1"), _gnu("", "1"), *_spdx("GPL-1.0-only", "GPL-1.0-or-later")),
    "GPL-2.0": (_gpl("2"), _gnu("", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_spdx("GPL-2.0-only", "GPL-2.0-or-later")),
    "GPL-3.0": (_gpl("3"), _gnu("", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_spdx("GPL-3.0-only", "GPL-3.0-or-later")),
    "LGPL-2.0": (_gnu("Library", "2", "library"), *_spdx("LGPL-2.0-only", "LGPL-2.0-or-later")),
    "LGPL-2.1": (_gnu("Lesser", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_spdx("LGPL-2.1-only", "LGPL-2.1-or-later")),
    "LGPL-3.0": (_gnu("Lesser", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_spdx("LGPL-3.0-only", "LGPL-3.0-or-later")),
    "AGPL-3.0": (_gnu("Affero", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_spdx("AGPL-3.0-only", "AGPL-3.0-or-later")),
    **{f"CC-{short}-{version}": _creative(kind, short, version, port) for version, port in _PORTS.items() for short, kind in _KINDS.items()},
    "CC0-1.0": (
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        *_spdx("CC0-1.0"),
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means.""",
        *_spdx("Unlicense"),
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
        *_spdx("Zlib"),
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", *_spdx("BSL-1.0")),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", *_spdx("EPL-1.0")),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", *_spdx("EPL-2.0")),
    "Artistic-1.0": ("Licensed under the terms of the Artistic License 1.0.", *_spdx("Artistic-1.0")),
    "Artistic-2.0": ("Licensed under the terms of the Artistic License 2.0.", *_spdx("Artistic-2.0")),
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": (f"{_BSD_1} 1. {_BSD_2} 2. {_BSD_3} {_BSD_5}", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (f"{_BSD_1} 1. {_BSD_2} 2. {_BSD_3} 3. {_BSD_4} {_BSD_5}", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Words compared with a template, or compressed as one block, at a time; longer stretches are taken in overlapping pieces.
PIECE = 8192


def naming(words: Sequence[bytes]) -> list[str]:
    """The words that name a license, sorted: those with a part in NAMES, version numbers, the word after GNU, BY after CC.

    A version number has a point, or stands after the word version or a name; 3 and 3.0 are the same."""
    found, before = [], ""
    for word in words:
        core = re.sub(r"^\W+|\W+$", "", word.decode("utf-8", "replace").lower())
        number = re.fullmatch(r"v?(\d+(?:\.\d+)*)", core)
        if number:
            if "." in core or core[0] == "v" or before in ("version", "v") or before in NAMES:
                found.append(re.sub(r"(\.0)+$", "", number[1]))
        elif not NAMES.isdisjoint(core.split("-")) or before == "gnu" or (core, before) == ("by", "cc"):
            found.append(core)
        before = core or before
    return sorted(found)


def packed(text: bytes, dictionary: zstandard.ZstdCompressionDict | None = None) -> int:
    """Bytes of the text when compressed, without frame magic, size or checksum, given the dictionary."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        19, source_size=len(text), dict_size=len(dictionary) if dictionary else 0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress(text))


def places(ids: np.ndarray, template: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(differences, start, end) of the spans of ids that differ from the template by at most so many missing and added words.

    The alignment with the fewest differences that ends at each word is found by dynamic programming, one row per word of
    the template; of equals it starts last. Of overlapping spans the one with the fewest differences stays, then the longest.
    """
    n, unit = len(ids), len(ids) + 1
    at = np.arange(n + 1, dtype=np.int64)
    cost = n - at  # differences * unit + (n - start)
    for word in template:
        new = cost + unit
        same = np.flatnonzero(ids == word) + 1
        new[same] = np.minimum(new[same], cost[same - 1])
        cost = np.minimum.accumulate(new - at * unit) + at * unit
    found = [(int(cost[e]) // unit, n - int(cost[e]) % unit, int(e)) for e in np.flatnonzero(cost // unit <= most)]
    return _apart(sorted((x for x in found if x[2] > x[1]), key=lambda x: (x[0], x[1] - x[2], x[1])), n)


def _apart(found: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    used, out = np.zeros(n, bool), []
    for x in found:
        if not used[x[1] : x[2]].any():
            used[x[1] : x[2]] = True
            out.append(x)
    return out


class Scanner:
    """Finds the notices in one text after the other. templates: license to the wording of its notice, or to several."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], least: float, changed: float):
        known = [(name, t.encode().split()) for name, of in sorted(templates.items()) for t in ([of] if isinstance(of, str) else of)]
        known = [(name, w) for name, w in known if w]
        self.names = [name for name, _ in known]
        self.ids: dict[bytes, int] = {}
        self.words = [np.array([self.ids.setdefault(x, len(self.ids)) for x in w]) for _, w in known]
        self.dictionaries = [zstandard.ZstdCompressionDict(b" ".join(w), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, w in known]
        self.most = [int(changed * len(w) + 1e-9) for w in self.words]
        # One more column than words, for those that no template has.
        self.held = np.array([np.bincount(w, minlength=len(self.ids) + 1) for w in self.words]).reshape(len(known), len(self.ids) + 1)
        self.need = np.array([max(1, len(w) - m) for w, m in zip(self.words, self.most, strict=True)])
        self.naming = [naming(w) for _, w in known]
        texts = [b" ".join(w) for _, w in known]
        # What a template saves on its own wording: the measure for what it saves on a block.
        self.own = [max(1, packed(x) - packed(x, d)) for x, d in zip(texts, self.dictionaries, strict=True)]
        self.least, self.known = least, {}

    def saved(self, block: bytes, templates: Sequence[int]) -> list[int]:
        """Bytes that each of the templates saves as dictionary when the block is compressed."""
        key = (block, tuple(templates))
        if key not in self.known:
            if len(self.known) > 1_000:
                self.known.clear()
            alone = packed(block)
            self.known[key] = [alone - packed(block, self.dictionaries[t]) for t in templates]
        return self.known[key]

    def stretches(self, ids: np.ndarray, t: int) -> Iterator[tuple[int, int]]:
        """Stretches of words, PIECE long at most, that hold every span close enough to the template.

        Such a span has at most len + most words, of which len - most are the template's."""
        wide, n = len(self.words[t]) + self.most[t], len(ids)
        sums = np.r_[0, np.cumsum(self.held[t][ids] > 0)]
        starts = np.arange(max(1, n - wide + 1))
        starts = starts[sums[np.minimum(starts + wide, n)] - sums[starts] >= self.need[t]]
        step = max(PIECE, 2 * wide) - wide
        if len(starts):
            cuts = np.flatnonzero(np.diff(starts) > wide) + 1
            for part in np.split(starts, cuts):
                for first in range(int(part[0]), int(part[-1]) + 1, step):
                    yield first, min(first + step, int(part[-1]) + 1) - 1 + wide

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[int, int, dict[int, list[tuple[int, int]]]]]:
        """(first, last, template to its stretches): overlapping stretches are one block of at most PIECE words.

        A stretch is in one block, so what is close enough to a template lies whole in a block that names the template."""
        counts = np.bincount(ids, minlength=len(self.ids) + 1)
        able = np.flatnonzero(np.minimum(counts, self.held).sum(axis=1) >= self.need) if len(self.names) else ()
        start = end = 0
        inside: dict[int, list[tuple[int, int]]] = {}
        for first, last, t in sorted((first, min(last, len(ids)), int(t)) for t in able for first, last in self.stretches(ids, t)):
            if inside and (first >= end or max(last, end) - start > PIECE):
                yield start, end, inside
                inside = {}
            if not inside:
                start = end = first
            end = max(end, last)
            inside.setdefault(t, []).append((first, last))
        if inside:
            yield start, end, inside

    def notices(self, text: str | None) -> list[tuple]:
        """(line, word, n_words, license, reduction, missing, added) of the notices in the text, in its order."""
        data = (text or "").encode("utf-8", "surrogatepass")
        split = data.split()
        ids = np.fromiter(map(self.ids.get, split, repeat(len(self.ids))), np.int64, len(split))
        ranked = []
        for first, last, inside in self.blocks(ids):
            for t, saved in zip(inside, self.saved(b" ".join(split[first:last]), list(inside)), strict=True):
                if saved >= self.least * self.own[t]:
                    ranked.append((-saved, -len(self.words[t]), self.names[t], t, first, inside[t]))
        kept: list[tuple] = []
        over: dict[int, list[tuple]] = defaultdict(list)
        for saved, _, name, t, _, own in sorted(ranked):
            for x in self.confirmed(ids, split, t, own):
                near = {y for k in range(x[0], x[1]) for y in over[k]}
                if not any(2 * (min(x[1], y[1]) - max(x[0], y[0])) > min(x[1] - x[0], y[1] - y[0]) for y in near):
                    kept.append((*x[:2], name, round(-saved / self.own[t], 6), *x[2:]))
                    for k in range(x[0], x[1]):
                        over[k].append(x)
        offsets = _offsets(data, split) if kept else []
        return [(data.count(b"\n", 0, offsets[s]), s, e - s, name, saved, missing, added) for s, e, name, saved, missing, added in sorted(kept)]

    def confirmed(self, ids: np.ndarray, split: list[bytes], t: int, own: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, missing, added) of the spans in the stretches whose wording is the template's, but for words that name nothing."""
        size, here = len(self.words[t]), set()
        for first, last in own:
            here |= {(d, first + s, first + e) for d, s, e in places(ids[first:last], self.words[t], self.most[t])}
        for d, s, e in _apart(sorted(here, key=lambda x: (x[0], x[1] - x[2], x[1])), len(ids)):
            added = (d + e - s - size) // 2
            # A naming word at the edge may be written with another mark behind it; it then stands beside the span.
            named = any(naming(split[max(0, s - i) : e + j]) == self.naming[t] for i in (0, 1) for j in (0, 1))
            if d - added < size and named:
                yield s, e, d - added, added


def _offsets(data: bytes, split: list[bytes]) -> list[int]:
    out, at = [], 0
    for w in split:
        at = data.index(w, at)
        out.append(at)
        at += len(w)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, least: float = 0.3, changed: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, line, word, n_words, license, reduction, missing, added, exact): the license notices of whole texts.

    Windows over the words of a text, as long as each template with its allowed changes, are candidates if they hold enough
    of its words; line feeds count as blanks. Overlapping candidates are one block. Each block is compressed alone and with
    every template it is a candidate for as a raw dictionary; reduction is what the template saves, as a share of what it
    saves on its own wording, and must be at least `least`, so that prose around a notice doesn't matter. Templates are
    ranked by the bytes they save. In this order the wording confirms them: every span counts that differs from the template
    by at most `changed` of its words (missing ones, and those added between the first and the last common word) and by no
    word that names a license, its version or a clause (see `naming`; the word on either side of the span may be such a word
    with another mark): another version is another license, or none. A span
    that shares more than half of the shorter one with a span confirmed before is left out; all others are reported.
    line (from 0) holds the span's first word, word is that word's place in the text. exact: no difference.

    Null and blank texts have no candidates. Repeated rows are reported each. An empty table gives no rows. Other columns
    are not returned.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = rows.select(
        "doc_id", *(F.lit(0).alias(c) for c in ("line", "word", "n_words")), F.lit("").alias("license"), F.lit(0.0).alias("reduction"),
        *(F.lit(0).alias(c) for c in ("missing", "added")), F.lit(True).alias("exact"),
    ).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, changed)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            own, out = [], []
            for i, text in enumerate(batch.column(1)):
                for notice in scanner.notices(text.as_py()):
                    own.append(i)
                    out.append((*notice, notice[-2] + notice[-1] == 0))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *arrays], schema.names)

    return rows.mapInArrow(judged, schema)
