"""License notices: the winner of the compression ranking, confirmed by its wording, against a plain version of the same rule."""

import numpy as np
import pytest

from twosight.llm import licences

WORDS = "the of use any software MIT GPL version 2 3.0 license a b c".split()


def indels(a: list, b: list) -> int:
    """Fewest words to take out of a and to put in to make b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def apart(spans):
    out = []
    for x in spans:
        if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
            out.append(x)
    return out


def plain(text: str, templates: dict[str, str], least: float, changed: float) -> list[tuple]:
    """(word, n_words, license, missing, added): every span of the text is aligned, every block compressed with every candidate."""
    words, n = text.split(), len(text.split())
    cover, stretches = np.zeros((len(templates), n), bool), []
    for i, t in enumerate(templates.values()):
        t = t.split()
        most = int(changed * len(t) + 1e-9)
        wide = len(t) + most
        for s in range(max(1, n - wide + 1)):
            if sum(w in t for w in words[s : s + wide]) >= max(1, len(t) - most) and sum(min(words.count(w), t.count(w)) for w in set(t)) >= max(1, len(t) - most):
                cover[i, s : s + wide] = True
                stretches.append((s, min(s + wide, n)))
    blocks = []
    for s, e in sorted(stretches):
        if blocks and s < blocks[-1][1]:
            blocks[-1][1] = max(e, blocks[-1][1])
        else:
            blocks.append([s, e])
    ranked = []
    for s, e in blocks:
        block = " ".join(words[s:e]).encode()
        for i, (name, t) in enumerate(templates.items()):
            own = licences.zstandard.ZstdCompressionDict(t.encode(), dict_type=licences.zstandard.DICT_TYPE_RAWCONTENT)
            saved = licences.packed(block) - licences.packed(block, own)
            if cover[i, s:e].any() and saved >= least * max(1, licences.packed(t.encode()) - licences.packed(t.encode(), own)):
                ranked.append((-saved, -len(t.split()), name, t.split(), s, e))
    kept = []
    for _, _, name, t, first, last in sorted(ranked):
        spans = []
        for e in range(first + 1, last + 1):
            d, s = min((indels(t, words[s:e]), -s) for s in range(first, e + 1))
            if d <= int(changed * len(t) + 1e-9) and -s < e:
                spans.append((d, -s, e))
        for d, s, e in apart(sorted(spans, key=lambda x: (x[0], x[1] - x[2], x[1]))):
            added = (d + e - s - len(t)) // 2
            near = [words[s:e], words[max(0, s - 1) : e], words[s : e + 1], words[max(0, s - 1) : e + 1]]
            same = licences.naming([w.encode() for w in t]) in [licences.naming([w.encode() for w in x]) for x in near]
            if d - added < len(t) and same and not any(2 * (min(e, y[0] + y[1]) - max(s, y[0])) > min(e - s, y[1]) for y in kept):
                kept.append((s, e - s, name, d - added, added))
    return sorted(kept)


def test_plain_version():
    """The same notices as by aligning every span and compressing every block with every candidate template."""
    rng, several = np.random.default_rng(11), 0
    for _ in range(250):
        templates = {f"t{i}": " ".join(rng.choice(WORDS, rng.integers(4, 10))) for i in range(4)}
        parts = []
        for _ in range(rng.integers(0, 4)):
            own = list(rng.choice(list(templates.values())).split())
            if rng.random() < 0.5:
                own[rng.integers(len(own))] = str(rng.choice(WORDS))
            parts += [*(f"z{x}" for x in rng.integers(0, 9, rng.integers(0, 6))), *own, *rng.choice(WORDS, rng.integers(0, 3))]
        text = " ".join(parts)
        got = [(x[1], x[2], x[3], x[5], x[6]) for x in licences.Scanner(templates, 0.3, 0.25).notices(text)]
        assert got == plain(text, templates, 0.3, 0.25), (text, templates)
        several += len(got) > 1
    assert several > 20


FSF_21 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation,
Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", None),
        ("This work is licensed under the GNU General Public License, version 7.", None),
        (FSF_21, "LGPL-2.1"),
        (FSF_21.replace("2.1", "3"), "LGPL-3.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Licensed under the Apache License, Version 1.0.", None),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ],
)
def test_versions(text, license):
    """Another version, family or clause is another license, or none, however alike the wording is."""
    scanner = licences.Scanner(licences.TEMPLATES, 0.3, 0.25)
    for case in (text, f"some prose before it {text} and some prose behind", "\n".join(text.split())):
        assert [x[3] for x in scanner.notices(case)] == ([license] if license else [])


def test_clauses_side_by_side():
    """Notices of one family in one block are told apart: the two-clause text isn't the three-clause one with a clause left out."""
    three, two = licences.TEMPLATES["BSD-3-Clause"][0], licences.TEMPLATES["BSD-2-Clause"][0]
    scanner = licences.Scanner(licences.TEMPLATES, 0.3, 0.25)
    for text, want in ((f"{three} and {two}", ["BSD-3-Clause", "BSD-2-Clause"]), (f"{two} {three}", ["BSD-2-Clause", "BSD-3-Clause"])):
        assert [(x[3], x[5] + x[6]) for x in scanner.notices(text)] == [(name, 0) for name in want]


def test_long_stretches(monkeypatch):
    """A text that is one long candidate is cut into overlapping pieces and loses no notice."""
    monkeypatch.setattr(licences, "PIECE", 40)
    notice = "any person may use the software of the license"
    text = " ".join(["the of any use"] * 60 + [notice] + ["license software the"] * 60 + [notice])
    found = licences.Scanner({"own": notice}, 0.3, 0.25).notices(text)
    assert {(240, 9), (429, 9)} <= {(x[1], x[2]) for x in found if x[5] + x[6] == 0}
