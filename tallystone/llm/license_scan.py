"""Licence scan: Dice coefficient over word bigrams against licence templates.

A unit of a text (each line, each paragraph, the whole text) is compared to every template as a set of bigrams of
normalised words (lower case, letters and digits). Two sets of sizes a and b have a Dice coefficient of at least t
only if b lies between a t / (2 - t) and a (2 - t) / t: templates are kept sorted by size, and a unit meets
those between the bounds alone. Before that, the number of a unit's bigrams that any template has bounds its coefficient too, which
leaves few units to compare.

Every run of words is a unit as well, so that a notice inside other words is found. A run that starts or ends with a
bigram that the template lacks gets better without it, and one whose first bigram comes again is the same set without it; so the runs
between bigrams of the template, up to the next copy of the first one and within the size bounds, hold the best of each
place. Only texts with t / (2 - t) of a template's distinct bigrams are searched for it. Where runs of several licences
overlap, the best one is taken first and the others are left what lies outside it.

Defined cases: null and empty texts and units of fewer than two words match nothing; lines of white space end a
paragraph; ties between templates go to the first name; repeated rows get equal results; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallystone.llm.words import Texts, map_texts, owners, plain_words, windows

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

# Wording of licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# The whole licences, after their parts above.
TEMPLATES["BSD-3-Clause"].append(
    TEMPLATES["BSD-3-Clause"][1] + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES["ISC"].append(
    TEMPLATES["ISC"][0] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
    "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
TEMPLATES["MIT"].append(f"{TEMPLATES['MIT'][1]} {_AS_IS}")
TEMPLATES["Unlicense"].append(
    TEMPLATES["Unlicense"][0] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
    "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
    "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We "
    "make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
    "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <http://unlicense.org/>")
_FILTER_BITS = 18
_SPACE = np.frombuffer(b" \t\n\v\f\r", np.uint8)


class TemplateIndex:
    """Bigram sets of the templates, sorted by size."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        entries = []
        for name in sorted(templates):
            for text in templates[name]:
                words, starts, ends, bounds = plain_words(Texts(pa.array([text])))
                _, bigram = windows(words.hashes(starts, ends), bounds, 2)
                entries.append((len(np.unique(bigram)), name, np.unique(bigram)))
        entries.sort(key=lambda e: (e[0], e[1]))
        self.sizes = np.array([e[0] for e in entries])
        self.names = [e[1] for e in entries]
        self.sets = [e[2] for e in entries]
        self.known = np.unique(np.concatenate(self.sets)) if entries else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # templates of each known bigram, one after the other, and the least number of its bigrams in a run that is near enough
        template = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        place = np.searchsorted(self.known, np.concatenate(self.sets)) if entries else template
        self.template_of = template[np.argsort(place, kind="stable")]
        self.n_templates = np.bincount(place, minlength=len(self.known))
        self.need = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)

    def candidates(self, size: int) -> range:
        """Templates whose size lets a unit of ``size`` bigrams reach the threshold."""
        t = self.threshold
        return range(int(np.searchsorted(self.sizes, size * t / (2 - t) - 1e-9)), int(np.searchsorted(self.sizes, size * (2 - t) / t + 1e-9, "right")))

    def best(self, bigrams: np.ndarray) -> tuple[float, str] | None:
        own = np.unique(bigrams)
        found = [(2 * np.isin(own, self.sets[i]).sum() / (len(own) + self.sizes[i]), self.names[i]) for i in self.candidates(len(own))]
        found = [f for f in found if f[0] >= self.threshold - 1e-9]
        return min(found, key=lambda f: (-f[0], f[1])) if found else None


    def searched(self, text_of: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
        """Rows (text, template) for which the text has as many of the template's distinct bigrams as a run needs."""
        place = np.minimum(np.searchsorted(self.known, bigrams), max(len(self.known) - 1, 0))
        real = self.known[place] == bigrams if len(self.known) else np.zeros(len(bigrams), bool)
        pairs = np.unique(text_of[real] * len(self.known) + place[real])
        text, place = np.divmod(pairs, max(len(self.known), 1))
        n = self.n_templates[place]
        first = (np.cumsum(self.n_templates) - self.n_templates)[place]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        template = self.template_of[np.repeat(first, n) + within]
        both, seen = np.unique(np.repeat(text, n) * len(self.sets) + template, return_counts=True)
        text, template = np.divmod(both, max(len(self.sets), 1))
        enough = seen >= self.need[template]
        return np.stack([text[enough], template[enough]], 1)

    def runs(self, bigrams: np.ndarray, templates: np.ndarray) -> dict[str, float]:
        """Best coefficient by licence of the runs of one text, taken best first where licences overlap."""
        order = np.argsort(bigrams, kind="stable")
        again = np.flatnonzero(bigrams[order[1:]] == bigrams[order[:-1]])
        before, after = np.full(len(bigrams), -1), np.full(len(bigrams), len(bigrams))
        before[order[again + 1]], after[order[again]] = order[again], order[again + 1]
        found: list[tuple[float, str, int, int]] = []
        for t in templates:
            size = int(self.sizes[t])
            most = size * (2 - self.threshold) / self.threshold + 1e-9
            member = self.sets[t][np.minimum(np.searchsorted(self.sets[t], bigrams), size - 1)] == bigrams
            for a in np.flatnonzero(member):
                length = int(most) + 2
                while True:
                    b = min(int(after[a]), a + length)
                    new = before[a:b] < a
                    total = np.cumsum(new)
                    if total[-1] > most or b == after[a]:
                        break
                    length *= 2
                own = new & member[a:b]
                dice = 2 * np.cumsum(own) / (total + size)
                for e in np.flatnonzero(own & (dice >= self.threshold - 1e-9)):
                    found.append((float(dice[e]), self.names[t], int(a), int(a + e + 1)))
        best: dict[str, float] = {}
        if len({f[1] for f in found}) > 1:
            owner = np.full(len(bigrams), -1)
            number = {name: i for i, name in enumerate(sorted(set(self.names)))}
            left = []
            for f in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
                held = owner[f[2] : f[3]]
                if ((held == -1) | (held == number[f[1]])).all():
                    held[:] = number[f[1]]
                    left.append(f)
            found = left
        for dice, name, _, _ in found:
            best[name] = max(best.get(name, 0), dice)
        return best


def _units(texts: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, start and end byte of the lines, the paragraphs and the whole texts."""
    starts, ends, bounds = texts.spans(texts.data != 0x0A)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    filled = np.concatenate([[0], np.cumsum(~np.isin(texts.data, _SPACE))])
    some = filled[ends] > filled[starts]
    # a line of white space is an empty one
    lines_before = np.concatenate([[0], np.cumsum(texts.data == 0x0A)])
    text_of, starts, ends = text_of[some], starts[some], ends[some]
    out = [(text_of, starts, ends)]
    if len(starts):
        new = np.ones(len(starts), bool)
        new[1:] = (text_of[1:] != text_of[:-1]) | (lines_before[starts[1:]] - lines_before[ends[:-1]] > 1)
        first = np.flatnonzero(new)
        out.append((text_of[first], starts[first], ends[np.append(first[1:], len(starts)) - 1]))
    out.append((np.arange(len(texts)), texts.bounds[:-1], texts.bounds[1:]))
    return out


def scan_licenses(docs: DataFrame, text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with ``_licenses``: an array of (``license``, ``dice``: the best of any unit or run), sorted by name."""
    index = TemplateIndex(TEMPLATES if templates is None else templates, threshold)
    docs = docs.drop("_licenses")
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", licenses array<struct<license:string,dice:double>>"

    def rows(batch: pa.RecordBatch, texts: Texts) -> dict:
        found: list[dict[str, float]] = [{} for _ in range(len(texts))]
        lowered, starts, ends, bounds = plain_words(texts)
        at, bigram = windows(lowered.hashes(starts, ends), bounds, 2)
        known = index.filter[(bigram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        hits = np.concatenate([[0], np.cumsum(known)])
        begin, finish = starts[at], ends[at + 1] if len(at) else at
        for text_of, low, high in _units(lowered):
            a = np.searchsorted(begin, low)
            b = np.maximum(np.searchsorted(finish, high, "right"), a)
            # shared <= hits, and a template has at least t / (2 - t) of the unit's distinct bigrams
            for u in np.flatnonzero((b > a) & (hits[b] - hits[a] > 0)):
                if (hits[b[u]] - hits[a[u]]) * 2 < threshold * min(index.sizes):
                    continue
                own = np.unique(bigram[a[u] : b[u]])
                shared = np.isin(own, index.known).sum()
                if 2 * shared < threshold * len(own):  # even a template of all shared bigrams is too far
                    continue
                got = index.best(own)
                if got and got[0] > found[text_of[u]].get(got[1], 0):
                    found[text_of[u]][got[1]] = float(got[0])
        own_text = owners(bounds)[at]
        near = index.searched(own_text[known], bigram[known])
        cuts = np.searchsorted(own_text, np.arange(len(texts) + 1))
        for i in np.unique(near[:, 0]):
            for name, dice in index.runs(bigram[cuts[i] : cuts[i + 1]], near[near[:, 0] == i, 1]).items():
                found[i][name] = max(found[i].get(name, 0), dice)
        return {**{f"c{i}": batch.column(i) for i in range(len(names))},
                "licenses": [[{"license": k, "dice": v} for k, v in sorted(f.items())] for f in found]}

    return map_texts(renamed, f"c{names.index(text)}", schema, rows).toDF(*names, "_licenses")
