"""Licence scans: word-bigram Dice coefficients between texts and licence templates.

Texts and templates are normalised alike: A-Z folded, everything but letters and digits
turned into space.  A template is compared with the whole text and with stretches that
begin and end at one of its bigrams: for each such begin the end of the best Dice
coefficient 2 * |common| / (|a| + |b|) of the two bigram sets is taken.  Size bounds come
first: a stretch with fewer than t / (2 - t) or more than (2 - t) / t times the template's
bigrams cannot reach t, so begins with too few of them ahead are skipped.  Stretches have
up to twice the upper bound in words, as words may repeat.

Licences of one family differ in a few words, so near siblings are templates too, and a
template may have ``MARKS``: phrases that tell it from its siblings, of which a match must
hold each one.  Without them a version that is no template would go by the name of another.
Where a template is a part of its siblings, ``BARRED`` has the phrases by which they go on:
neither a match nor the ``REACH`` words after it may hold one.

The templates are configuration of bounded size and travel with the tasks; full licence
texts are read from a folder of files (``templates_from``).  A text is scanned in its own
row, without a shuffle.

Defined results: null, empty and too short texts match nothing; of overlapping matches the
one with the higher coefficient stays, then the longer, then the first by name, but a
template that is a part of another one (``PART`` of its bigrams) yields to matches of the
other that share more bigrams, so that no whole licence goes by the name of a part; equal rows
are scanned alike; a very long text takes time in proportion to the places where template
words are dense.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import bound_batches
from pagemill.llm.words import Batch, RunHashes, sliced

THRESHOLD = 0.8
#: Words after a match in which barred phrases count, and bytes of templates at most.
REACH, MAX_TEMPLATES = 80, 16_000_000
#: Share of a template's bigrams that makes it a part of a longer one.
PART = 0.95

# Public licence texts and notices to compare with.
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{version} This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
_GNU_COPY = {
    2: "You should have received a copy of the GNU {kind}General Public License along with this {work}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    3: "You should have received a copy of the GNU {kind}General Public License along with this {work}. If not, see <https://www.gnu.org/licenses/>.",
}
_CC = "This work is licensed under a Creative Commons {elements} {version} {port}License."
_CC_COPY = "To view a copy of this license, visit http://creativecommons.org/licenses/{path}/{version}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
TEMPLATES = {
    "Apache-2.0 (short notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (short notice)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause (terms)": _BSD_TERMS,
    "BSD-2-Clause": f"{_BSD_TERMS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSD-4-Clause": f"{_BSD_TERMS} {_BSD_ADVERTISING} {_BSD_NAMES.replace('3.', '4.')} {_BSD_DISCLAIMER}",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0 (short notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (short notice)": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0 (short notice)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (short notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0 (notice)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC0-1.0 (notice)": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
}
#: Phrases that a match must hold, each one, in the words of the normalised text.
MARKS = {
    "Apache-2.0 (short notice)": ("apache license", "2 0"), "Apache-2.0 (notice)": ("apache license version 2 0",), "MIT (short notice)": ("mit license",),
    # where siblings have a condition that these lack
    "MIT-0": ("furnished to do so the software",), "0BSD": ("hereby granted the software",),
    "GPL-2.0 (short notice)": ("gnu general public license", "version 2"), "GPL-3.0 (short notice)": ("gnu general public license", "version 3"),
    "LGPL-3.0 (short notice)": ("gnu lesser general public license", "version 3"), "AGPL-3.0 (short notice)": ("gnu affero general public license", "version 3"),
    "MPL-2.0 (notice)": ("mozilla public license", "2 0"), "EPL-2.0 (notice)": ("eclipse public license", "2 0"), "CC0-1.0 (notice)": ("cc0",),
}

#: Phrases that neither a match nor the words right after it may hold: clauses of siblings that begin alike.
BARRED = {
    "BSD-2-Clause (terms)": ("endorse or promote products", "advertising materials"), "BSD-2-Clause": ("endorse or promote products", "advertising materials"), "BSD-3-Clause": ("advertising materials",),
    "MIT-0": ("this permission notice shall be included",), "0BSD": ("this permission notice appear in all copies",),
}


def _family() -> None:
    """GNU notices and Creative Commons lines, which differ by version and kind."""
    for spdx, kind, work in (("GPL", "", "program"), ("LGPL", "Lesser ", "library"), ("AGPL", "Affero ", "program")):
        for version, number in {"GPL": ((2, "2"), (3, "3")), "LGPL": ((2, "2.1"), (3, "3")), "AGPL": ((3, "3"),)}[spdx]:
            stop = ";" if version == 2 else ":"
            phrases = (f"gnu {kind.lower()}general public license", f"version {number.replace('.', ' ')}")
            for suffix, said in (("-or-later", f"; either version {number} of the License, or (at your option) any later version."), ("-only", f"; version {number} of the License.")):
                text = _GNU.format(work=work, stop=stop, kind=kind, version=said)
                name = f"{spdx}-{number if '.' in number else number + '.0'}{suffix}"
                own = (*phrases, "any later version") if suffix == "-or-later" else phrases
                for title, body in ((f"{name} (notice)", text), (f"{name} (notice and address)", f"{text} {_GNU_COPY[version].format(kind=kind, work=work)}")):
                    TEMPLATES[title], MARKS[title] = body, own
    for path, elements in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            name, port, digits = f"CC-{path.upper()}-{version}", "International " if version == "4.0" else "Unported ", version.replace(".", " ")
            line = _CC.format(elements=elements, version=version, port=port)
            mark = f"{elements.lower().replace('-', ' ')} {digits}"
            short = f"cc {path.replace('-', ' ')} {digits}"
            for title, body, own in ((f"{name} (notice)", line, mark), (f"{name} (notice and address)", f"{line} {_CC_COPY.format(path=path, version=version)}", mark), (f"{name} (short notice)", f"Licensed under CC {path.upper()} {version}.", short)):
                TEMPLATES[title], MARKS[title] = body, (own,)


_family()

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Template:
    def __init__(self, name: str, text: str, marks: tuple[str, ...] = (), barred: tuple[str, ...] = ()) -> None:
        batch = Batch([text.encode().translate(_FOLD)])
        self.name, self.words = name, int(batch.counts[0])
        self.bigrams = np.unique(RunHashes(batch.hashes).all(2))
        phrases = lambda said: [(int(p.counts[0]), RunHashes(p.hashes).all(int(p.counts[0]))[0]) for p in (Batch([m.encode().translate(_FOLD)]) for m in said)]
        self.marks, self.barred = phrases(marks), phrases(barred)

    def marked(self, runs: RunHashes, begin: int, end: int, last: int) -> bool:
        """Whether the words [begin, end) hold every mark, and with those after them, up to ``last``, no barred phrase."""
        def holds(n: int, phrase: np.uint64, end: int) -> bool:
            at = np.arange(begin, end - n + 1)
            return bool((runs.at(at, at + n) == phrase).any())

        return all(holds(*m, end) for m in self.marks) and not any(holds(*m, min(last, end + REACH)) for m in self.barred)


class Index:
    """Which templates hold each of their bigrams."""

    def __init__(self, templates: list[Template]) -> None:
        self.templates = templates
        bigram = np.concatenate([t.bigrams for t in templates])
        owner = np.repeat(np.arange(len(templates)), [len(t.bigrams) for t in templates])
        order = np.argsort(bigram, kind="stable")
        self.every, self.begin, self.count = np.unique(bigram[order], return_index=True, return_counts=True)
        self.owner = owner[order]
        size = np.array([len(t.bigrams) for t in templates])
        shared = [np.bincount(self.shared(t.bigrams)[1], minlength=len(templates)) for t in templates]
        self.wholes = [set(np.flatnonzero((n >= PART * size[k]) & (size > size[k])).tolist()) for k, n in enumerate(shared)]

    def shared(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``bigrams`` that templates hold, once for each template, and the templates."""
        at = np.minimum(np.searchsorted(self.every, bigrams), len(self.every) - 1)
        row = np.flatnonzero(self.every[at] == bigrams)
        n = self.count[at[row]]
        place = np.repeat(self.begin[at[row]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), self.owner[place]


def matches_in(batch: Batch, bigrams: np.ndarray, index: Index, threshold: float) -> list[list[tuple[str, float, int, int]]]:
    """(name, coefficient, begin, end) of the licences in each text, by word spans."""
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in batch.counts]
    document, runs = batch.document_of(), RunHashes(batch.hashes)
    if len(document) < 2:
        return out
    row, template = index.shared(bigrams)
    inside = document[row] == document[row + 1]
    row, template = row[inside], template[inside]
    # texts with too few of a template's bigrams go no further
    key, size = document[row] * len(index.templates) + template, np.array([len(t.bigrams) for t in index.templates])
    pair, which, n = np.unique(key, return_inverse=True, return_counts=True)
    enough = n >= threshold / (2 - threshold) * size[pair % len(size)]
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(n)
    texts: dict[int, list[int]] = {}
    for k in np.flatnonzero(enough).tolist():
        texts.setdefault(int(pair[k]) // len(size), []).append(k)
    for d, pairs in texts.items():
        a, b = int(batch.starts[d]), int(batch.ends[d])
        own = bigrams[a : b - 1]
        found = []
        for k in pairs:
            t = index.templates[int(pair[k]) % len(size)]
            n_own = len(t.bigrams)
            least = threshold / (2 - threshold) * n_own
            if len(own) < least:
                continue
            shared = np.zeros(len(own), bool)
            shared[row[order[ends[k] - n[k] : ends[k]]] - a] = True
            most = int(2 * n_own / (least / n_own))
            spans = list(_stretches(own, shared, n_own, least, most, threshold))
            if len(own) <= most:
                spans.append((0, len(own)))
            for s, e in spans:
                kinds = np.unique(own[s:e])
                value = 2 * np.isin(kinds, t.bigrams).sum() / (len(kinds) + n_own)
                if value >= threshold and t.marked(runs, a + s, a + e + 1, b):
                    found.append((t.name, float(value), s, e + 1, round(value * (len(kinds) + n_own) / 2), int(pair[k]) % len(size)))
        taken: list[tuple[str, float, int, int]] = []
        covered = np.zeros(len(own) + 1, bool)
        for m in sorted(_whole_ones(found, index), key=lambda m: (-m[1], m[2] - m[3], m[0], m[2])):
            if not covered[m[2] : m[3]].any():
                covered[m[2] : m[3]] = True
                taken.append(m[:4])
        out[d] = sorted(taken, key=lambda m: m[2])
    return out


def _whole_ones(found: list[tuple], index: Index) -> list[tuple]:
    """Matches without those of a part that overlap a better founded one of the whole."""
    present = {m[5] for m in found}
    held = {k: np.array([m[2:5] for m in found if m[5] == k]) for k in present}
    out = []
    for m in found:
        wholes = [held[k] for k in index.wholes[m[5]] & present]
        if not any(((w[:, 0] < m[3]) & (w[:, 1] > m[2]) & (w[:, 2] > m[4])).any() for w in wholes):
            out.append(m)
    return out


def _stretches(own: np.ndarray, shared: np.ndarray, n: int, least: float, most: int, threshold: float):
    """For each begin at a shared bigram the stretch of the best coefficient, if that reaches ``threshold``."""
    order = np.argsort(own, kind="stable")
    before = np.full(len(own), -1)
    again = own[order][1:] == own[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    sums = np.concatenate([[0], np.cumsum(shared)])
    begins = np.flatnonzero(shared)
    begins = begins[sums[np.minimum(begins + most, len(own))] - sums[begins] >= least]
    for s in begins.tolist():
        new = before[s : s + most] < s
        value = 2 * np.cumsum(new & shared[s : s + most]) / (np.cumsum(new) + n)
        at = int(np.argmax(value))
        if value[at] >= threshold:
            yield s, s + at + 1


def scan(documents: DataFrame, text_column: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, marks: dict[str, tuple[str, ...]] = MARKS, barred: dict[str, tuple[str, ...]] = BARRED) -> DataFrame:
    """``documents`` with ``licenses``: array of (name, dice, begin, end); a column of that name is replaced."""
    if sum(len(t) for t in templates.values()) > MAX_TEMPLATES:
        raise ValueError(f"templates of more than {MAX_TEMPLATES} characters")
    bound_batches(documents.sparkSession)
    documents = documents.drop("licenses")
    at, width = documents.columns.index(text_column), len(documents.columns)
    kind = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    names = [*documents.columns, "licenses"]

    def rows(batches):
        import pyarrow as pa

        known = Index([Template(name, text, marks.get(name, ()), barred.get(name, ())) for name, text in templates.items()])
        arrow = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for a, b, values in sliced(whole.column(at)):
                batch = Batch([v and v.translate(_FOLD) for v in values])
                found = matches_in(batch, RunHashes(batch.hashes).all(2), known, threshold)
                column = pa.array([[dict(zip(("name", "dice", "begin", "end"), m, strict=True)) for m in own] for own in found], arrow)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in (whole.column(k) for k in range(width))), column], names=names)

    return documents.mapInArrow(rows, T.StructType([*documents.schema.fields, T.StructField("licenses", kind)]))


def templates_from(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name -> text of the full licences in ``folder``, on any file system Spark reads; equal texts go by the first name."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    sized = files.agg(F.sum(F.length("value"))).first()[0] or 0
    if sized > MAX_TEMPLATES:
        raise ValueError(f"templates of more than {MAX_TEMPLATES} characters")
    out: dict[str, str] = {}
    for row in files.orderBy("name").collect():
        if row.value not in out.values():
            out[row.name] = row.value
    return out


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``: names in order of place, and the best coefficient."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.col("licenses.name"), "; ").alias("names"), F.array_max(F.col("licenses.dice")).alias("best_dice"))
