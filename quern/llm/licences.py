"""License scans by conditional compression.

Every cue word of a text has windows over it, each as wide as a template is around that word, up to the template's open places. A
window is compressed by itself and with each template as raw zstandard dictionary; the templates that save at least WEAK of it are
winners, the best first. So the verdict does not depend on the other text of the line.

A winner is confirmed by its exact wording only: its words follow each other without one missing and without one in between, but for
the places that the template leaves open for a party's name or a clause's number, and no negation comes just before. No wording is
looked for where the compressor names no template. An exact wording has its own window, of which its template saves more than WEAK, so
none is lost; of wordings that overlap the longest counts, so that a license is never named by the beginning of another. Reserved
rights beside a confirmed license of the same block are part of its notice.

What the exact wordings leave is compared by blocks: a block is a run of lines with a cue word of the templates and lines mostly of the templates'
words around it, over lines without words. Every part of a block is compressed in the window over a cue that has most of the template's
words; the template that saves the largest share is the winner, and what lies before and after its window is examined again. It is
reported unconfirmed, with the words that differ, each license once a block.

Null and empty texts give no row; neither do windows of a block that share less than
LEAST with a template, or whose best one saves less than WEAK. Ties go to the template that
comes first. Repeated rows give repeated results. Texts of any length are read whole, in time proportional to their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship

#: What a short notice says before a license's name, the names, and the wordings of whole notices. {party} and {number}
#: are the open places.
LEADS = ("Licensed under", "Released under", "Distributed under")
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("the Apache License, Version 2.0",),
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
}
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {party} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {party} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {party} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "GPL-2.0": (
        "{party} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "{party} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "{party} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "{party} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "{party} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {number} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {number} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY {party} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {party} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {number} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {number} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {number} Neither the name of {party} nor the names of {party} contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY {party} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {party} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC0-1.0": ("To the extent possible under law, {party} has waived all copyright and related or neighboring rights to this work.",),
    "Proprietary": ("All rights reserved.",),
}
#: Words in which every template has one; a text without any reaches no compressor. One word each, so no line break can split them.
CUES = r"(?i)licen[sc]|permission|redistribut|copyright|reserved|cc0|(?<![\p{L}\p{N}])cc(?![\p{L}\p{N}])|spdx"
#: Words that a party's name may have, and what may number a clause.
PARTY, NUMBER = 12, regex.compile(r"\d{1,2}|[a-f]|i{1,3}|iv").fullmatch
#: Words that turn a notice around if one is among the last few of the sentence before it.
NEGATIONS = frozenset("not no never neither nor without cannot nothing none isn wasn aren weren doesn don didn".split())
NEGATED_BY = 4
#: A notice of reserved rights, which belongs to whatever license stands beside it.
RESERVED = "Proprietary"
#: Savings, in hundredths of the compressed size, below which a window is no license.
WEAK = 25
#: Words, for each hundred of the template's, that a window must share with it to be compared.
LEAST = 50
#: Words of a window beyond the template's own, for each hundred of those, and at all.
EXTRA, MOST_EXTRA = 20, 20
#: Words, of a hundred, that a line without a cue must share with the templates to belong to a block.
SHARED = 70
#: Words by which a block is compared, with as many more as the longest window, so that none is cut.
PIECE = 256
LEVEL = 3

_cue, _cues = regex.compile(CUES).search, regex.compile(CUES).finditer
_found = regex.compile(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*").finditer
_ends = regex.compile(r"[.!?;:](?=\s)|\n\s*\n").search


def _word(text: str) -> list[str]:
    """The words of lower-case text; addresses count alike with and without encryption."""
    return ["http" if m[0] == "https" else m[0] for m in _found(text)]


class Template:
    """A wording: its license, its words, its compressor, and the runs of words between its open places."""

    def __init__(self, license: str, wording: str):
        self.license = license
        parts = regex.split(r"\{(party|number)\}", wording.lower())
        self.runs = [_word(p) for p in parts[::2]]
        self.gaps = parts[1::2]
        self.words = [w for run in self.runs for w in run]
        self.reach = len(self.words) + sum({"party": PARTY, "number": 1}[gap] for gap in self.gaps)
        self.room = min(MOST_EXTRA, max(EXTRA * len(self.words) // 100, self.gaps.count("party")))
        held = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False)

    def at(self, words: list[str], begin: int) -> tuple[int, list[str]] | None:
        """Where the wording ends and what its open places hold, if it begins there. A leading open place is left out."""
        runs, gaps = (self.runs, self.gaps) if self.runs[0] else (self.runs[1:], self.gaps[1:])
        if words[begin : begin + len(runs[0])] != runs[0]:
            return None
        at, held = begin + len(runs[0]), []
        for gap, run in zip(gaps, runs[1:], strict=True):
            n = len(run)
            if gap == "number":
                skip = next((k for k in range(2) if words[at + k : at + k + n] == run and (not k or NUMBER(words[at]))), None)
            else:
                skip = next((k for k in range(PARTY + 1) if words[at + k : at + k + n] == run), None)
            if skip is None:
                return None
            held += words[at : at + skip]
            at += skip + n
        return at, held

    @property
    def first(self) -> str:
        return self.words[0]


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    """The short forms of every license and the whole notices."""
    short = [Template(name, f"{lead} {form}") for name, forms in NAMES.items() for form in forms for lead in LEADS]
    return short + [Template(name, wording) for name, forms in NOTICES.items() for wording in forms]


@lru_cache(maxsize=1)
def _plain() -> tuple[zstandard.ZstdCompressor, frozenset[str], dict[str, list[tuple[int, int]]], int]:
    """The compressor without a dictionary, the templates' words, by cue the words before it and from it on in a window, and the widest window."""
    around: dict[str, set[tuple[int, int]]] = {}
    for run in (run for t in templates() for run in t.runs):
        for at in _cued(run):
            around.setdefault(run[at], set()).add((at, len(run) - at))
    vocabulary = frozenset(w for t in templates() for w in t.words)
    places = {w: sorted(found) for w, found in around.items()}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), vocabulary, places, max(len(t.words) + t.room for t in templates())


def blocks(lines: list[str], words: list[list[str]]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of every candidate block of a text, given the words of its lines."""
    vocabulary = _plain()[1]
    first, cued = None, False
    for i, own in enumerate(words):
        cue = _cue(lines[i]) is not None
        if cue or (own and 100 * sum(w in vocabulary for w in own) >= SHARED * len(own)):
            first, cued = i if first is None else first, cued or cue
        elif own:
            if cued:
                yield first, i
            first, cued = None, False
    if cued:
        yield first, len(words)


def differences(template: list[str], words: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that are missing, words in between that are not its own, and where the template begins and ends."""
    lacks, extra, begin, end = [], [], len(words), 0
    parts = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
    for kind, _, _, c, d in parts:
        if kind == "equal":
            begin, end = min(begin, c), max(end, d)
    for kind, a, b, c, d in parts:
        if kind != "equal":
            lacks += template[a:b]
            extra += words[max(c, begin) : max(min(d, end), max(c, begin))]
    return lacks, extra, begin, end


def saved(i: int, words: Sequence[str]) -> float:
    """The share of the compressed size of words that a template saves."""
    raw = " ".join(words).encode("utf-8", "surrogatepass")
    return 1 - len(templates()[i].compressor.compress(raw)) / len(_plain()[0].compress(raw))


def _cued(words: Sequence[str]) -> set[int]:
    """Places of words in which a cue begins."""
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return {bisect_right(starts, m.start()) - 1 for m in _cues(" ".join(words))}


@lru_cache(maxsize=4096)
def winners(window: tuple[str, ...]) -> tuple[int, ...]:
    """The templates that save enough of a window, the best first. Repeated windows are compressed once, as the last results are held."""
    raw = " ".join(window).encode("utf-8", "surrogatepass")
    alone = len(_plain()[0].compress(raw))
    ranked = sorted((len(t.compressor.compress(raw)), i) for i, t in enumerate(templates()))
    return tuple(i for left, i in ranked if 100 * (alone - left) >= WEAK * alone)


def wordings(words: list[str]) -> list[tuple[int, int, int, list[str]]]:
    """(begin, end, template, words in open places) of the winners over cues that words hold exactly; they do not overlap."""
    _, vocabulary, around, _ = _plain()
    known = templates()
    # A word longer than the templates' is none of theirs, however it goes on, so its beginning is enough to compress.
    longest = max(map(len, vocabulary)) + 1
    begins: dict[str, list[int]] = {t.first: [] for t in known}
    cues = []
    for at, w in enumerate(words):
        if w in begins:
            begins[w].append(at)
        if w in around:
            cues.append(at)
    found = set()
    for at in cues:
        windows = [tuple(w[:longest] for w in words[at - before : at + after]) for before, after in around[words[at]] if before <= at]
        for i in dict.fromkeys(i for window in windows for i in winners(window)):
            own = begins[known[i].first]
            for begin in own[bisect_right(own, at - known[i].reach) : bisect_right(own, at)]:
                hit = known[i].at(words, begin)
                if hit and hit[0] > at:
                    found.add((-len(known[i].words), len(hit[1]), i, begin, hit[0], tuple(hit[1])))
    taken, out = bytearray(len(words)), []
    for _, _, i, begin, end, held in sorted(found):
        if not any(taken[begin:end]):
            taken[begin:end] = b"\1" * (end - begin)
            out.append((begin, end, i, list(held)))
    return sorted(out)


@lru_cache(maxsize=1024)
def guess(words: tuple[str, ...]) -> tuple[int, float, int, int] | None:
    """(template, share saved, begin, end) of the window over a cue that a template saves most of, if it is enough.

    Repeated passages are compressed once, as the last results are held.
    """
    cues = _cued(words)
    held = list(accumulate((i in cues for i in range(len(words))), initial=0))
    tried = []
    for i, t in enumerate(templates() if cues else ()):
        n, own = min(len(words), len(t.words) + t.room), set(t.words)
        shared = list(accumulate((w in own for w in words), initial=0))
        most, begin = min((s - e, b) for b, (s, e, c, d) in enumerate(zip(shared, shared[n:], held, held[n:], strict=False)) if d > c)
        if 100 * -most >= LEAST * len(t.words):
            tried.append((-saved(i, words[begin : begin + n]), i, begin, begin + n))
    if not tried or 100 * -min(tried)[0] < WEAK:
        return None
    left, i, begin, end = min(tried)
    return i, -left, begin, end


def _negated(text: str, spans: list[tuple[int, int]], words: list[str], begin: int) -> bool:
    """Whether the sentence turns what begins there around."""
    for at in range(begin - 1, max(begin - NEGATED_BY, 0) - 1, -1):
        if _ends(text, spans[at][1], spans[at + 1][0] + 1):
            return False
        if words[at] in NEGATIONS:
            return True
    return False


def match(text: str) -> Iterator[tuple[int, int, str, float, list[str], list[str], bool]]:
    """The licenses that a text names: (first line, last line, license, share saved, words missing, words in between, confirmed)."""
    lines = text.split("\n")
    offsets = accumulate((len(x) + 1 for x in lines), initial=0)
    by_line, spans = [], []
    for at, x in zip(offsets, lines, strict=False):
        low = x.lower()
        by_line.append(_word(low))
        # Where lower case has another length, places within the line are not known; they matter for ends of sentences only.
        spans += [(at + m.start(), at + m.end()) for m in _found(low)] if len(low) == len(x) else [(at, at)] * len(by_line[-1])
    words = [w for own in by_line for w in own]
    line = [i for i, own in enumerate(by_line) for _ in own]
    starts = list(accumulate(map(len, by_line), initial=0))
    known, widest = templates(), _plain()[3]
    exact = wordings(words)
    runs = [(first, last, starts[first], starts[last]) for first, last in blocks(lines, by_line)]
    sure, turned = [], []
    for hit in exact:
        (turned if _negated(text, spans, words, hit[0]) else sure).append(hit)
    open_ = {n for n, (_, _, a, b) in enumerate(runs) if any(known[x[2]].license != RESERVED for x in _within(sure, a, b))}
    block_of = [a for _, _, a, _ in runs]
    for hits, confirmed in ((sure, True), (turned, False)):
        for begin, end, i, held in hits:
            if not (known[i].license == RESERVED and bisect_right(block_of, end - 1) - 1 in open_):
                yield line[begin], line[end - 1], known[i].license, saved(i, words[begin:end]), [], held, confirmed
    for _, _, at, stop in runs:
        inside = _within(exact, at, stop)
        named = {known[x[2]].license for x in inside}
        edges = [at, *[min(max(e, at), stop) for x in inside for e in x[:2]], stop]
        gaps = list(pairwise(edges))[::2]
        todo = [(p, min(p + PIECE + widest, b)) for a, b in gaps for p in range(a, b, PIECE)][::-1]
        while todo:
            a, b = todo.pop()
            best = guess(tuple(words[a:b]))
            if best is None:
                continue
            i, share, begin, end = best
            lacks, extra, c, d = differences(known[i].words, words[a + begin : a + end]) if known[i].license not in named else ([], [], 0, 1)
            c, d = (c, d) if c < d else (0, end - begin)  # no word is equal, only parts of words are
            if known[i].license not in named:
                named.add(known[i].license)
                yield line[a + begin + c], line[a + begin + d - 1], known[i].license, share, lacks, extra, False
            todo += [(a, a + begin), (a + end, b)]


def _within(hits: list[tuple], at: int, stop: int) -> list[tuple]:
    """Those of the hits, sorted and apart from each other, that have words in a range."""
    return hits[bisect_right(hits, at, key=lambda x: x[1]) : bisect_right(hits, stop - 1, key=lambda x: x[0])]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_line, last_line, license, saved, lacks, extra, confirmed): a row for every wording of a license.

    Rows without any cue word are left out in the JVM before a text goes to Python.
    """
    ship(docs.sparkSession)
    held = docs.filter(F.col(text).rlike(CUES)).select(F.col(key), F.col(text))
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, first_line int, last_line int, license string, saved double, lacks array<string>, extra array<string>, confirmed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(1)):
                for hit in match(value.as_py()):
                    at.append(i)
                    found.append(hit)
            columns = list(zip(*found, strict=True)) or [()] * 7
            types = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "first_line", "last_line", "license", "saved", "lacks", "extra", "confirmed"])

    return held.mapInArrow(run, schema)
