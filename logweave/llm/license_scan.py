"""Licence notices in texts, by Dice coefficient over word bigrams.

Words are lower-cased stretches of letters and digits, so line breaks and comment
marks play no part. A template is looked for in all stretches of a text that begin
and end with one of its bigrams: others are never more similar. A template
of s bigrams must share t * s of them, so that no common beginning of short ones is
taken for all of it, and can only reach similarity t with stretches that hold s * (2 - t) / t
at most. So a text that holds fewer of a template's bigrams is not compared with it,
and neither is a stretch that holds fewer or is longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, byte_class, gram_hashes, text_groups, word_hashes, words
from .tables import with_text

WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LEAST_DICE = 0.8

# Notices and short texts in the wording their licences give, and names of their own in SPDX lines.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "CC-BY-4.0", "CC0-1.0")),
)


class Templates:
    """The bigrams of the templates, and which templates hold each."""

    def __init__(self, templates: Sequence[tuple[str, str]], least: float):
        self.least, self.names, sets, lengths = least, [], [], []
        for name, text in templates:
            grams = np.concatenate([np.empty(0, np.uint64), *(g for _, _, _, g, _ in _bigrams(pa.array([text])))])
            if len(grams):
                self.names.append(name)
                sets.append(np.unique(grams))
                lengths.append(len(grams))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.all = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
        gram, template = np.concatenate([np.empty(0, np.int64), *(np.searchsorted(self.all, s) for s in sets)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(gram, kind="stable")
        self.template, self.reach = template[order], np.searchsorted(gram[order], np.arange(len(self.all) + 1))
        self.has = [frozenset(np.searchsorted(self.all, s).tolist()) for s in sets]
        #: Bigrams a stretch must share, at least, and that it may hold, repeats included.
        self.need = np.ceil(least * self.sizes - 1e-9).astype(np.int64)
        self.longest = np.floor(np.array(lengths, float) * (2 - least) / least + 1e-9).astype(np.int64)

    def candidates(self, doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with templates of which they hold enough bigrams."""
        cells = np.unique(doc * max(len(self.all), 1) + gram)
        doc, gram = np.divmod(cells, max(len(self.all), 1))
        counts = self.reach[gram + 1] - self.reach[gram]
        at = np.repeat(self.reach[gram] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pairs, held = np.unique(np.repeat(doc, counts) * max(len(self.names), 1) + self.template[at], return_counts=True)
        doc, template = np.divmod(pairs, max(len(self.names), 1))
        enough = held >= self.need[template]
        return doc[enough], template[enough]

    def stretches(self, template: int, hashes: np.ndarray, gram: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(shared bigrams, Dice, first, last bigram) of all stretches of a document that are similar
        enough; ``gram`` has the number of each bigram among all templates', or -1."""
        own, size, longest = self.has[template], int(self.sizes[template]), int(self.longest[template])
        hits = np.array([i for i in np.flatnonzero(gram >= 0).tolist() if gram[i] in own], np.int64)
        ahead = np.searchsorted(hits, hits + longest) - np.arange(len(hits))
        out = []
        for i in np.flatnonzero(ahead >= self.need[template]).tolist():
            first, shared, seen, at = int(hits[i]), set(), set(), int(hits[i])
            for last in hits[i:i + ahead[i]].tolist():
                seen.update(hashes[at:last + 1].tolist())
                at = last + 1
                shared.add(int(gram[last]))
                dice = 2 * len(shared) / (len(seen) + size)
                if dice >= self.least and len(shared) >= self.need[template]:
                    out.append((len(shared), dice, first, last))
        return out


def _bigrams(column: pa.Array):
    """Documents in groups: offsets, word starts and ends, bigram hashes, first word of each document."""
    for _, _, data, offs in text_groups(column):
        low = LOWER[data]
        starts, ends, first = words(low, offs, WORD)
        yield offs, starts, ends, gram_hashes(word_hashes(low, starts, ends), 2), first


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``notices``: one (license, dice, start,
    end) for each stretch of at least ``least`` that holds that share of its template's
    bigrams, in byte positions and their order.

    Of stretches that overlap the one that shares most bigrams with its template
    stays, of those the most similar one, the first name, the first in the text. A stretch
    holds at most (2 - t) / t times the bigrams of its template. Null and empty texts and
    those of fewer than two words have none. A column named ``notices`` is replaced.
    """
    source, rest, kinds, back = with_text(docs, text, ("notices",), gone=True)
    known = Templates(templates, least)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def chosen(found: list[tuple], starts: np.ndarray, ends: np.ndarray) -> list[dict]:
        out: list[tuple] = []
        for shared, dice, name, first, last in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3], f[4])):
            # A bigram is two words: stretches that share a word overlap.
            if all(last + 1 < a or first > b + 1 for _, _, a, b in out):
                out.append((name, dice, first, last))
        return [{"license": n, "dice": d, "start": int(starts[a]), "end": int(ends[b + 1])} for n, d, a, b in sorted(out, key=lambda f: f[2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notices: list[list[dict]] = []
            for offs, starts, ends, grams, first in _bigrams(batch.column(len(rest))):
                at = np.minimum(np.searchsorted(known.all, grams), max(0, len(known.all) - 1))
                inside = np.searchsorted(first, np.arange(len(grams)), "right") - 1
                inside[np.arange(len(grams)) + 1 >= first[np.minimum(inside + 1, len(first) - 1)]] = -1  # over a border
                hit = (known.all[at] == grams) & (inside >= 0) if len(known.all) else np.zeros(len(grams), bool)
                gram = np.where(hit, at, -1)
                found: dict[int, list[tuple]] = {}
                for d, t in zip(*(x.tolist() for x in known.candidates(inside[hit], at[hit]))):
                    a, b = int(first[d]), int(first[d + 1]) - 1
                    found.setdefault(d, []).extend((s, dice, known.names[t], i, j) for s, dice, i, j in known.stretches(t, grams[a:b], gram[a:b]))
                own = [[] for _ in range(len(first) - 1)]
                for d, all_ in found.items():
                    own[d] = chosen(all_, starts[first[d]:first[d + 1]] - offs[d], ends[first[d]:first[d + 1]] - offs[d])
                notices += own
            yield pa.record_batch([*batch.columns[:len(rest)], pa.array(notices, kind)], [*rest, "notices"])

    return back(source.mapInArrow(run, f"{kinds}notices array<struct<license:string,dice:double,start:long,end:long>>"))
