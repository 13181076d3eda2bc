"""License notices in documents, by an exact set-similarity join with templates.

A text block is a line, or a passage that goes on over line ends, as a wrapped
notice does. A template is found in a block if the block has at least CONTAINMENT
of the template's words (as sets). A passage is found in the lines that don't
have the template by themselves: it begins and ends with a word of the template
and is at most ROOM times as long as the template in running words (more than
once, for words at line starts such as ``dnl``). From the start of a text on, the
passage that first ends with enough words is taken, with the latest start that it
can have; it goes on to the last word within its length that the template has and
it lacks; the next passage of the template begins behind it.

All words of the templates are put in a global order, rare before frequent, by the number of blocks that have
them in all documents. For a template of n words of which o must be found:

- a block must have at least o words of the templates (length filter);
- it must share one of the template's n - o + 1 rarest words (prefix filter),
  which an index from words to templates finds;
- this word must leave room for the rest, so it must not be among the o - 1 most
  frequent words of the block either (positional filter).

Around a word of the prefix, a passage lies within its length, and so many words
of the template must be there and on more than one line; only such places are
looked at. What passes is counted exactly. The templates are a small fixed table and go to
the tasks with the function.

The result has a row for each block and template: doc_id, block (number from
0 of its line, or of the first of its lines), template, overlap and containment, rounded to six places.

Defined cases: a null text has no blocks; rows whose doc_id is null are scanned
and give a null doc_id; repeated rows give repeated results; a template without
words is never found; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._spark import ship
from ._text import Words, chunked

#: The threshold as a fraction.
CONTAINMENT = (4, 5)
#: How long a passage over several lines may be, as a fraction of the template's running words.
ROOM = (3, 2)
#: Words of a template in a batch whose passages are sought at once.
_ROWS = 100_000
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    # whole notices, as they stand at the head of files or in a licence file
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
      to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
      included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
      IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
      following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3rd-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
      agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
      distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General
      Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
      DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
      non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
      commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
}


class Index:
    """The templates over a vocabulary: need (words that must be found) and member (template x word)."""

    def __init__(self, templates: dict[str, str], containment: tuple[int, int] = CONTAINMENT):
        self.names = sorted(templates)
        words = Words(pa.array([templates[t].lower() for t in self.names], pa.string()))
        self.terms, index = np.unique(words.hash, return_inverse=True)
        self.member = np.zeros((len(self.names), len(self.terms)), bool)
        self.member[words.doc, index] = True
        self.size = self.member.sum(1)
        self.need = np.maximum(-((-self.size * containment[0]) // containment[1]), 1)
        self.reach = -((-words.counts * ROOM[0]) // ROOM[1])

    def order(self, frequency: np.ndarray) -> None:
        """Sets the rank of each term, and the templates of which it is in the prefix."""
        self.rank = np.empty(len(self.terms), np.int64)
        self.rank[np.lexsort((self.terms, frequency))] = np.arange(len(self.terms))
        prefix = [(r, t) for t in range(len(self.names)) for r in np.sort(self.rank[self.member[t]])[: self.size[t] - self.need[t] + 1].tolist()]
        prefix = np.array(sorted(prefix), np.int64).reshape(-1, 2)
        self.lists, self.listed = np.searchsorted(prefix[:, 0], np.arange(len(self.terms) + 1)), prefix[:, 1]
        self.by_rank = np.zeros_like(self.member)
        self.by_rank[:, self.rank] = self.member

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, line, term) of the template words in a batch; words and lines are numbered through the batch."""
        if not hasattr(words, "_occurrences"):
            h = words.hash
            at = np.minimum(np.searchsorted(self.terms, h), max(len(self.terms) - 1, 0))
            hit = np.flatnonzero(self.terms[at] == h) if len(self.terms) else np.zeros(0, np.int64)
            words._occurrences = hit, np.searchsorted(self.breaks(words), words.begin[hit], "right"), at[hit]
        return words._occurrences

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(line, term) of the template words in a batch, each once."""
        _, line, term = self.occurrences(words)
        code = np.unique(line * len(self.terms) + term)
        return code // max(len(self.terms), 1), code % max(len(self.terms), 1)

    @staticmethod
    def breaks(words: Words) -> np.ndarray:
        """Byte positions at which a line of the batch begins, but the first: after each line end and with each text."""
        if not hasattr(words, "_breaks"):
            words._breaks = np.sort(np.concatenate([np.flatnonzero(words.data == 10) + 1, words.at[1:-1]]), kind="stable")
        return words._breaks

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of all lines and passages that meet the threshold."""
        lines = self.lines(words)
        return tuple(map(np.concatenate, zip(lines, self.passages(words, *lines[:2]), strict=True)))

    def passages(self, words: Words, full: np.ndarray, having: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line, template, overlap) over several lines, but those that have the template by themselves (full, having)."""
        word, line, term = self.occurrences(words)
        doc = np.searchsorted(words.first, word, "right") - 1
        left, right = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
        rank = self.rank[term]
        number = self.lists[rank + 1] - self.lists[rank]
        seed, template = np.repeat(np.arange(len(word)), number), self.listed[B.take_runs(self.lists, rank)]
        low = np.maximum(np.searchsorted(word, word[seed] - self.reach[template], "right"), left[seed])
        high = np.minimum(np.searchsorted(word, word[seed] + self.reach[template]), right[seed])
        near = (high - low >= self.need[template]) & (line[high - 1] > line[low])
        template, low, high = template[near], low[near], high[near]
        found: list[tuple[int, int, int]] = []
        for t in np.unique(template).tolist():
            need, reach = int(self.need[t]), int(self.reach[t])
            own = self.member[t][term] & ~np.isin(line, full[having == t])
            sums, mine = B.spans(own), template == t
            a, b = low[mine], high[mine]
            enough = sums[b] - sums[a] >= need
            cover = np.zeros(len(word) + 1, np.int64)
            np.add.at(cover, a[enough], 1)
            np.add.at(cover, b[enough], -1)
            hit = np.flatnonzero(own & (np.cumsum(cover[:-1]) > 0))
            w, d, slot = word[hit], doc[hit], (np.cumsum(self.member[t]) - 1)[term[hit]]
            free = 0  # the first that no passage has
            for begin in range(0, len(hit), _ROWS):
                base = max(begin - reach, 0)
                some = np.arange(base, min(begin + _ROWS, len(hit)))
                # for each place and word, the last place so far that has the word; the need-th latest of these is the latest start
                last = np.full((len(some), self.size[t]), -1, np.int64)
                last[some - base, slot[some]] = some
                np.maximum.accumulate(last, axis=0, out=last)
                start = np.partition(last, self.size[t] - need, axis=1)[:, self.size[t] - need]
                good = (some >= begin) & (start >= 0) & (d[start] == d[some]) & (w[some] - w[start] < reach)
                for i, j in zip(start[good].tolist(), some[good].tolist(), strict=True):
                    if i < free:
                        continue
                    has = set(slot[i : j + 1].tolist())
                    free = k = j + 1
                    while k < len(hit) and d[k] == d[i] and w[k] - w[i] < reach:
                        if slot[k] not in has:
                            has.add(int(slot[k]))
                            free = k + 1
                        k += 1
                    found.append((int(line[hit[i]]), t, len(has)))
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def lines(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, template, overlap) of all lines that meet the threshold."""
        block, term = self.hits(words)
        rank = self.rank[term]
        o = np.lexsort((rank, block))
        block, rank = block[o], rank[o]
        own, start, size = np.unique(block, return_index=True, return_counts=True)
        at = np.append(start, len(block))
        which = np.repeat(np.arange(len(own)), size)
        place = np.arange(len(block)) - start[which] if len(block) else np.zeros(0, np.int64)
        number = self.lists[rank + 1] - self.lists[rank]
        template = self.listed[B.take_runs(self.lists, rank)]
        which, place = np.repeat(which, number), np.repeat(place, number)
        near = place <= size[which] - self.need[template]
        pair = np.unique(which[near] * len(self.names) + template[near])
        which, template = pair // len(self.names), pair % len(self.names)
        if not len(which):
            return which, which, which
        i = B.take_runs(at, which)
        owner = np.repeat(template, size[which])
        overlap = np.add.reduceat(self.by_rank[owner, rank[i]], B.spans(size[which])[:-1], dtype=np.int64)
        good = overlap >= self.need[template]
        return own[which[good]], template[good], overlap[good]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """One row for each block and template that it has: doc_id, block, template, overlap and containment; ``templates`` maps names to texts."""
    ship(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates, containment)
    texts = docs.select("doc_id", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index.terms), np.int64)
        for batch in chunked(batches):
            n += np.bincount(index.hits(Words(batch.column("text")))[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["term", "n"])

    sums = texts.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(index.terms), np.int64)
    for term, n in sums:
        frequency[term] = n
    index.order(frequency)
    names = np.array(index.names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            words = Words(batch.column("text"))
            block, template, overlap = index.find(words)
            first = np.searchsorted(index.breaks(words), words.at[:-1], "right")  # the first block of each text
            # empty texts begin where the next one does; the last of equals holds the blocks
            doc = np.searchsorted(first, block, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(block - first[doc]), pa.array(names[template].tolist(), pa.string()), pa.array(overlap), pa.array(overlap / index.size[template])], names=["doc_id", "block", "template", "overlap", "containment"])

    schema = docs.select("doc_id").schema.add("block", "long").add("template", "string").add("overlap", "long").add("containment", "double")
    return texts.mapInArrow(write, schema).withColumn("containment", F.round("containment", 6))


def oracle(templates: dict[str, str] | None = None, containment: tuple[int, int] = CONTAINMENT) -> str:
    word = "list_distinct(regexp_extract_all(lower({}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((TEMPLATES if templates is None else templates).items()))
    return f"""with t as (select template, unnest({word.format('body')}) w from (values {values}) x(template, body)),
  n as (select template, count(*) n from t group by template),
  b as (select r, doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 as block from (select row_number() over () r, doc_id, string_split(text, chr(10)) l from documents where text is not null)),
  w as (select r, doc_id, block, unnest({word.format('line')}) w from b),
  o as (select r, doc_id, block, template, count(*) overlap from w join t using (w) group by all)
select doc_id, block, template, overlap, round(overlap::double / n, 6) as containment from o join n using (template) where overlap * {containment[1]} >= n * {containment[0]}"""
