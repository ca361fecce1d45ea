"""License scans by patience alignment.

Text and template are words (letters and digits, case folded). Where the template may lie is voted on: every occurrence of one of
its words proposes a start, and starts that agree on a fair share of the words open a window of the text. In a window, words
unique to both sides are the anchors; the longest increasing subsequence of their places is kept, and the gaps between kept
anchors are aligned alike, with what is unique in them, until nothing more is. Coverage is the share of the template's words that
were aligned. A text is only aligned with a template if it holds enough of the template's distinct words to reach the least
coverage, which is an exact bound.

Null and empty texts hold no license. One row is returned for each place of a document where a license is found; where places overlap, as
those of one family do, only the one with most aligned words counts (ties: the higher coverage, then the first). A text is read whole,
however long. An empty table gives no rows; other columns are ignored. Short templates must be aligned in full, longer ones with the words that tell the license from its relatives. Repeated rows give repeated results. A null doc_id is carried along.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shoal.llm.shared import table
from shoal.llm.text import row_of, slices, word_hashes, words

LEAST_PERCENT = 80
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_FOLD[0x41:0x5B] += 32

# Notices and license texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
)
# Words that tell a license from those whose texts are nearly alike; those that a template of the license holds must be aligned.
TELLING = {
    "Apache-2.0": "apache 2", "GPL-3.0": "gnu general 3", "GPL-2.0": "gnu general 2", "LGPL-3.0": "gnu lesser 3", "LGPL-2.1": "gnu lesser 2 1", "AGPL-3.0": "gnu affero 3",
    "MPL-2.0": "mozilla 2", "BSD-3-Clause": "neither nor names endorse promote", "BSD-2-Clause": "redistributions source binary",
}
SHORT = 16  # templates of up to so many words must be aligned in full


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = _FOLD[data]
    starts, ends, first = words(folded, offs)
    return word_hashes(folded, starts, ends, 61), first


class Library:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        hashed, telling = [], []
        for _, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            hashed.append(hashed_words(data, np.array([0, len(data)]))[0])
        for name in self.names:
            data = np.frombuffer(TELLING.get(name, "").encode(), np.uint8)
            telling.append(hashed_words(data, np.array([0, len(data)]))[0])
        self.words = np.unique(np.concatenate(hashed))
        self.ids = [np.searchsorted(self.words, h) for h in hashed]
        self.telling = [set(np.searchsorted(self.words, np.intersect1d(t, h)).tolist()) for t, h in zip(telling, hashed, strict=True)]
        self.has = np.zeros((len(templates), len(self.words)), np.int32)
        for t, ids in enumerate(self.ids):
            self.has[t, ids] = 1
        self.distinct = self.has.sum(1)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two word sequences."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)] + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return ends
    count: dict[int, list] = {}
    for side, seq in enumerate((x, y)):
        for i, w in enumerate(seq):
            entry = count.setdefault(w, [0, 0, 0, 0])
            entry[side] += 1
            entry[2 + side] = i
    anchors = sorted((e[2], e[3]) for e in count.values() if e[0] == e[1] == 1)
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(anchors):
        at = bisect.bisect_left(piles, j)
        back.append(tops[at - 1] if at else -1)
        piles[at : at + 1], tops[at : at + 1] = [j], [n]
    kept, n = [], tops[-1] if tops else -1
    while n >= 0:
        kept.append(anchors[n])
        n = back[n]
    kept.reverse()
    if not kept:
        return ends
    inner: list[tuple[int, int]] = []
    for (i, j), (k, m) in zip([(-1, -1), *kept], [*kept, (len(x), len(y))], strict=True):
        inner += [(i + 1 + p, j + 1 + q) for p, q in patience(x[i + 1 : k], y[j + 1 : m])]
        inner += [(k, m)] if k < len(x) else []
    return sorted(ends + [(head + p, head + q) for p, q in inner])


def windows(places: np.ndarray, ids: np.ndarray, template: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """Where the template may lie: starts proposed by its words, in bins of a quarter of its length (half overlapping)."""
    size = len(template)
    where: dict[int, list[int]] = {}
    for o, w in enumerate(template.tolist()):
        where.setdefault(w, []).append(o)
    bin_size = max(size // 4, 2)
    votes: dict[int, set] = {}
    for p, w in zip(places.tolist(), ids.tolist(), strict=True):
        for o in where.get(w, ()):
            for b in ((p - o) // bin_size, (p - o) // bin_size - 1):
                votes.setdefault(b, set()).add(o)
    out = []
    for b, offsets in sorted(votes.items()):
        if 2 * len(offsets) >= size:
            out.append((max(b * bin_size - bin_size, 0), min(b * bin_size + 3 * bin_size + size, n_words)))
    return out


def fits(line: list[int], template: np.ndarray, spans: list[tuple[int, int]], telling: set[int]) -> Iterator[tuple[int, int, int]]:
    """(aligned words, first word, end word) of the windows in which all telling words are aligned, and a short template in full."""
    for lo, hi in spans:
        found = patience(line[lo:hi], template.tolist())
        if found and (len(found) == len(template) or (len(template) > SHORT and telling <= {int(template[j]) for _, j in found})):
            yield len(found), lo + found[0][0], lo + found[-1][0] + 1


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """docs(doc_id, text) to doc_id, license, coverage, matched_words, template_words, start_word, end_word."""
    schema = "doc_id long, license string, coverage double, matched_words int, template_words int, start_word long, end_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = Library(templates)
        for batch in batches:
            out: list[tuple] = []
            for lo, hi, data, offs in slices(batch.column(1)):
                hashes, first = hashed_words(data, offs)
                at = np.minimum(np.searchsorted(lib.words, hashes), len(lib.words) - 1)
                known = lib.words[at] == hashes
                rows = row_of(first)
                seen = np.zeros((hi - lo, len(lib.words)), np.int32)
                seen[rows[known], at[known]] = 1
                hopeful = 100 * (seen @ lib.has.T) >= least_percent * lib.distinct
                for r in np.flatnonzero(hopeful.any(1)):
                    line = np.where(known[first[r] : first[r + 1]], at[first[r] : first[r + 1]], -1)
                    places = np.flatnonzero(line >= 0)
                    found: list[tuple] = []
                    for t in np.flatnonzero(hopeful[r]):
                        size = len(lib.ids[t])
                        for n, start, end in fits(line.tolist(), lib.ids[t], windows(places, line[places], lib.ids[t], len(line)), lib.telling[t]):
                            if 100 * n >= least_percent * size:
                                found.append((-n, -n / size, start, end, size, lib.names[t]))
                    taken: list[tuple[int, int]] = []
                    for n, share, start, end, size, name in sorted(found):
                        if all(start >= b or end <= a for a, b in taken):
                            taken.append((start, end))
                            out.append((batch.column(0)[lo + int(r)].as_py(), name, -share, -n, size, start, end))
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
