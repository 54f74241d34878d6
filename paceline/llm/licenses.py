"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowtext import mix64, shingles, short_keys, text_runs, words

SHINGLE = 5

#: fixed values: notices by which works name their license
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
)


def _template_shingles(text: str) -> np.ndarray:
    """The shingles of a template; one of fewer words is a single shingle of them all."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, h, row = words(raw, np.array([0, len(raw)]))
    if not len(h):
        raise ValueError(f"a template needs words: {text!r}")
    return shingles(h, row, SHINGLE)[0]


def _n_words(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return len(words(raw, np.array([0, len(raw)]))[2])


class Index:
    """Band keys of templates, by the length of their windows.

    A window has as many shingles as the template and begins at a multiple of a stride of an eighth of that at most.  If the text
    holds a share `containment` of the template's shingles in a stretch of that length, the best window has at least the
    similarity `low`; two rows a band, and so many bands that one collides with probability 1 - miss.  What they retrieve is verified
    in stretches of up to one and a half lengths, so looser places are found too, with a lower probability.
    Templates of fewer than five words have no window: they are looked up by all their words.
    """

    def __init__(self, templates, containment: float = 0.8, miss: float = 1e-5, seed: int = 17):
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(_template_shingles(t)) for _, t in templates]
        self.sizes = [len(_template_shingles(t)) for _, t in templates]
        self.containment = containment
        n_words = [_n_words(t) for _, t in templates]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(n_words):
            if n < SHINGLE:
                self.short.setdefault(n, []).append((int(self.sets[i][0]), i))
        rng = np.random.default_rng(seed)
        self.groups = []
        for n in sorted({s for s, w in zip(self.sizes, n_words) if w >= SHINGLE}):
            stride = 1
            while stride * 2 <= n // 8:
                stride *= 2
            span = n // stride * stride
            shared = max(1, ceil(containment * n - 1e-9) - stride // 2 - (n - span))
            low = shared / (n + span - shared)
            bands = 1 if low >= 1 else ceil(log(miss) / log(1 - low * low))
            self.groups.append((n, stride, span, bands, [i for i, s in enumerate(self.sizes) if s == n and n_words[i] >= SHINGLE]))
        most = max((g[3] for g in self.groups), default=0)
        self.factors = rng.integers(0, 2**63, 2 * most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys = []
        for n, stride, span, bands, members in self.groups:
            by = []
            for j in range(bands):
                keys = np.array([self._key(*(self._hash(_all, 2 * j + r).min() for r in (0, 1)))[0] for _all in (self.sets[i] for i in members)], np.uint64)
                table = np.zeros(1 << 16, bool)
                table[(keys >> np.uint64(48)).astype(np.int64)] = True
                order = np.argsort(keys)
                by.append((keys[order], np.array(members)[order], table))
            self.keys.append(by)

    def _hash(self, s: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((s * self.factors[i]) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _key(a, b) -> np.ndarray:
        return mix64(np.atleast_1d(np.asarray(a, np.uint64)) << np.uint64(32) | np.asarray(b, np.uint64))

    def candidates(self, s: np.ndarray) -> set[tuple[int, int, int]]:
        """(window begin, window end, template) by shingle number, over the joined rows of a run."""
        found: set[tuple[int, int, int]] = set()
        longest = max((g[0] for g in self.groups), default=0)
        if len(s) < 2 * longest:  # filler for windows beyond the end
            s = np.concatenate([s, mix64(np.arange(2 * longest, dtype=np.uint64) + np.uint64(1 << 40))])
        for j in range(len(self.factors) // 2):
            level: dict[int, list[np.ndarray]] = {1: [self._hash(s, 2 * j), self._hash(s, 2 * j + 1)]}
            for g, (n, stride, span, bands, _) in enumerate(self.groups):
                if j >= bands:
                    continue
                step = max(x for x in level if x <= stride)
                while step < stride:
                    level[2 * step] = [np.minimum(x[: len(x) // 2 * 2 : 2], x[1::2]) for x in level[step]]
                    step *= 2
                lows = []
                for low in level[stride]:
                    size = 1
                    while 2 * size <= span // stride:
                        low = np.minimum(low[:-size], low[size:])
                        size *= 2
                    if size < span // stride:
                        low = np.minimum(low[: size - span // stride], low[span // stride - size :])
                    lows.append(low)
                keys, members, table = self.keys[g][j]
                key = self._key(*lows)
                at = np.flatnonzero(table[(key >> np.uint64(48)).astype(np.int64)])
                left, right = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                for k in np.flatnonzero(left < right).tolist():
                    begin = int(at[k]) * stride
                    found.update((begin, begin + span, int(members[x])) for x in range(left[k], right[k]))
        return found

    def matches(self, s: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, template, containment, first, last shingle of the row) of verified templates, each place once."""
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for begin, end, t in self.candidates(s):
            slack = self.sizes[t] // 2
            lo, hi = max(0, begin - slack), min(len(s), end + slack)
            if lo >= hi:
                continue
            for r in range(int(np.searchsorted(row, lo, "right")) - 1, int(np.searchsorted(row, hi, "left"))):
                a, b = max(lo, int(row[r])), min(hi, int(row[r + 1]))
                if a < b:
                    by.setdefault((r, t), []).append((a, b))
        out = []
        for (r, t), spans in sorted(by.items()):
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                out += [(r, t, share, a + first - int(row[r]), a + last - int(row[r])) for share, first, last in self._places(s[a:b], t)]
        return out

    def short_matches(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, template, 1.0, first, last word of the row) of templates of fewer than five words."""
        out = []
        for n, known in self.short.items():
            if len(h) < n:
                continue
            keys, at = short_keys(h, n), np.arange(len(h) - n + 1)
            inside = np.searchsorted(row, at, "right") == np.searchsorted(row, at + n - 1, "right")
            for key, t in known:
                for at in np.flatnonzero((keys == np.uint64(key)) & inside).tolist():
                    r = int(np.searchsorted(row, at, "right")) - 1
                    out.append((r, t, 1.0, at - int(row[r]), at - int(row[r]) + n - 1))
        return out

    def _places(self, s: np.ndarray, t: int) -> list[tuple[float, int, int]]:
        """Disjoint stretches of one and a half times the template's length at most whose exact containment suffices, from left to
        right, of those that overlap the best: containment, first and last hit."""
        want = self.sets[t]
        hit = np.flatnonzero(np.isin(s, want)).tolist()
        reach, out = self.sizes[t] + self.sizes[t] // 2, []
        count: dict[int, int] = {}
        best, left, k = None, 0, 0
        while k < len(hit):
            x = int(s[hit[k]])
            count[x] = count.get(x, 0) + 1
            while hit[k] - hit[left] >= reach:
                y = int(s[hit[left]])
                count[y] -= 1
                if not count[y]:
                    del count[y]
                left += 1
            share = len(count) / len(want)
            if share >= self.containment - 1e-9 and (best is None or share > best[0]):
                best = (share, hit[left], hit[k])
            k += 1
            if best and (k == len(hit) or hit[k] - best[1] >= reach):  # nothing beyond overlaps it by more
                out.append(best)
                k = left = int(np.searchsorted(hit, best[2], "right"))
                count, best = {}, None
        return out


def scan(docs: DataFrame, *, templates=TEMPLATES, containment: float = 0.8, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with the array column `out` of structs (license, template, containment, first_word, last_word), by place.

    A template matches where a stretch of one and a half times its length holds the share `containment` of its distinct shingles
    of five words; one of fewer words where all of them follow each other.  Repeated notices are matches of their own, also side
    by side.  Null and empty texts match nothing; very long ones are scanned whole; repeated rows are rows of their own; an empty
    table gives no rows.  Templates (a bounded list) go to every task.  Other columns pass through, but for one named `out`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, containment))
    df = docs.select(*[c for c in docs.columns if c != out]).withColumn(out, F.lit(None).cast("array<struct<license:string,template:int,containment:double,first_word:bigint,last_word:bigint>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part, data, off in text_runs(batches, text):
            _, _, h, row = words(data, off)
            s, at = shingles(h, row, SHINGLE)
            rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for r, t, share, first, last in index.matches(s, at) if len(s) else ():
                rows[r].append({"license": index.names[t], "template": t, "containment": share, "first_word": first, "last_word": last + SHINGLE - 1})
            for r, t, share, first, last in index.short_matches(h, row):
                rows[r].append({"license": index.names[t], "template": t, "containment": share, "first_word": first, "last_word": last})
            for x in rows:
                x.sort(key=lambda m: (m["first_word"], m["template"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, part.schema.field(part.num_columns - 1).type)], schema=part.schema)

    return df.mapInArrow(run, df.schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its licenses in order, comma-joined, the number of matches and the largest containment (null without)."""
    found = scan(docs.select("doc_id", "text"), **options)
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("licenses").cast("long").alias("n_matches"), F.round(F.array_max(F.transform("licenses", lambda m: m["containment"])), 6).alias("containment"))
