"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates (notices and whole licences); a text streams
through it and gives matching statistics: at each word the longest run of words ending there
that some template holds, in all its places. Runs of ``MIN_RUN`` words or more are chained in
order into spans; a span that covers ``COVERED`` of a template is reported as its label beside
the phrases that name licences outright. Where spans overlap, the larger coverage stays, so
that a text of one licence is not one of its relatives too.

Words are runs of ASCII letters, digits and all characters beyond ASCII, with
A-Z in lower case. Defined results: a null or empty text has no words, no spans,
no labels and score 0; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import small_batches
from barloom.llm.text import LOWER, chunks, spans, word_hashes

#: Phrases that name a licence, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and words of notices and whole licences. A licence may have several texts.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
     "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
     "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
     "connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
     "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
     "express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version this program is "
     "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
     "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
     "general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
     "as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
     "as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
     "documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written permission this "
     "software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
     "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright "
     "holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not "
     "limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
     "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use "
     "of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
     "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
     "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
     "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
     "performance of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
     "file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
MIN_RUN, COVERED = 4, 0.5
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
    "spans array<struct<label:string,first:long,last:long,coverage:double>>"
)

SPAN_FIELDS = ("label", "first", "last", "coverage")
SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _ids_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), APART)
    return word_hashes(data, starts, ends)


class Automaton:
    """Generalised suffix automaton over small integer words; each state knows every (template, end) of its runs."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, text in enumerate(texts):
            last = 0
            for i, c in enumerate(text):
                last = self._extend(last, c)
                ends.setdefault(last, []).append((k, i + 1))
        # where a run ends, its suffixes end too
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.places[state] += ends.get(state, [])
            if self.length[self.link[state]] >= 1:
                self.places[self.link[state]] += self.places[state]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def statistics(self, stream: list[int]) -> list[tuple[int, int]]:
        """Matching statistics: for each word, length and state of the longest run that ends there."""
        out, state, length = [], 0, 0
        follow, link, lengths = self.next, self.link, self.length
        for c in stream:
            while state > 0 and c not in follow[state]:
                state = link[state]
                length = lengths[state]
            if c in follow[state]:
                state, length = follow[state][c], length + 1
            out.append((length, state))
        return out

    def runs(self, stream: list[int], start: int) -> list[tuple[int, int, int, int]]:
        """Runs of MIN_RUN words or more that go on no further: (start, length, template, end in it), each place of each run."""
        found, seen = [], self.statistics(stream)
        for i, (length, state) in enumerate(seen):
            if length >= MIN_RUN and (i + 1 == len(seen) or seen[i + 1][0] <= length):
                found += [(start + i + 1 - length, length, k, end) for k, end in self.places[state]]
        return found


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.labels = [label for label, _ in templates]
        texts = [t.split() for _, t in templates]
        phrases = [p.split() for p in PHRASES]
        vocabulary = sorted({w for t in (*texts, *phrases) for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = _ids_of(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.sizes = [len(t) for t in texts]
        coded = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(coded)
        self.grams = np.unique(np.concatenate([self._grams(np.array(t)) for t in coded]))
        self.phrases = [([number[w] for w in p], label) for p, label in zip(phrases, PHRASES.values(), strict=True)]

    def _grams(self, code: np.ndarray) -> np.ndarray:
        """A number for each MIN_RUN words in a row; -1 where one is in no template."""
        n = max(0, len(code) - MIN_RUN + 1)
        parts = [code[k : k + n].astype(np.int64) for k in range(MIN_RUN)]
        out = np.zeros(n, np.int64)
        for part in parts:
            out = out * len(self.hashes) + part
        return np.where(np.min(parts, axis=0, initial=0) < 0, -1, out) if n else out

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1).astype(np.int32)

    def stretches(self, code: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Where runs of MIN_RUN words or more can be: (first word, one past the last), each within a text."""
        gram = self._grams(code)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = np.flatnonzero((self.grams[at] == gram) & (doc[: len(gram)] == doc[MIN_RUN - 1 :]))
        if not len(hit):
            return []
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(doc[hit]) != 0)) + 1
        return list(zip(hit[np.append(0, cut)].tolist(), (hit[np.append(cut - 1, len(hit) - 1)] + MIN_RUN).tolist(), strict=True))

    def chained(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, last word, coverage) that chains of runs cover.

        A chain's runs keep their order in text and template, within three template lengths. Of chains that share words the
        one with the larger coverage stays; labels that cover the same words alike stay both.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, k, end in runs:
            by.setdefault(k, []).append((start, length, end))
        found = []
        for k, own in by.items():
            size = self.sizes[k]
            done: list[tuple[int, int, int, int]] = []  # first word, end in the template, words covered, last word
            for start, length, end in sorted(own):
                done = [x for x in done if start + length - x[0] <= 3 * size]
                entry = (start, end, min(length, end), start + length - 1)
                for s, e, c, last in done:
                    news = min(length, end - e, start + length - 1 - last)
                    if news > 0 and start > s and start + length - s <= 3 * size and (c + news, s) > (entry[2], entry[0]):
                        entry = (s, end, c + news, start + length - 1)
                done = [x for x in done if not (entry[0] >= x[0] and entry[1] <= x[1] and entry[2] >= x[2] and entry[3] <= x[3])]
                done.append(entry)
                found.append((min(1.0, entry[2] / size), -size, self.labels[k], entry[0], entry[3]))
        kept: dict[tuple[int, int, float], set[str]] = {}
        starts: list[tuple[int, int]] = []  # of the spans kept, which are apart
        for coverage, _, label, first, last in sorted(found, key=lambda x: (-x[0], x[1], x[2:])):
            at = bisect_left(starts, (first, -1))
            if (first, last, coverage) in kept:
                kept[first, last, coverage].add(label)
            elif (at == 0 or starts[at - 1][1] < first) and (at == len(starts) or starts[at][0] > last):
                kept[first, last, coverage] = {label}
                starts.insert(at, (first, last))
        return sorted(((x, *span) for span, labels in kept.items() for x in labels), key=lambda x: (x[1], x[2], x[0]))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for rows, data, at in chunks(batches):
        low = LOWER[data]
        starts, ends, before = spans(low, at, APART)
        code = scanner.coded(word_hashes(low, starts, ends))
        n = np.diff(before)
        doc = np.repeat(np.arange(len(n)), n)
        places, kinds = [], []
        for words, label in scanner.phrases:
            m = len(words)
            hit = np.ones(max(0, len(code) - m + 1), bool)
            for k, w in enumerate(words):
                hit &= code[k : len(code) - m + 1 + k] == w
            hit = np.flatnonzero(hit)
            hit = hit[doc[hit] == doc[hit + m - 1]]
            places.append(hit)
            kinds += [label] * len(hit)
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        place, kinds = place[order], [kinds[i] for i in order]
        count = np.bincount(doc[place], minlength=len(n))
        first, last = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int64)
        last[doc[place]] = place - before[doc[place]]
        first[doc[place[::-1]]] = (place - before[doc[place]])[::-1]
        base: dict[int, set[str]] = {}
        for p, label in zip(doc[place].tolist(), kinds, strict=True):
            base.setdefault(p, set()).add(label)
        runs: dict[int, list] = {}
        for a, b in scanner.stretches(code, doc):
            own = int(doc[a])
            runs.setdefault(own, []).extend(scanner.automaton.runs(code[a:b].tolist(), a - int(before[own])))
        spans_of = [[dict(zip(SPAN_FIELDS, x, strict=True)) for x in scanner.chained(runs[i])] if i in runs else [] for i in range(len(n))]
        named = [sorted(base.get(i, ())) for i in range(len(n))]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(rows.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(count, pa.int64()),
                pa.array(first, pa.int64(), mask=first < 0), pa.array(last, pa.int64(), mask=last < 0),
                pa.array(named, pa.list_(pa.string())), pa.array(spans_of, pa.list_(SPAN)),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "spans"],
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base and spans of each row."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(scan, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    covered = F.transform(F.filter("spans", lambda x: x["coverage"] >= COVERED), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", covered)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
