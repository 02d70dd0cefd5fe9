"""Licence scan: a positional index of rare licence words, joined with each file by relative position."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import table, worker_of
from spreadloom.llm.tokens import texts

# Phrases that count wherever their words stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices and opening sentences, and the phrases that must stand in a match.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc0", "dedicated to the public domain under creative commons zero cc0 1 0 universal", ["public domain"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

# Whole licence texts, as words without their copyright lines, and the phrases that must stand in a match.
TEMPLATES += [
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        ["associated documentation files", "substantial portions of the software"],
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["for any purpose with or without fee", "appear in all copies"],
    ),
    (
        "bsd-3-clause-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["redistribution and use in source and binary forms", "neither the name"],
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
        ["altered source versions must be plainly marked"],
    ),
    (
        "bsl-1.0-text",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
        "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
        "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        ["machine executable object code generated by a source language processor"],
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["free and unencumbered software", "act of relinquishment in perpetuity"],
    ),
]

#: Lower case for A-Z, a space for each ASCII byte that is no digit or letter; bytes of other characters are word bytes.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


#: Bytes of a text whose words are laid out at a time.
PIECE = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def pieces_of(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, those of about `size` bytes at a time; a text has one piece at least."""
    low, at = text.translate(TABLE), 0
    while True:
        end = low.find(b" ", at + size)
        if end < 0:
            yield low[at:].split()
            return
        yield low[at:end].split()
        at = end


def slack_of(length: int) -> int:
    """Words by which the parts of a long template may stand apart from their places: one in 24, none below 48 words."""
    return length // 24 if length >= 48 else 0


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents of the whole table that hold each word of the templates. Counted per batch before they are shuffled;
    what reaches the driver is one number per template word."""
    vocabulary = frozenset(w.encode() for w in VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("licences")
        total: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                total.update(vocabulary.intersection(words_of(t.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


class LicenseIndex:
    """Postings (template, position) of the rarest words of each template: half of its words, 8 at most, or an eighth of a
    whole licence text."""

    def __init__(self, frequency: dict[str, int]):
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in TEMPLATES]
        rank = {w.encode(): (frequency.get(w, 0), w) for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=rank.__getitem__)[: min(max(8, len(words) // 8), (len(words) + 1) // 2)]
            places = [(w, i) for i, w in enumerate(words) if w in rare]
            self.anchors.append(len(places))
            for w, i in places:
                self.postings[w].append((t, i))
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]
        self.wanted = frozenset(self.postings) | {p[0] for p, _ in self.base}
        self.slack = [slack_of(len(words)) for _, words, _ in self.templates]
        self.tail = max(len(words) + slack_of(len(words)) for _, words, _ in self.templates) + 8

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, int]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches of one whole text."""
        return self.report(text)[:8]

    def report(self, text: bytes, piece: int = PIECE) -> tuple[int, int, int | None, int | None, str, str, float, int, int]:
        """What scan() gives, and n_licence_words.

        The text is read in pieces of `piece` bytes; each is laid out with the 8 words before it and the longest template's
        words after it, so the result does not depend on the pieces."""
        total, base, labels, best, matches, covered, first, last, n_base = 0, set(), set(), 0.0, 0, 0, None, None, 0
        words, offset, low = [], 0, None  # words laid out, the number of the first, the first start not yet looked at
        settled = [-(1 << 60)] * len(self.templates)  # starts up to here belong to a match of the template
        end_covered = 0
        spans: list[tuple[int, int]] = []
        rest = pieces_of(text, piece)
        chunk = next(rest)
        while chunk is not None:
            after = next(rest, None)
            words += chunk
            total += len(chunk)
            high = total if after is None else total - self.tail
            lowest = offset if low is None else low
            at: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(words, offset):
                if w in self.wanted:
                    at[w].append(i)
            for phrase, label in self.base:
                hits = [i for i in at.get(phrase[0], ()) if lowest <= i < high and words[i - offset : i - offset + len(phrase)] == phrase]
                if hits:
                    base.add(label)
                    n_base += len(hits)
                    first, last = min(hits[0], hits[0] if first is None else first), max(hits[-1], -1 if last is None else last)
            # Every indexed word of the file votes; postings meet where the relative position agrees, but for the slack.
            votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for w, found in at.items():
                for t, p in self.postings.get(w, ()):
                    votes[t] += [(i - p, p) for i in found if (low is None or i - p >= low) and i - p < high + self.slack[t]]
            for t, cast in votes.items():
                if 2 * len(cast) < self.anchors[t] or len(cast) < 2:
                    continue
                label, template, phrases = self.templates[t]
                cast.sort()
                ahead, there = 0, Counter()
                for k, (start, p) in enumerate(cast):
                    while ahead < len(cast) and cast[ahead][0] <= start + self.slack[t]:
                        there[cast[ahead][1]] += 1
                        ahead += 1
                    n = len(there)
                    if start < high and start > settled[t] and n >= 2 and 2 * n >= self.anchors[t]:
                        window = words[max(0, start - 4 - offset) : max(0, start + self.slack[t] + len(template) + 4 - offset)]
                        if all(any(window[j : j + len(q)] == q for j in range(len(window) - len(q) + 1)) for q in phrases):
                            labels.add(label)
                            matches += 1
                            best = max(best, n / self.anchors[t])
                            settled[t] = start + self.slack[t]
                            at_most = Counter(v for v, _ in cast[k:ahead]).most_common(1)[0][0]
                            spans.append((max(0, at_most), at_most + len(template)))
                    there[p] -= 1
                    if not there[p]:
                        del there[p]
            low = high
            keep = max(offset, high - 8)
            words, offset = words[keep - offset :], keep
            chunk = after
        for start, end in sorted(spans):
            end = min(end, total)
            covered += max(0, end - max(start, end_covered))
            end_covered = max(end_covered, end)
        score = max(best, 0.5 if base else 0.0)
        return total, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, matches, covered


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_matches long, n_licence_words long"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and LicenseIndex.report's columns, over whole texts; other columns are ignored.

    Two scans without a shuffle of text: document frequencies over all documents choose the index, then each file is
    looked up. A null or empty text has no words, no label, score 0. Score: 0 without a label, 0.5 for a base phrase
    alone, else the best share of a template's indexed words that agree in position. n_licence_words counts the words that lie
    in matched templates. An empty table gives no rows. Rows that share a doc_id are scanned each for itself; a very long
    text is laid out about PIECE bytes at a time.
    """
    index = LicenseIndex(document_frequencies(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("licences")
        for b in batches:
            found = [index.report(t.as_py() or b"") for t in b.column("text")]
            if found:
                n, base, first, last, base_labels, labels, score, matches, covered = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, base, first, last)), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64()), pa.array(matches, pa.int64()), pa.array(covered, pa.int64())], names=[c.split()[0] for c in SCAN.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, SCAN)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
