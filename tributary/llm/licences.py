"""Licence scans: Dice coefficient over word bigrams against templates.

Templates are whole licences as they are distributed, their openings, and the
notices by which texts name a licence. Text is normalised: A-Z lower-cased, words ``[0-9a-z and non-ASCII]+``. A
passage is a line, or a run of lines between blank ones, or the whole text;
its word bigrams, as a set, are compared with each template's. Of templates
only those whose size lets the coefficient reach the threshold are compared:
2 min(a, b) / (a + b) bounds it. Passages are first reduced to their bigrams
that some template has, so passages without one cost nothing more.

Notices inside a longer line, or over lines among others, are found in windows:
spans of the text's bigrams, whatever its lines, that begin and end with one of
the template's. What a passage shares with the template it matches counts for no
window, nor does what a better window shares, so a notice counts once.

Defined results: null and empty texts match nothing; of equal coefficients the
template first in name order wins; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import FOLDED_VALUES, LETTERS_DIGITS, U64, Powers, blocks, byte_table, runs_of, small_batches

THRESHOLD = 0.8

#: Notices by which texts declare their licence.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Where the opening of a long licence ends, which texts quote on its own.
OPENINGS = {
    "Apache-2.0": "2. Grant of Copyright License.",
    "CC0-1.0": "2. Waiver.",
    "GPL-2.0": "TERMS AND CONDITIONS FOR COPYING",
    "GPL-3.0": "TERMS AND CONDITIONS",
    "LGPL-2.1": "TERMS AND CONDITIONS FOR COPYING",
    "MPL-2.0": "2. License Grants and Conditions",
}
END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> dict[str, list[str]]:
    """Licences as they are distributed, from the files beside this one, without the copyright line to be filled in; without what follows their terms; and their openings."""
    out = {}
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = re.sub(r"(?im)^copyright .*<.*>.*$", "", path.read_text("utf-8"))
        parts = [text, text.split(END)[0], text.split(OPENINGS[path.stem])[0] if path.stem in OPENINGS else text]
        out[path.stem] = list(dict.fromkeys(parts))
    return out


WHOLE = whole_texts()
TEMPLATES = {name: [*NOTICES.get(name, []), *WHOLE.get(name, [])] for name in sorted({*NOTICES, *WHOLE})}

LINE_BYTES = ~byte_table("\n")
FOUND = "doc_id long, n_matches long, licence string, dice double, passage string, licences array<string>"


def bigrams(text: str, powers: Powers) -> np.ndarray:
    """The distinct bigram hashes of a text, in order."""
    for _, _, block in blocks(pa.array([text], pa.large_string()), powers):
        starts, ends, firsts = block.words(LETTERS_DIGITS)
        return np.unique(runs_of(block.span_hash(block.prefix(FOLDED_VALUES), starts, ends), firsts, 2)[0])
    return np.zeros(0, U64)


class Templates:
    """Templates' bigram sets in order of size, and a filter for all of their bigrams."""

    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        powers, self.threshold = Powers(), threshold
        pairs = [(bigrams(text, powers), name) for name in sorted(templates) for text in templates[name]]
        self.sets = sorted((x for x in pairs if len(x[0])), key=lambda x: (len(x[0]), x[1]))
        self.sizes = np.array([len(s) for s, _ in self.sets], dtype=np.int64)
        self.known = np.unique(np.concatenate([s for s, _ in self.sets])) if self.sets else np.zeros(0, U64)
        self.holds = np.array([np.isin(self.known, s) for s, _ in self.sets]).reshape(len(self.sets), len(self.known)).T
        #: A span needs so many of a template's bigrams: 2 c / (d + a) >= t, and d >= c.
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.known & U64(0xFFFF)).astype(np.int64)] = True

    def is_known(self, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
            out[at] = self.known[place] == hashes[at]
        return out

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the templates that a text with these of their bigrams can match anywhere, in a passage or a window: no span has more of them than the text."""
        return np.flatnonzero(self.holds[np.searchsorted(self.known, np.unique(hashes))].sum(axis=0) >= self.least)

    def best(self, known: np.ndarray, size: int, likely: np.ndarray) -> tuple[float, str, int] | None:
        """Highest coefficient of a passage of so many distinct bigrams, of which known are some template's, and the template."""
        # 2 min(a, b) / (a + b) >= t: b between a t / (2 - t) and a (2 - t) / t.
        low, high = size * self.threshold / (2 - self.threshold), size * (2 - self.threshold) / self.threshold
        found = None
        for k in likely[np.searchsorted(likely, np.searchsorted(self.sizes, low - 1e-9)) : np.searchsorted(likely, np.searchsorted(self.sizes, high + 1e-9, side="right"))].tolist():
            own, name = self.sets[k]
            dice = 2.0 * len(np.intersect1d(known, own, assume_unique=True)) / (size + len(own))
            if dice >= self.threshold - 1e-12 and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name, k)
        return found

    def windows(self, hashes: np.ndarray, known: np.ndarray, taken: np.ndarray) -> list[tuple[float, str, int, int]]:
        """(coefficient, name, first, last) of spans of a text's bigrams that match, without bigrams that are taken; these are marked."""
        at = np.flatnonzero(known & ~taken)
        kinds = np.searchsorted(self.known, hashes[at])
        likely = self.likely(hashes[at])
        if not len(likely):
            return []
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        before, after = np.full(len(hashes), -1), np.full(len(hashes), len(hashes))
        before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
        spans = []
        for k in likely.tolist():
            size, most = len(self.sets[k][0]), self.sizes[k] * (2 - self.threshold) / self.threshold + 1e-9
            hit = np.zeros(len(hashes), dtype=bool)
            hit[at[self.holds[kinds, k]]] = True
            for first in np.flatnonzero(hit).tolist():
                # A span that holds its first bigram again is no better than what is left without the first.
                end, width = int(after[first]), int(most) + 1
                while True:
                    stop = min(end, first + width)
                    fresh = before[first:stop] < first
                    different = np.cumsum(fresh)
                    if stop == end or different[-1] > most:
                        break
                    width *= 2
                dice = 2.0 * np.cumsum(fresh & hit[first:stop]) / (different + size)
                last = int(np.argmax(dice))
                if dice[last] >= self.threshold - 1e-12:
                    spans.append((-float(dice[last]), self.sets[k][1], first, first + last, k))
        out = []
        for _, name, first, last, k in sorted(spans):
            own = np.isin(hashes[first : last + 1], self.sets[k][0])
            free = own & ~taken[first : last + 1]
            dice = 2.0 * len(np.unique(hashes[first : last + 1][free])) / (len(np.unique(hashes[first : last + 1])) + len(self.sets[k][0]))
            if dice >= self.threshold - 1e-12:
                taken[first : last + 1] |= own
                out.append((dice, name, first, last))
        return out


def passages(data: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Byte ranges of a text's lines, paragraphs of several lines, and the whole text."""
    text = data[start:end]
    breaks = np.flatnonzero(text == 10)
    begin, stop = np.append(0, breaks + 1) + start, np.append(breaks, len(text)) + start
    lines = [(b, e) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
    out, run = [], []
    for b, e in [*lines, (end, end)]:
        blank = not data[b:e].tobytes().strip()
        if not blank:
            out.append((b, e))
            run.append((b, e))
        elif run:
            if len(run) > 1:
                out.append((run[0][0], run[-1][1]))
            run = []
    return out if (start, end) in out else [*out, (start, end)]


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its matching passages, the best match, and all licences found."""
    known = Templates(templates, threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found: list[list[tuple[float, str, int, str]]] = [[] for _ in range(batch.num_rows)]
            for lo, _, block in blocks(batch.column(1), powers):
                starts, ends, firsts = block.words(LETTERS_DIGITS)
                hashes, at = runs_of(block.span_hash(block.prefix(FOLDED_VALUES), starts, ends), firsts, 2)
                place, last = starts[at], ends[at + 1] if len(at) else at
                some = known.is_known(hashes)
                rows = np.unique(np.searchsorted(block.offs, place[some], side="right") - 1)
                for row in rows.tolist():
                    left, right = np.searchsorted(place, block.offs[row : row + 2]).tolist()
                    likely = known.likely(hashes[left:right][some[left:right]])
                    if not len(likely):
                        continue
                    taken = np.zeros(right - left, dtype=bool)
                    for b, e in passages(block.data, int(block.offs[row]), int(block.offs[row + 1])):
                        i, j = int(np.searchsorted(place, b)), int(np.searchsorted(last, e, side="right"))
                        own = some[i:j]
                        if not own.any():
                            continue
                        hits = np.unique(hashes[i:j][own])
                        # Bounds first: a passage has at least as many bigrams as it shares, and no more than its words.
                        if 2 * len(hits) < known.threshold * (len(hits) + known.sizes[0]):
                            continue
                        match = known.best(hits, len(np.unique(hashes[i:j])), likely)
                        if match:
                            found[lo + row].append((-match[0], match[1], b, block.text(b, e)))
                            taken[i - left : j - left] |= np.isin(hashes[i:j], known.sets[match[2]][0])
                    for coefficient, name, i, j in known.windows(hashes[left:right], some[left:right], taken):
                        b, e = int(place[left + i]), int(last[left + j])
                        found[lo + row].append((-coefficient, name, b, block.text(b, e)))
            best = [min(x) if x else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x and x[1] for x in best], pa.string()),
                    pa.array([x and -x[0] for x in best], pa.float64()),
                    pa.array([x and x[3] for x in best], pa.string()),
                    pa.array([sorted({m[1] for m in x}) for x in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_matches", "licence", "dice", "passage", "licences"],
            )

    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(scan, FOUND)
