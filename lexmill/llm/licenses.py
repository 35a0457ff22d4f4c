"""Licences of files: TF-IDF cosine of their lines to template statements, then inheritance along paths.

Every line of every whole text is weighed against the templates, as sparse vectors. A word's weight is its count times
the logarithm of its rarity among all lines of the corpus; words outside the templates' vocabulary weigh as the rarest.
Statements, headers and whole texts are also blocks: runs of as many words, over any line breaks, are weighed against them where four words in a
row agree. A file with a statement that is none of these has an unknown licence. A file
without a statement of its own takes that of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .runtime import written

#: Statements by which a file names its licence. Fixed values.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This software is provided under the MIT license", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
}
for _name, _short, _long in (("BY", "BY", "Attribution"), ("BY-NC", "BY-NC", "Attribution-NonCommercial"), ("BY-SA", "BY-SA", "Attribution-ShareAlike"), ("BY-ND", "BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES.setdefault(f"CC-{_name}-{_version}", []).extend([
            f"Licensed under CC {_short} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_port} License.",
            f"SPDX-License-Identifier: CC-{_name}-{_version}",
        ])
for _name, _said, _version in (("GPL-3.0", "General", 3), ("GPL-2.0", "General", 2), ("LGPL-3.0", "Lesser General", 3), ("LGPL-2.1", "Lesser General", "2.1"), ("AGPL-3.0", "Affero General", 3)):
    TEMPLATES.setdefault(_name, []).extend([
        f"This work is licensed under the GNU {_said} Public License, version {_version}.", f"Licensed under the {_name}.",
        f"SPDX-License-Identifier: {_name}-only", f"SPDX-License-Identifier: {_name}-or-later",
    ])
for _name, _said in (("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0 1.0 Universal"), ("EPL-2.0", "Eclipse Public License 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0")):
    TEMPLATES.setdefault(_name, []).extend([f"Licensed under the {_said}.", f"SPDX-License-Identifier: {_name}"])

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License
along with this program. If not, see <https://www.gnu.org/licenses/>."""
_TITLE = """GNU {0} PUBLIC LICENSE Version {1}, {2} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and
distribute verbatim copies of this license document, but changing it is not allowed."""
#: Standard headers, and whole texts or, of the longest licences, their beginnings. Fixed values.
BLOCKS = {
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""],
    "BSD-2-Clause": [_BSD + _AS_IS],
    "BSD-3-Clause": [_BSD + _THIRD + _AS_IS],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    "Unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""],
    "GPL-3.0": [_GNU.format("General", "3"), _TITLE.format("GENERAL", "3", "29 June 2007")],
    "GPL-2.0": [_GNU.format("General", "2"), _TITLE.format("GENERAL", "2", "June 1991")],
    "LGPL-3.0": [_GNU.format("Lesser General", "3"), _TITLE.format("LESSER GENERAL", "3", "29 June 2007")],
    "LGPL-2.1": [_GNU.format("Lesser General", "2.1"), _TITLE.format("LESSER GENERAL", "2.1", "February 1999")],
    "AGPL-3.0": [_GNU.format("Affero General", "3"), _TITLE.format("AFFERO GENERAL", "3", "19 November 2007")],
}
GRAM = 4
SALTS = 16
#: What looks like a statement on a licence, known or not (RE2).
STATEMENT = r"(?i)licen[sc]ed\s+under\s|spdx-license-identifier|(released|distributed|available|provided|subject)\s+(under|to)\s[^\n]{0,80}\blicen[sc]e\b"
UNKNOWN = "unknown"
LEAST_COSINE = 0.8
#: Names of files that speak for their directory and all below it.
LICENCE_FILE = r"(?i)(?:^|/)(licen[cs]e|copying|unlicense|notice)([.\-_][^/]*)?$"
#: What has a word (RE2).
WORDED = r"[0-9A-Za-z]|[^\x00-\x7f]"

#: Words are runs of ASCII letters and digits and of bytes over 127.
BREAKS = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def words_of_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line number of every word, and the number of each text's first line (with the count at the end)."""
    data, offsets = A.utf8(column)
    data = A.lower_ascii(data)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    first = breaks[offsets] + np.arange(len(offsets))  # a text has a line more than it has line breaks
    starts, ends, _ = A.word_spans(np.where(BREAKS[data], np.uint8(32), data), offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    return A.word_hashes(data, starts, ends), breaks[starts] + text, first


class Templates:
    """The templates' vocabulary and, with the corpus counts of its words, their unit vectors."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [name for name, texts in templates.items() for _ in texts]
        hashes, line, _ = words_of_lines(pa.array([re.sub(r"\s+", " ", t) for texts in templates.values() for t in texts]))
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        self.counts = np.zeros((len(self.names), len(self.vocabulary)))
        np.add.at(self.counts, (line, code), 1)
        self.words = np.bincount(line, minlength=len(self.names))
        # grams of single templates, and where they begin in them
        at = np.arange(max(0, len(line) - GRAM + 1))
        at = at[line[at] == line[at + GRAM - 1]]
        grams = A.gram_hashes(hashes, GRAM)[at] if len(at) else np.zeros(0, A.U64)
        order = np.argsort(grams, kind="stable")
        begins = np.searchsorted(line, np.arange(len(self.names)))
        self.grams, self.gram_of, self.gram_at = grams[order], line[at][order], (at - begins[line[at]])[order]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.flatnonzero(self.vocabulary[at] == hashes), at

    def weigh(self, lines: int, having: np.ndarray) -> Templates:
        self.rarity = np.log((1 + lines) / (1 + having)) + 1
        self.rarest = np.log(1 + lines) + 1
        vectors = self.counts * self.rarity
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        # by word: the templates that have it, and its weight in them
        word, self.post_template = np.nonzero(self.vectors.T)
        self.post_value = self.vectors[self.post_template, word]
        self.post_first = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))
        return self


def line_counts(files: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """How many lines there are, and how many have each word of the vocabulary: as many numbers as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary) + 1, np.int64)
        for batch in A.slices(batches):
            hashes, line, first = words_of_lines(batch.column("text"))
            hit, at = templates.hits(hashes)
            pairs = np.unique(line[hit] * len(templates.vocabulary) + at[hit])
            total[:-1] += np.bincount(pairs % len(templates.vocabulary), minlength=len(templates.vocabulary))
            total[-1] += first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["word", "lines"])

    rows = files.select("text").mapInArrow(count, "word int, lines long").groupBy("word").agg(F.sum("lines").alias("lines")).collect()
    out = np.zeros(len(templates.vocabulary) + 1, np.int64)
    for row in rows:
        out[row["word"]] = row["lines"]
    return int(out[-1]), out[:-1]


def best_lines(words_found: tuple, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the greatest cosine of a line with a template, that template, and the line; the first of equals."""
    hashes, line, first = words_found
    hit, at = t.hits(hashes)
    n, size = len(first) - 1, len(t.vocabulary)
    score, template, where = np.zeros(n), np.full(n, -1), np.full(n, -1)
    # a line without two words of the vocabulary is no statement
    some, code = np.unique(line[hit], return_inverse=True)
    enough = np.bincount(code, minlength=len(some)) > 1
    some = some[enough]
    if not len(some):
        return score, template, where
    kept = enough[code]
    # sparse vectors: (line, word) entries with their counts
    cells, count = np.unique(np.searchsorted(some, line[hit][kept]) * size + at[hit][kept], return_counts=True)
    row, word = np.divmod(cells, size)
    value = count * t.rarity[word]
    other = np.bincount(line, minlength=int(first[-1]))[some] - np.bincount(row, weights=count, minlength=len(some))
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(some)) + other * t.rarest**2)
    # each entry meets the templates that have its word
    many = t.post_first[word + 1] - t.post_first[word]
    entry = np.repeat(np.arange(len(word)), many)
    post = A.spread(t.post_first[word], many)
    width = len(t.names)
    dots = np.bincount(row[entry] * width + t.post_template[post], weights=value[entry] * t.post_value[post], minlength=len(some) * width)
    cosine = dots.reshape(len(some), width) / norm[:, None]
    text, best = np.searchsorted(first, some, "right") - 1, cosine.max(1)
    order = np.lexsort((some, -best, text))
    order = order[np.flatnonzero(np.diff(text[order], prepend=-1))]  # the best line of each text
    score[text[order]], template[text[order]], where[text[order]] = best[order], cosine[order].argmax(1), some[order] - first[text[order]]
    return score, template, where


def best_blocks(words_found: tuple, t: Templates, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the cosine, block and first line of the run of words that agrees with most of a block; 0 if none
    has a cosine of ``least``."""
    hashes, line, first = words_found
    n = len(first) - 1
    score, block, where, most = np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n)
    grams = A.gram_hashes(hashes, GRAM)
    low = np.searchsorted(t.grams, grams)
    hit = np.flatnonzero(t.grams[np.minimum(low, len(t.grams) - 1)] == grams)
    if not len(hit):
        return score, block, where
    low = low[hit]
    many = np.searchsorted(t.grams, grams[hit], "right") - low
    entry = A.spread(low, many)
    start = np.repeat(hit, many) - t.gram_at[entry]
    text = np.searchsorted(first, line[np.repeat(hit, many)], "right") - 1
    bounds = np.searchsorted(line, first)  # each text's first word, and the end
    for x, k, at in np.unique(np.stack([text, t.gram_of[entry], start], 1), axis=0).tolist():
        # as many words as the block has, or some more, for what was put in
        for extra in {0, t.words[k] // 6}:
            i, j = max(at, bounds[x]), min(at + t.words[k] + extra, bounds[x + 1])
            if j - i < GRAM:
                continue
            known, code = t.hits(hashes[i:j])
            run = np.bincount(code[known], minlength=len(t.vocabulary)) * t.rarity
            cosine = run @ t.vectors[k] / np.sqrt((run**2).sum() + (j - i - len(known)) * t.rarest**2)
            worth = cosine**4 * t.words[k]
            if cosine >= least and worth > most[x]:
                score[x], block[x], where[x], most[x] = cosine, k, line[i] - first[x], worth
    return score, block, where


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST_COSINE, carry: Sequence[str] = ()) -> DataFrame:
    """path, own_licence, cosine and line of the best statement, licence and licence_from for every file.

    files: path and text. ``licence`` is the file's own, else that of the nearest licence file (by name, with a
    statement of its own) in its directory or one above it, the least path of several in one directory;
    A block counts before a line; a statement that is not recognised makes the licence ``unknown``, as do
    any words of a licence file in which nothing is recognised.
    ``licence_from`` is the path of the file that states it. A null or empty text states nothing; a null path has
    no directories. Repeated paths keep their rows. Of other columns those of ``carry`` come along; an empty table gives
    no rows.
    """
    carried = [f"_carry_{i}" for i in range(len(carry))]
    names_of = ["path", "own_licence", "cosine", "line", *carried]
    files = files.select("path", "text", *(F.col(c).alias(x) for c, x in zip(carry, carried)))
    # statements may be broken over lines too, so they are blocks as well
    runs = {n: [*templates.get(n, []), *BLOCKS.get(n, [])] for n in dict.fromkeys([*templates, *BLOCKS])}
    t, blocks = Templates(templates), Templates(runs)
    every = Templates({"": [x for source in (templates, BLOCKS) for texts in source.values() for x in texts]})
    total, having = line_counts(files, every)
    for some in (t, blocks):
        some.weigh(total, having[np.searchsorted(every.vocabulary, some.vocabulary)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            found = words_of_lines(batch.column("text"))
            score, template, where = best_lines(found, t)
            stated = score >= least
            names = [t.names[k] if s else None for k, s in zip(template.tolist(), stated.tolist())]
            high, block, begin = best_blocks(found, blocks, least)
            for x in np.flatnonzero(block >= 0):
                score[x], where[x], stated[x], names[x] = high[x], begin[x], True, blocks.names[block[x]]
            meets = lambda column, pattern: pc.match_substring_regex(batch.column(column), pattern).to_pylist()
            looks, is_file, worded = meets("text", STATEMENT), meets("path", LICENCE_FILE), meets("text", WORDED)
            names = [UNKNOWN if name is None and (look or file and words) else name for name, look, file, words in zip(names, looks, is_file, worded)]
            lines = pa.array([x if s else None for x, s in zip(where.tolist(), stated.tolist())], pa.int64())
            rows = [batch.column("path"), pa.array(names, pa.string()), pa.array(np.round(score, 6)), lines, *(batch.column(x) for x in carried)]
            yield pa.RecordBatch.from_arrays(rows, names_of)

    kinds = "".join(f", {x} {files.schema[x].dataType.simpleString()}" for x in carried)
    found = written(files.mapInArrow(run, "path string, own_licence string, cosine double, line long" + kinds), "licences")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    found = found.withColumn("folder", folder)
    speakers = found.where(F.col("own_licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    speakers = speakers.groupBy("folder").agg(F.min(F.struct("path", "own_licence")).alias("speaker"))

    # every directory once, with itself and all directories above it; the root is the empty path
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    folders = found.where("path IS NOT NULL").select("folder").distinct().select("folder", F.inline(above)).distinct()
    nearest = (
        folders.join(speakers.withColumnRenamed("folder", "up"), "up")
        .groupBy("folder")
        .agg(F.max_by("speaker", F.struct("depth", F.length("up"))).alias("speaker"))
    )
    # a folder of any size is spread over its salts
    salts = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salts, ["folder", "salt"], "left").select(
        *(F.col(x).alias(c) for c, x in zip(carry, carried)), "path", "own_licence", "cosine", "line",
        F.coalesce("own_licence", "speaker.own_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("speaker.path")).alias("licence_from"),
    )
