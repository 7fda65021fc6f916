"""Operator 4: licences recognised by the sentences they are made of.

A text is cut into sentences; each is folded (A-Z in lower case, everything but
letters, digits and bytes beyond ASCII as blanks) and looked up among the known
licence sentences.  The identifiers found, in order, are then matched with the
licence rules: a rule is an ordered list of identifiers, with at most ``GAP``
other sentences between two of them.  Of overlapping matches the rule with
more sentences wins, then the earlier one, then the name.

Sentences are cut twice, since both wrapped texts and one-line notices occur:
at a full stop, exclamation or question mark, colon or semicolon before white
space and at empty lines; and at every line break besides.  Matches of either
reading count, the same place once.

Defined results: a null or empty text has no licence; null and repeated ids
keep their rows; an empty table gives none; other columns are ignored.  Whole
texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import lean, table

GAP = 2

#: Licence sentences by identifier, as the licences' published texts have them.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software:",
    "gpl3-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-or-later-1": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-or-later-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-form-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-form-2": "2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0.",
    "cc0": "Dedicated to the public domain under CC0 1.0.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: (licence, sentence identifiers in order)
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-or-later", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-or-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-or-later-1", "gpl2-or-later-2", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-or-later-1", "gpl2-or-later-2")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-or-later")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl-form-1", "mpl-form-2", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("Unlicense", ("unlicense-1",)),
)

_FOLD = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 59, 63]] = True  # ! . : ; ?

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("licences", T.ArrayType(T.StringType())),
        T.StructField("n_matches", T.LongType()),
        T.StructField("n_sentences", T.LongType()),
        T.StructField("matches", T.ArrayType(T.StringType())),
    ]
)


def sentences(data: np.ndarray, offs: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first byte, last byte) of every sentence with a word."""
    folded = _FOLD[data]
    starts, ends, doc = _text.words(folded, offs)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    h = _text.word_hashes(folded, starts, ends)
    after = np.append(data[1:], 32)
    cut = _STOP[data] & _WHITE[after]
    if lines:
        cut |= data == 10
    else:  # an empty line: two line breaks with white space alone between them
        ink = np.flatnonzero(~_WHITE[data])
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        gap = breaks[ink[1:]] - breaks[ink[:-1]] >= 2
        cut[ink[1:][gap] - 1] = True
    passed = np.concatenate([[0], np.cumsum(cut)])
    group = passed[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    rank = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    with np.errstate(over="ignore"):
        weight = _text.mix((rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        total = np.add.reduceat(h * weight, first)
    last = np.append(first[1:], len(starts)) - 1
    return _text.mix(total), doc[first], starts[first], ends[last]


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode() + b" ", np.uint8)
    h, *_ = _whole(raw)
    return int(h)


def _whole(raw: np.ndarray) -> tuple[np.uint64]:
    """The hash of a known sentence, taken as one whatever stops it holds."""
    folded = _FOLD[raw]
    starts, ends, _ = _text.words(folded, np.array([0, len(raw)]))
    h = _text.word_hashes(folded, starts, ends)
    with np.errstate(over="ignore"):
        weight = _text.mix((np.arange(len(h), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (_text.mix(np.array([(h * weight).sum(dtype=np.uint64)]))[0],)


def match(ids: list[str], at: list[int], rules=RULES, gap: int = GAP) -> list[tuple[int, int, str, int]]:
    """(first, last, licence, sentences) for known sentences ``ids`` that are the ``at``-th of their text."""
    found = []
    for licence, rule in rules:
        for k, name in enumerate(ids):
            if name != rule[0]:
                continue
            reached = {k}  # where the rule's sentences so far may end
            for want in rule[1:]:
                reached = {n for j in reached for n in range(j + 1, min(len(ids), j + gap + 2)) if ids[n] == want and at[n] - at[j] <= gap + 1}
            if reached:
                found.append((k, min(reached), licence, len(rule)))
    out, used = [], set()
    for k, j, licence, size in sorted(found, key=lambda f: (-f[3], f[0], f[2])):
        own = set(range(k, j + 1))
        if not own & used:
            used |= own
            out.append((k, j, licence, size))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its licences (sorted), matches as ``licence:start:end`` (UTF-8 bytes) and known sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {_hash(t): n for n, t in SENTENCES.items()}
        known = np.array(sorted(names), np.uint64)
        for batch in batches:
            data, offs = _text.buffers(batch.column("text"))
            for lo, hi in _text.slices(offs):
                n = hi - lo
                part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                places: list[set] = [set() for _ in range(n)]
                spans: list[set] = [set() for _ in range(n)]
                for lines in (False, True):
                    h, doc, first, last = sentences(part, own, lines)
                    hit = np.flatnonzero(np.isin(h, known))
                    start = np.searchsorted(doc, doc[hit])
                    for d in np.unique(doc[hit]):
                        mine = hit[doc[hit] == d]
                        ids = [names[int(h[k])] for k in mine]
                        spans[d] |= {(int(first[k] - own[d]), int(last[k] - own[d])) for k in mine}
                        base = int(start[np.searchsorted(doc[hit], d)])
                        for a, b, licence, _ in match(ids, [int(k) - base for k in mine]):
                            places[d].add((int(first[mine[a]] - own[d]), int(last[mine[b]] - own[d]), licence))
                rows = []
                for k in range(n):
                    # a short match inside a longer one of the other reading is the same place
                    kept = [p for p in places[k] if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in places[k])]
                    rows.append((sorted({p[2] for p in kept}), len(kept), len(spans[k]), [f"{c}:{a}:{b}" for a, b, c in sorted(kept)]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))],
                    names=SCHEMA.names,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_licences": op4_licences}
ORACLES: dict[str, str] = {}
