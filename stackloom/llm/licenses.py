"""License scans by conditional compression.

Candidate blocks: each template names words without which a block is another license; where one
of them stands in a text, a copy of the template lies so that this word has its place in it,
and the words that the copy can reach are a block for that template, across lines and
paragraphs. A template without such words is looked for by its longest words, so many that a
copy must hold one of them. A template is only tried on a block that holds enough of its words,
an exact bound.

Each block is compressed with zstandard alone and with its template as a raw dictionary. The
templates of one place are ranked by the bytes that they save on the block that holds all of
their blocks, so that one wording is measured for all. From the top down the winner is confirmed by the exact differences in wording: the words of template and block are aligned,
the share of the template's words found in order must be high, few other words may lie
between them, and the words that tell licenses apart must all be there. A template that saves
less than LEAST_SAVED of what it saves on its own text is no candidate. Of confirmed notices
that overlap the one that saves the most stays.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    license: str
    kind: str  # permissive, copyleft, noncommercial, noderivatives, public
    needs: tuple[str, ...]  # words without which a block is another license
    text: str


_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)

#: Public license notices.
TEMPLATES = (
    Template("MIT", "permissive", ("mit",), "Released under the MIT License."),
    Template("MIT", "permissive", ("mit",), "This software is licensed under the MIT License."),
    Template(
        "MIT",
        "permissive",
        ("permission", "sublicense", "noninfringement"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    Template("Apache-2.0", "permissive", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0."),
    Template(
        "Apache-2.0",
        "permissive",
        ("apache", "2.0"),
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied.",
    ),
    Template("GPL-3.0", "copyleft", ("general", "3"), "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "GPL-3.0",
        "copyleft",
        ("general", "3"),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("GPL-2.0", "copyleft", ("general", "2"), "This work is licensed under the GNU General Public License, version 2."),
    Template("LGPL-3.0", "copyleft", ("lesser", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("AGPL-3.0", "copyleft", ("affero", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("MPL-2.0", "copyleft", ("mozilla", "2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("BSD-3-Clause", "permissive", ("bsd", "3-clause"), "Licensed under the BSD 3-Clause License."),
    Template("BSD-2-Clause", "permissive", ("bsd", "2-clause"), "Licensed under the BSD 2-Clause License."),
    Template("CC-BY-4.0", "permissive", ("by", "4.0"), "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "permissive", ("attribution", "4.0"), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "copyleft", ("by-sa", "4.0"), "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-NC-4.0", "noncommercial", ("by-nc", "4.0"), "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-NC-SA-4.0", "noncommercial", ("by-nc-sa", "4.0"), "Licensed under CC BY-NC-SA 4.0."),
    Template("CC-BY-ND-4.0", "noderivatives", ("by-nd", "4.0"), "Licensed under CC BY-ND 4.0."),
    Template("CC0-1.0", "public", ("cc0", "1.0"), "Dedicated to the public domain under CC0 1.0."),
    Template("MIT", "permissive", ("mit",), "under the MIT License"),
    Template("MIT", "permissive", ("mit",), "under the terms of the MIT License"),
    Template("Apache-2.0", "permissive", ("apache", "2.0"), "under the Apache License, Version 2.0"),
    Template("Apache-2.0", "permissive", ("apache", "2.0"), "under the Apache License 2.0"),
    *(
        Template(name, "copyleft", needs, f"under the {title}, version {version}")
        for name, title, version, needs in (
            ("GPL-3.0", "GNU General Public License", "3", ("general", "3")),
            ("GPL-2.0", "GNU General Public License", "2", ("general", "2")),
            ("LGPL-3.0", "GNU Lesser General Public License", "3", ("lesser", "3")),
            ("LGPL-2.1", "GNU Lesser General Public License", "2.1", ("lesser", "2.1")),
            ("AGPL-3.0", "GNU Affero General Public License", "3", ("affero", "3")),
        )
    ),
    *(
        Template(
            name,
            "copyleft",
            needs,
            f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free "
            f"Software Foundation, either version {version} of the License, or (at your option) any later version.",
        )
        for name, work, title, version, needs in (
            ("GPL-2.0", "program", "GNU General Public License", "2", ("general", "2")),
            ("LGPL-3.0", "library", "GNU Lesser General Public License", "3", ("lesser", "3")),
            ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1", ("lesser", "2.1")),
            ("AGPL-3.0", "program", "GNU Affero General Public License", "3", ("affero", "3")),
        )
    ),
    Template("MPL-2.0", "copyleft", ("mozilla", "2.0"), "under the Mozilla Public License, version 2.0"),
    Template("BSD-3-Clause", "permissive", ("bsd", "3-clause"), "under the BSD 3-Clause License"),
    Template("BSD-2-Clause", "permissive", ("bsd", "2-clause"), "under the BSD 2-Clause License"),
    Template("BSD-3-Clause", "permissive", ("redistribution", "endorse", "disclaimer"), f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    Template("BSD-2-Clause", "permissive", ("redistribution", "disclaimer"), f"{_BSD_HEAD} {_BSD_TAIL}"),
    *(
        Template(name, kind, (part, "4.0"), f"licensed under a Creative Commons {part} 4.0 International License")
        for name, kind, part in (
            ("CC-BY-SA-4.0", "copyleft", "attribution-sharealike"),
            ("CC-BY-NC-4.0", "noncommercial", "attribution-noncommercial"),
            ("CC-BY-NC-SA-4.0", "noncommercial", "attribution-noncommercial-sharealike"),
            ("CC-BY-ND-4.0", "noderivatives", "attribution-noderivatives"),
        )
    ),
    *(
        Template(name, kind, (f"{name}{end}".lower(),), f"SPDX-License-Identifier: {name}{end}")
        for kind, ends, names in (
            ("permissive", ("",), ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-4.0")),
            ("noderivatives", ("",), ("CC-BY-ND-4.0",)),
            ("copyleft", ("", "-only", "-or-later"), ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")),
            ("copyleft", ("",), ("MPL-2.0", "CC-BY-SA-4.0")),
            ("noncommercial", ("",), ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0")),
            ("public", ("",), ("CC0-1.0",)),
        )
        for name in names
        for end in ends
    ),
)

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: A template is confirmed at this share of its words, and at most this share of other words inside.
FOUND, OTHER = 0.85, 0.25
#: Share of the bytes saved on a template's own text that it must save on a block.
LEAST_SAVED = 0.05
#: Other words in a copy from which on a template counts as long.
LONG = 64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def wording(template: list[str], block: list[str]) -> tuple[float, float, int, int]:
    """(share of the template's words in order, share of other words between them, first and
    last matched word of the block). Words matched far from the others, which make too many
    others lie between, do not count."""
    parts = [p for p in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if p.size]
    if not parts:
        return 0.0, 1.0, 0, 0
    while True:
        same = sum(p.size for p in parts)
        first, last = parts[0].b, parts[-1].b + parts[-1].size
        if len(parts) == 1 or same >= (1 - OTHER) * (last - first):
            return same / len(template), 1 - same / (last - first), first, last
        lead = (parts[1].b - parts[0].b - parts[0].size) / parts[0].size
        trail = (parts[-1].b - parts[-2].b - parts[-2].size) / parts[-1].size
        parts.pop(0 if lead > trail else -1)


def triggers_of(template: Template) -> set[str]:
    """Words of which every block that can be confirmed holds one: the longest of those that the
    template needs, or as many of its longest words as a copy cannot do without."""
    if template.needs:
        return {max(template.needs, key=len)}
    counts = Counter(words_of(template.text))
    found, left = set(), (1 - FOUND) * sum(counts.values())
    for word in sorted(counts, key=lambda w: (-len(w), w)):
        if left < 0:
            break
        found.add(word)
        left -= counts[word]
    return found


def trigger_pattern(templates: tuple[Template, ...]) -> str:
    """A pattern that every text with a candidate block matches."""
    words = sorted(set().union(*map(triggers_of, templates)))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])"


def templates_in(folder: str) -> tuple[Template, ...]:
    """Templates of the license texts in a folder of the driver, named by their files. They are shipped to
    the tasks with the scan, so a folder of some hundred texts is what this is for."""
    found = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path) and not os.path.islink(path):
            with open(path, encoding="utf-8", errors="replace") as file:
                found.append(Template(name, "text", (), file.read()))
    return tuple(t for t in found if words_of(t.text))


class Scanner:
    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.bags = [Counter(w) for w in self.words]
        #: Other words that a copy may hold, at most.
        self.slack = [math.ceil(len(w) / (1 - OTHER)) - len(w) for w in self.words]
        #: Trigger -> (template, place of the trigger in it).
        self.triggered: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(templates):
            triggers = triggers_of(t)
            for place, word in enumerate(self.words[i]):
                if word in triggers:
                    self.triggered.setdefault(word, []).append((i, place))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        raw = [zstandard.ZstdCompressionDict((" ".join(w) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False) for d in raw]
        self.own = [self.saved(w, i) for i, w in enumerate(self.words)]

    def saved(self, words: list[str], i: int) -> int:
        """Bytes of the compressed size of a block's words that template i saves."""
        data = " ".join(words).encode()
        return len(self.plain.compress(data)) - len(self.given[i].compress(data))

    def possible(self, i: int, bag: Counter) -> bool:
        """Whether words with these counts can confirm template i."""
        if any(w not in bag for w in self.templates[i].needs):
            return False
        return sum(min(n, bag[w]) for w, n in self.bags[i].items()) >= FOUND * len(self.words[i])

    def matches(self, i: int, words: list[str]) -> Iterator[tuple[float, float, int, int]]:
        """Wordings in a block that confirm template i, also left and right of each other."""
        open_ = [(0, len(words))]
        while open_:
            a, b = open_.pop()
            if not self.possible(i, Counter(words[a:b])):
                continue
            found, other, first, last = wording(self.words[i], words[a:b])
            if found < FOUND or other > OTHER:
                continue
            if set(self.templates[i].needs) <= set(words[a + first : a + last]):
                yield found, other, a + first, a + last
            open_ += [(a, a + first), (a + last, b)]

    def block(self, i: int, start: int, words: int) -> tuple[int, int]:
        """The words in which a copy of template i lies whose first word would be at start. Blocks of
        long templates start at multiples of a step, so that neighbours are one block."""
        slack = self.slack[i]
        a, b = start - slack, start + len(self.words[i]) + slack
        if slack >= LONG:
            a -= a % slack
            b = max(b, a + len(self.words[i]) + 3 * slack)
        return max(0, a), min(words, b)

    def candidates(self, own: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each place at which a trigger stands the (bytes saved, template, first word, end)
        of its blocks, from the best down; saved are bytes of the block that holds them all."""
        present, seen, places = set(own), {}, {}
        for at, word in enumerate(own):
            for i, place in self.triggered.get(word, ()):
                if not set(self.templates[i].needs) <= present:
                    continue
                a, b = self.block(i, at - place, len(own))
                if (i, a, b) not in seen:
                    block = own[a:b]
                    seen[i, a, b] = self.saved(block, i) if self.possible(i, Counter(block)) else -1
                    if seen[i, a, b] >= LEAST_SAVED * self.own[i]:
                        places.setdefault(at, []).append((seen[i, a, b], i, a, b))
        ranked: dict[tuple, list[tuple[int, int, int, int]]] = {}
        for found in places.values():
            key = tuple(sorted(x[1:] for x in found))
            if len(key) > 1 and key not in ranked:
                whole = own[min(a for _, a, _ in key) : max(b for *_, b in key)]
                found = [(self.saved(whole, i), i, a, b) for i, a, b in key]
            ranked.setdefault(key, sorted(found, key=lambda x: (-x[0], x[1])))
        return list(ranked.values())

    def scan(self, text: str) -> list[dict]:
        spans = [m.span() for m in _WORD.finditer(text.translate(_ASCII_LOWER))]
        own = [text[s:e].lower() for s, e in spans]
        rows: dict[tuple[str, int, int], dict] = {}
        for ranked in self.candidates(own):
            for saved, i, a, b in ranked:
                confirmed = list(self.matches(i, own[a:b]))
                for found, other, first, last in confirmed:
                    start, end = spans[a + first][0], spans[a + last - 1][1]
                    key = (self.templates[i].license, start, end)
                    if key not in rows or saved > rows[key]["saved"]:
                        rows[key] = {"license": self.templates[i].license, "kind": self.templates[i].kind, "start": start, "end": end, "saved": saved, "found": round(found, 6), "other": round(other, 6)}
                if confirmed:  # the winner of this place; those that save less are not asked
                    break
        kept: list[dict] = []
        for row in sorted(rows.values(), key=lambda r: (-r["saved"], -r["found"], r["other"], r["start"], r["license"])):
            if all(row["end"] <= k["start"] or row["start"] >= k["end"] for k in kept):
                kept.append(row)
        return sorted(kept, key=lambda r: r["start"])


_ROW = pa.schema([("license", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("found", pa.float64()), ("other", pa.float64())])


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, license, kind, start, end, saved, found, other): one row for each license notice.

    start and end are code points of the notice; saved are the bytes of its block's compressed
    size that the template as dictionary saves, found is the share of the template's words, other
    the share of other words between them. Documents without a notice, null and empty texts
    give no row. Ids may be null or repeated: each row is scanned alone. Extra columns are
    ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i, row) for i, text in enumerate(batch.column(1).to_pylist()) for row in scanner.scan(text)]
            found = pa.RecordBatch.from_pylist([r for _, r in rows], schema=_ROW)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), *found.columns], ["id", *found.schema.names])

    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(trigger_pattern(templates)))
    return rows.mapInArrow(scan, f"id {id_type}, license string, kind string, start long, end long, saved long, found double, other double").withColumnRenamed("id", id_col)
