"""Licence notices found by patience alignment against templates.

Words (letters and digits, A-Z lower-cased) of a text are aligned with those of a template: words that are unique on
both sides are anchors, the longest increasing run of anchors is kept, and the gaps between them are
aligned in the same way; in a gap without anchors equal beginnings and ends still count. The share
of the template's words that are aligned is the coverage.

A template can mark the words that tell its licence from others, name and version, with braces. They must all be
aligned, neighbours among them as neighbours, and no other licence's name may stand in the span, unless "or" or
"and" parts it from the name.

A template is tried around each occurrence of its telling words (of its marked name, if it has one), and only in texts that have enough
of its words at all: coverage cannot exceed the share of the template's words that occur in the text,
so this loses nothing. All of it happens beside the text, without a shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, plain, slices, span_hashes, view, words

# Notices as their licences word them: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
    "MIT": "Released under the MIT License",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_LEADS = ("Licensed under", "Released under", "Distributed under", "Available under")
# What licences are called, by the name that is given for them; {#} stands for each version.
_CALLED = {
    "0BSD": ["the {Zero Clause BSD} License", "the {0BSD} License"],
    "AGPL": ["the {GNU Affero General Public} License", "the {GNU AGPL}"],
    "AGPL-3.0": ["the {GNU Affero General Public} License, version {3}", "the {GNU AGPL} version {3}", "the {GNU AGPLv3}", "the {AGPLv3}"],
    "Apache": ["the {Apache} License"],
    "Apache-#": ["the {Apache} License, Version {#}", "the {Apache #} License", "the {Apache} Software License, Version {#}"],
    "Artistic-#": ["the {Artistic} License {#}", "the {Artistic} License, version {#}"],
    "BSD": ["the {BSD} License"],
    "BSD-2-Clause": ["the {BSD 2 Clause} License", "the {2 Clause BSD} License", "the {Simplified BSD} License"],
    "BSD-3-Clause": ["the {BSD 3 Clause} License", "the {3 Clause BSD} License", "the {New BSD} License", "the {Revised BSD} License"],
    "BSD-4-Clause": ["the {BSD 4 Clause} License", "the {4 Clause BSD} License", "the {Original BSD} License"],
    "BSL-1.0": ["the {Boost} Software License, Version {1.0}"],
    "CC0-1.0": ["{CC0 1.0}", "the {CC0 1.0} Universal license", "the {Creative Commons Zero} License", "the {CC0} license"],
    "CDDL-#": ["the {Common Development and Distribution} License, Version {#}", "the {CDDL #}"],
    "EPL": ["the {Eclipse Public} License"],
    "EPL-#": ["the {Eclipse Public} License, Version {#}", "the {Eclipse Public} License {#}", "the {EPL #}"],
    "EUPL-#": ["the {European Union Public} Licence, version {#}", "the {EUPL #}"],
    "GFDL-#": ["the {GNU Free Documentation} License, Version {#}"],
    "GPL": ["the {GNU General Public} License", "the {GNU GPL}"],
    "GPL-1.0": ["the {GNU General Public} License, version {1}"],
    "GPL-2.0": ["the {GNU General Public} License, version {2}", "the {GNU GPL} version {2}", "the {GNU GPLv2}", "the {GPLv2}", "the {GPL} version {2}"],
    "GPL-3.0": ["the {GNU General Public} License, version {3}", "the {GNU GPL} version {3}", "the {GNU GPLv3}", "the {GPLv3}", "the {GPL} version {3}"],
    "ISC": ["the {ISC} License"],
    "LGPL": ["the {GNU Lesser General Public} License", "the {GNU LGPL}"],
    "LGPL-2.0": ["the {GNU Library General Public} License, version {2}"],
    "LGPL-2.1": ["the {GNU Lesser General Public} License, version {2.1}", "the {GNU LGPL} version {2.1}", "the {LGPL} version {2.1}"],
    "LGPL-3.0": ["the {GNU Lesser General Public} License, version {3}", "the {GNU LGPL} version {3}", "the {GNU LGPLv3}", "the {LGPLv3}"],
    "MIT": ["the {MIT} License"],
    "MIT-0": ["the {MIT No Attribution} License", "the {MIT 0} License"],
    "MPL": ["the {Mozilla Public} License"],
    "MPL-#": ["the {Mozilla Public} License, version {#}", "the {Mozilla Public} License {#}", "the {MPL #}"],
    "MS-PL": ["the {Microsoft Public} License"],
    "OFL-1.1": ["the {SIL Open Font} License, Version {1.1}"],
    "PSF-2.0": ["the {Python Software Foundation} License, version {2}"],
    "PostgreSQL": ["the {PostgreSQL} License"],
    "Unlicense": ["the {Unlicense}"],
    "WTFPL": ["the {WTFPL}"],
    "Zlib": ["the {zlib} License"],
}
_VERSIONS = {"Apache": ("1.0", "1.1", "2.0"), "Artistic": ("1.0", "2.0"), "CDDL": ("1.0", "1.1"), "EPL": ("1.0", "2.0"),
             "EUPL": ("1.1", "1.2"), "GFDL": ("1.1", "1.2", "1.3"), "MPL": ("1.0", "1.1", "2.0"), "CC": ("1.0", "2.0", "2.5", "3.0", "4.0")}
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-NC": "Attribution NonCommercial", "BY-ND": "Attribution NoDerivatives",
            "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}
_GNU = ("you can redistribute it and/or modify it under the terms of the {{GNU {0}}} License as published by the Free "
        "Software Foundation")
_BSD = ("{Redistribution} and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met")
_BSD_TWO = (_BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.")
_FREE = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"
# Longer wordings: file headers, whole short licences, and titles with the opening words of long ones.
_WORDED = {
    "AGPL-3.0-header": [f"This program is free software: {_GNU.format('Affero General Public')}, either version {{3}} of the License"],
    "AGPL-3.0-text": ["{GNU Affero General Public} License Version {3}, 19 November 2007 " + _FREE],
    "AGPL-header": ["This program is free software: " + _GNU.format("Affero General Public")],
    "Apache-2.0-header": [
        "Licensed under the {Apache} License, Version {2.0} (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "Apache-2.0-text": ["{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                        "REPRODUCTION, AND DISTRIBUTION"],
    "BSD-header": [_BSD],
    "BSD-2-Clause-text": [_BSD_TWO],
    "BSD-3-Clause-text": [_BSD_TWO + " 3. {Neither} the name of the copyright holder nor the names of its contributors may be used to "
                          "endorse or promote products derived from this software without specific prior written permission."],
    "BSD-4-Clause-text": [_BSD_TWO + " 3. All {advertising} materials mentioning features or use of this software must display the "
                          "following acknowledgement"],
    "BSL-1.0-text": ["{Boost} Software License Version {1.0} August 17th, 2003"],
    "EPL-2.0-text": ["{Eclipse Public} License v {2.0} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS {ECLIPSE PUBLIC} LICENSE"],
    "GPL-3.0": ["This work is licensed under the {GNU General Public} License, version {3}"],
    "GPL-2.0-header": [f"This program is free software; {_GNU.format('General Public')}; either version {{2}} of the License"],
    "GPL-2.0-text": ["{GNU General Public} License Version {2}, June 1991 " + _FREE],
    "GPL-3.0-header": [f"This program is free software: {_GNU.format('General Public')}, either version {{3}} of the License"],
    "GPL-3.0-text": ["{GNU General Public} License Version {3}, 29 June 2007 " + _FREE],
    "GPL-header": ["This program is free software: " + _GNU.format("General Public")],
    "ISC-text": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without {fee} is hereby "
                 "granted, provided that the above copyright notice and this permission notice {appear} in all copies"],
    "LGPL-2.1-header": [f"This library is free software; {_GNU.format('Lesser General Public')}; either version {{2.1}} of the License"],
    "LGPL-2.1-text": ["{GNU Lesser General Public} License Version {2.1}, February 1999 " + _FREE],
    "LGPL-3.0-header": [f"This program is free software: {_GNU.format('Lesser General Public')}, either version {{3}} of the License"],
    "LGPL-3.0-text": ["{GNU Lesser General Public} License Version {3}, 29 June 2007 " + _FREE],
    "LGPL-header": ["This library is free software; " + _GNU.format("Lesser General Public")],
    "MIT-header": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to {deal} in the Software without {restriction}"],
    "MPL-1.1-header": ["The contents of this file are subject to the {Mozilla Public} License Version {1.1} (the License)"],
    "MPL-2.0-header": ["This Source Code Form is subject to the terms of the {Mozilla Public} License, v. {2.0}"],
    "MPL-2.0-text": ["{Mozilla Public} License Version {2.0} 1. Definitions"],
    "Unlicense-text": ["This is free and {unencumbered} software released into the public domain"],
    "Zlib-text": ["This software is provided as-is, without any express or {implied} warranty. In no event will the authors be held {liable} "
                  "for any damages arising from the use of this software"],
}


def _notices() -> dict[str, tuple[str, ...]]:
    called = {}
    for name, wordings in _CALLED.items():
        for version in _VERSIONS[name[:-2]] if name.endswith("#") else [""]:
            called[name.replace("#", version)] = [w.replace("#", version) for w in wordings]
    for short, long in _COMMONS.items():
        called[f"CC-{short}"] = [f"{{CC {short}}}", f"a {{Creative Commons {long}}} License"]
        for version in _VERSIONS["CC"]:
            called[f"CC-{short}-{version}"] = [f"{{CC {short} {version}}}", f"a {{Creative Commons {long} {version}}} License",
                                               f"a {{Creative Commons {long} {version}}} International License"]
    out = {n: tuple(f"{lead} {w}" for w in wordings for lead in _LEADS) for n, wordings in called.items()}
    tagged = {n: (f"SPDX-License-Identifier: {{{n}}}",) for n in called if n not in ("AGPL", "Apache", "BSD", "EPL", "GPL", "LGPL", "MPL")}
    for name, wordings in [*tagged.items(), *_WORDED.items()]:
        out[name] = out.get(name, ()) + tuple(wordings)
    return out


# Every wording of the notices, with the telling words marked.
NOTICES = _notices()
# Words that name a licence: another one's inside a span tells against it.
NAMING = frozenset(w.encode() for w in (
    "0bsd advertising affero agpl agplv3 apache artistic boost bsd cc0 cddl clause eclipse epl eupl gfdl gnu gpl gplv2 gplv3 isc lesser lgpl "
    "lgplv3 library mit mozilla mpl nc nd noncommercial noderivatives noderivs original postgresql revised sa sharealike simplified sil "
    "unlicense wtfpl zlib").split())
_JOINS = frozenset([b"or", b"and"])
# Words too common to say where a notice may be; they still count in the alignment.
COMMON = frozenset("a an and any are as at be by can file for free from in is it may not of on or that the this to under use "
                   "version with without work you 0 2 3 4".split())
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_VERSION = re.compile(rb"v[0-9]+")


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(bytes(LOWER[np.frombuffer(text.encode(), np.uint8)]))


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of aligned positions, increasing on both sides."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            pairs.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        there, here = Counter(text[a:b]), Counter(template[c:d])
        place = {text[i]: i for i in range(a, b)}
        anchors = [(place[w], j) for j in range(c, d) if here[(w := template[j])] == 1 and there.get(w) == 1]
        run = _increasing(anchors)
        if not run:
            continue
        pairs += run
        left = [(a - 1, c - 1), *run]
        right = [*run, (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(left, right)]
    return sorted(pairs)


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run that increases on both sides (patience sorting); anchors come by template position."""
    tops: list[int] = []
    piles: list[tuple[int, int | None]] = []
    ends: list[int] = []
    for at, (i, _) in enumerate(anchors):
        pile = bisect.bisect_left(tops, i)
        piles.append((at, ends[pile - 1] if pile else None))
        if pile == len(tops):
            tops.append(i)
            ends.append(at)
        else:
            tops[pile], ends[pile] = i, at
    out, at = [], ends[-1] if ends else None
    while at is not None:
        out.append(anchors[at])
        at = piles[at][1]
    return out[::-1]


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    telling: frozenset[bytes]
    marks: tuple[int, ...] = ()

    @property
    def pivot(self) -> int:
        """The first marked word that is not a number."""
        return next((j for j in self.marks if not self.words[j].isdigit()), self.marks[0])


def prepare(templates: dict[str, str | tuple[str, ...]], common: frozenset[str] = COMMON) -> list[Template]:
    """Templates in name order, one for each wording; one with common words only uses all of them to find places."""
    out = []
    for name in sorted(templates):
        for wording in [templates[name]] if isinstance(templates[name], str) else templates[name]:
            found = tuple(tokens(wording))
            if not found:
                raise ValueError(f"the template {name} has no words")
            # Every second part between braces is marked.
            sides = [(w, i % 2) for i, part in enumerate(re.split("[{}]", wording)) for w in tokens(part)]
            telling = frozenset(w for w in found if w.decode() not in common) or frozenset(found)
            out.append(Template(name, found, telling, tuple(j for j, (_, marked) in enumerate(sides) if marked)))
    return out


def matches(text: list, templates: list[Template], least: float) -> list[tuple[int, int, str, float]]:
    """First word, end, name and coverage of each notice in a text's words. Of overlapping ones the one with
    more aligned words counts, then with the better coverage, the shorter, the earlier, the first name.
    Notices overlap if one of them has no marks, or if their stretches from first to last mark do."""
    found = []
    bare = [w[1:] if _VERSION.fullmatch(w) else w for w in text] if any(t.marks for t in templates) else text
    for template in templates:
        size = len(template.words)
        slack = size // 4 + 2
        for pairs in _marked(bare, template, slack) if template.marks else _aligned(text, template, slack):
            if len(pairs) >= least * size:
                at = {j: i for i, j in pairs}
                if not template.marks or _told(bare, template, at):
                    core = (at[template.marks[0]], at[template.marks[-1]] + 1) if template.marks else (-1, -1)
                    found.append((-len(pairs), -len(pairs) / size, pairs[-1][0] - pairs[0][0], pairs[0][0], template.name, core))
    taken: list[tuple[int, int]] = []
    cores: list[tuple[int, int]] = []
    chosen = []
    for _, coverage, length, first, name, core in sorted(set(found)):
        end = first + length + 1
        if core[0] < 0:
            # Whole spans of all that is chosen keep apart from one without marks.
            free = all(b <= first or end <= a for a, b, _, _ in chosen) if cores else _free(taken, first, end)
        else:
            free = _free(taken, first, end) and _free(cores, *core)
        if free:
            if core[0] < 0:
                bisect.insort(taken, (first, end))
            else:
                bisect.insort(cores, core)
            chosen.append((first, end, name, -coverage))
    return sorted(chosen)


def _free(taken: list[tuple[int, int]], first: int, end: int) -> bool:
    at = bisect.bisect_left(taken, (first, 0))
    return (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= first)


def _aligned(text: list, template: Template, slack: int):
    """The alignment at each place of a template without marks."""
    for start, end in _places(text, template, slack):
        pairs = align(text[start:end], list(template.words))
        yield _dense([(i + start, j) for i, j in pairs], len(template.words) + slack)


def _marked(text: list, template: Template, slack: int):
    """The alignment around each occurrence of a template's marked name."""
    words, j, size = list(template.words), template.pivot, len(template.words)
    for i, word in enumerate(text):
        if word == words[j]:
            start = max(0, i - j - slack)
            left = align(text[start:i], words[:j])
            right = align(text[i + 1:i - j + size + slack], words[j + 1:])
            pairs = [(a + start, b) for a, b in left] + [(i, j)] + [(a + i + 1, b + j + 1) for a, b in right]
            yield _dense(pairs, size + slack)


def _told(text: list, template: Template, at: dict[int, int]) -> bool:
    """Whether all marked words are aligned, neighbours as neighbours, and no other licence is named in the span."""
    marks = template.marks
    if not all(j in at for j in marks) or any(at[k] - at[j] != 1 for j, k in zip(marks, marks[1:]) if k == j + 1):
        return False
    low, high, own = at[marks[0]], at[marks[-1]], set(at.values())
    for i in range(min(own), max(own) + 1):
        if text[i] in NAMING and i not in own:
            between = text[i + 1:low] if i < low else text[high + 1:i] if i > high else []
            if not _JOINS.intersection(between):
                return False
    return True


def _places(text: list, template: Template, slack: int) -> list[tuple[int, int]]:
    """Where the template would lie if a telling word stood at its place, and ``slack`` words more on each side."""
    size = len(template.words)
    places = {w: [j for j, own in enumerate(template.words) if own == w] for w in template.telling}
    return sorted({(max(0, i - j - slack), min(len(text), i - j + size + slack))
                   for i, w in enumerate(text) if w in places for j in places[w]})


def _dense(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The longest stretch of pairs that spans no more than ``reach`` words of text."""
    best, low = (0, 0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= reach:
            low += 1
        # Of equally many pairs the tightest stretch.
        best = max(best, (high + 1 - low, pairs[low][0] - pairs[high][0], -low))
    return pairs[-best[2]:-best[2] + best[0]]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key and ``notices``, an array of (name, coverage, first_word, end_word) by place and name.

    Null and empty texts have none; repeated rows repeat. ``least`` is the coverage from which on a notice counts.
    ``templates`` gives one wording or several for each name; words in braces must be there (see ``NOTICES``).
    The default ``TEMPLATES`` marks none, so it goes by coverage alone.
    """
    prepared = prepare(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for t in prepared for w in t.words})
    # A version may be written v2 where a template has a marked 2.
    numbers = {b"v" + t.words[j] for t in prepared for j in t.marks if t.words[j].isdigit()}
    known_words = vocabulary + sorted(numbers.difference(vocabulary))
    schema = (f"_k {docs.schema[key].dataType.simpleString()}, "
              "notices array<struct<name:string,coverage:double,first_word:int,end_word:int>>")
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches):
        known = np.frombuffer(b"".join(known_words), np.uint8)
        ends = np.cumsum([len(w) for w in known_words])
        codes = span_hashes(known, ends - [len(w) for w in known_words], ends)
        order = np.argsort(codes)
        number = {w: i for i, w in enumerate(vocabulary)}
        column = np.array([number[w] if w in number else number[w[1:]] for w in known_words])
        needs = np.zeros((len(prepared), len(vocabulary)))
        marked = np.zeros((len(prepared), len(vocabulary)))
        for i, t in enumerate(prepared):
            for w in t.words:
                needs[i, number[w]] += 1
            marked[i, [number[t.words[j]] for j in t.marks]] = 1
        for batch in batches:
            out = []
            for part in slices(batch, "_t"):
                data, offsets = view(plain(part, "_t"))
                lower = LOWER[data]
                starts, stops, firsts = words(data, offsets, _INSIDE)
                hashes = span_hashes(lower, starts, stops)
                at = order[np.minimum(np.searchsorted(codes[order], hashes), len(codes) - 1)]
                hit = np.flatnonzero(codes[at] == hashes)
                here = np.zeros((len(offsets) - 1, len(vocabulary)))
                here[np.searchsorted(offsets, starts[hit], "right") - 1, column[at[hit]]] = 1
                # Each occurrence of a word in the template can be aligned if the text has the word.
                may = (here @ needs.T >= least * needs.sum(1)[None, :] - 1e-9) & (here @ marked.T >= marked.sum(1)[None, :])
                for i in range(len(offsets) - 1):
                    notices = []
                    if may[i].any():
                        own = _WORD.findall(bytes(lower[offsets[i]:offsets[i + 1]]))
                        notices = matches(own, [prepared[j] for j in np.flatnonzero(may[i])], least)
                    out.append([{"name": n, "coverage": c, "first_word": a, "end_word": b} for a, b, n, c in notices])
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(out, kind)], ["_k", "notices"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_k", key)


def names(notices: Column) -> Column:
    """The names of the notices, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(notices, lambda n: n["name"])))
