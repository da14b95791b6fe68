"""License scans: templates retrieved by MinHash bands, verified exactly.

Texts and templates are sequences of words (runs of letters and digits, lower
case) and of shingles of ``SHINGLE`` words. A template is cut into *segments* of
W consecutive shingles, W the largest of 1, 2, 4, 8 that fits it; a text is
covered by a window of W shingles at every position. Where a text quotes a
template, some window is the segment, word for word or nearly.

Windows and segments are retrieved by ``BANDS`` bands of ``ROWS`` minimal
hashes. Two sets of similarity s share a band with probability
1 - (1 - s^2)^8: 1 for equal ones, 0.996 at 0.7, 0.90 at 0.5, and a template of
more than one segment has as many chances. A retrieved place counts only if at
least ``containment`` of the template's shingles lie in the text there.

All windows of a batch of texts are hashed at once: word hashes are differences
of prefix polynomials, and minima over windows come from doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm import tokens
from histoloom.llm.license_texts import WHOLE

SHINGLE, BANDS, ROWS = 3, 8, 2
#: Bits of a key that are looked up before the key itself.
_FILTER = 18
WINDOWS = (1, 2, 4, 8)

# Wording of public license notices.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT (line)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "All rights reserved": "All rights reserved.",
}

_FREE = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License {}"
_LATER = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_ONLY = "version {} as published by the Free Software Foundation."

#: Notices that licenses ask for at the head of files, and short whole texts.
#: Names are SPDX identifiers, with what tells two texts of one license apart.
NOTICES = {
    "BSD": TEMPLATES["BSD-3-Clause"],
    **{f"GPL-{v}.0{k}": _FREE.format("program", "", form.format(v)) for v in "123" for k, form in (("", _LATER), (" (only)", _ONLY))},
    **{f"AGPL-3.0{k}": _FREE.format("program", "Affero ", form.format(3)) for k, form in (("", _LATER), (" (only)", _ONLY))},
    **{f"LGPL-{v if '.' in v else v + '.0'}{k}": _FREE.format("library", "Lesser ", form.format(v)) for v in ("2.1", "3") for k, form in (("", _LATER), (" (only)", _ONLY))},
    "LGPL-2.0": _FREE.format("library", "Library ", _LATER.format(2)),
    "MPL-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-0 (whole)": WHOLE["MIT"].replace(WHOLE["MIT"][WHOLE["MIT"].index(", subject to the following") : WHOLE["MIT"].index('THE SOFTWARE IS PROVIDED')], ". "),
    "0BSD (whole)": WHOLE["ISC"].replace(WHOLE["ISC"][WHOLE["ISC"].index(", provided that") : WHOLE["ISC"].index("THE SOFTWARE IS PROVIDED")], ". "),
}


def _spoken(names: list[str], versions: list[str]) -> list[str]:
    """How a license of one of these names and versions is referred to."""
    return [form.format(n, v) for n in names for v in versions for form in ("{}, version {}", "{} v{}", "{} {}", "{1} {0}")]


def _gnu(kind: str, short: str, versions: list[str]) -> list[str]:
    return _spoken([f"GNU {kind}General Public License".replace("  ", " "), f"GNU {short}", short], versions) + [f"{gnu}{short}v{v}" for gnu in ("", "GNU ") for v in versions]


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Names that follow "under the", "terms of the" and the like in a line.
SPOKEN = {
    "Apache-2.0": [*_spoken(["Apache License", "Apache Software License"], ["2.0", "2"]), "Apache 2.0 License", "Apache 2 License"],
    "MIT": ["MIT License", "Expat License", "MIT/X11 License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Two-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "Three-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD": ["BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": _gnu("", "GPL", ["2", "2.0"]),
    "GPL-3.0": _gnu("", "GPL", ["3", "3.0"]),
    "AGPL-3.0": _gnu("Affero ", "AGPL", ["3", "3.0"]),
    "LGPL-2.0": _spoken(["GNU Library General Public License"], ["2", "2.0"]),
    "LGPL-2.1": _gnu("Lesser ", "LGPL", ["2.1"]),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", ["3", "3.0"]),
    **{f"MPL-{v}": _spoken(["Mozilla Public License", "MPL"], [v]) for v in ("1.1", "2.0")},
    **{f"EPL-{v}": _spoken(["Eclipse Public License", "EPL"], [v]) for v in ("1.0", "2.0")},
    "BSL-1.0": [*_spoken(["Boost Software License"], ["1.0"]), "Boost License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense License", "The Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0", "Creative Commons CC0 1.0"],
    **{f"CC-{k}-{v}": [f"CC {k} {v}", *(f"Creative Commons {kind} {x} License" for x in (v, f"{v} International", f"{v} Unported"))] for v in ("3.0", "4.0") for k, kind in _CC.items()},
}


def _lines() -> dict[str, str]:
    out = {}
    for spdx, names in SPOKEN.items():
        out[f"{spdx} (identifier)"] = f"SPDX-License-Identifier: {spdx}"
        for name in names:
            for before in ("under", "under the", "under a", "terms of the"):
                line = f"{before} {name}"
                if len(line.replace("-", " ").replace("/", " ").split()) >= SHINGLE:
                    out[f"{spdx} ({line})"] = line
    del out["BSD (identifier)"]
    return out


#: All that the query looks for.
KNOWN = {k: v for k, v in TEMPLATES.items() if k != "BSD-3-Clause"} | NOTICES | {f"{k} (whole)": v for k, v in WHOLE.items()} | _lines()

_GPL, _ADVERTISING = "General Public License", "all advertising materials"
#: What a place must say, by template or license: versions and kinds that make
#: up too few shingles to count in the share.
NEEDS = {
    "Apache-2.0": ["Apache License Version 2.0"],
    **{f"GPL-{v}.0": [f"GNU {_GPL}", f"version {v}"] for v in "123"},
    "GPL-3.0 (line)": [f"GNU {_GPL}, version 3"],
    "AGPL-3.0": [f"GNU Affero {_GPL}", "version 3"],
    "LGPL-2.0": [f"GNU Library {_GPL}", "version 2"],
    "LGPL-2.1": [f"GNU Lesser {_GPL}", "version 2.1"],
    "LGPL-3.0": [f"GNU Lesser {_GPL}", "version 3"],
    "MPL-1.1": ["Mozilla Public License", "1.1"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "GFDL-1.2": ["Free Documentation License", "version 1.2"],
    "GFDL-1.3": ["Free Documentation License", "version 1.3"],
    "BSD-3-Clause": ["endorse or promote"],
    "MIT": ["deal in the Software"],
    "MIT (whole)": ["deal in the Software", "shall be included in all copies"],
    "MIT (line)": ["MIT License"],
    "NCSA": ["deal with the Software"],
    "ISC": ["provided that the above copyright notice"],
    "CC-BY-4.0": ["Attribution 4.0"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0 (line)": ["CC BY-NC 4.0"],
    **{name: [line] for name, line in _lines().items()},
}
#: What it must not say.
BARS = {
    "BSD-2-Clause (whole)": ["endorse or promote", _ADVERTISING],
    "BSD-3-Clause (whole)": [_ADVERTISING],
    "GPL-3.0 (whole)": ["Remote Network Interaction"],
    "MIT-0 (whole)": ["shall be included in all copies"],
    "0BSD (whole)": ["provided that the above copyright notice"],
}
#: Wording that several licenses share.
VAGUE = {"BSD"}

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(7)
_PERM = _rng.integers(0, 1 << 63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_powers[i]) <= n:
            have = _powers[i]
            _powers[i] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin.

    The result has one entry more than texts: the number of words.
    """
    data = [(x or "").encode() for x in texts]
    raw = _FOLD[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    kind = _KIND[raw]
    edge = np.diff(kind, prepend=np.uint8(0)).astype(np.int8)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(x) + 1 for x in data)])
    return hashes, np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Of a sequence of words; of fewer than ``SHINGLE`` words, none."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(_BASE) + words[i : n + i]
    return _mixed(out)


def band_keys(shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """W, band and the band's keys (uint32) of the windows at every position."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for band in range(BANDS):
        least = [low * np.uint32(a & np.uint64(0xFFFFFFFF)) + np.uint32(b & np.uint64(0xFFFFFFFF)) for a, b in _PERM[band * ROWS : band * ROWS + ROWS]]
        least = [x ^ (x >> np.uint32(15)) for x in least]
        for width in WINDOWS:
            if len(shingles) < width:
                break
            if width > 1:
                half = width // 2
                least = [np.minimum(x[:-half], x[half:]) for x in least]
            key = least[0] * np.uint32(0x85EBCA6B)
            for x in least[1:]:
                key = (key ^ x) * np.uint32(0xC2B2AE35)
            yield width, band, key ^ (key >> np.uint32(16))


@dataclass
class Index:
    """Templates by band key; some ten thousand keys, whatever the corpus."""

    names: list[str]
    shingles: list[np.ndarray]
    keys: dict[tuple[int, int], dict[int, list[tuple[int, int]]]]
    maybe: dict[tuple[int, int], np.ndarray]

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        names = sorted(templates)
        shingles = [shingle_hashes(word_hashes([templates[n]])[0]) for n in names]
        if short := [n for n, s in zip(names, shingles, strict=True) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        keys: dict = {}
        for t, own in enumerate(shingles):
            width = max(w for w in WINDOWS if w <= len(own))
            # Segments side by side, and the last one flush with the end.
            places = sorted({*range(0, len(own) - width + 1, width), len(own) - width})
            for w, band, found in band_keys(own):
                if w == width:
                    for at in places:
                        keys.setdefault((w, band), {}).setdefault(int(found[at]), []).append((t, at))
        maybe = {}
        for k, found in keys.items():
            maybe[k] = np.zeros(1 << _FILTER, bool)
            maybe[k][np.array(list(found)) & ((1 << _FILTER) - 1)] = True
        return Index(names, shingles, keys, maybe)


@dataclass
class Place:
    """Where a text quotes a template; positions count all words of all texts."""

    text: int
    template: int
    start: int
    share: float
    length: int
    #: Of the template's first shingle, which may be before the text.
    at: int
    #: Words looked at.
    words: tuple[int, int]

    @property
    def matched(self) -> float:
        return self.share * self.length

    def over(self, other: Place) -> bool:
        """Over half of the shorter place lies in the other."""
        ends = [x.at + x.length + SHINGLE - 1 for x in (self, other)]
        return 2 * (min(ends) - max(self.at, other.at)) > min(self.length, other.length) + SHINGLE - 1


def places_of(texts: list[str | None], index: Index, containment: float) -> tuple[np.ndarray, np.ndarray, list[Place]]:
    """Word hashes, where each text begins, and the places of all templates.

    Of overlapping places of one template the fullest (then the closest, then the
    first) counts.
    """
    words, begins = word_hashes(texts)
    # Words of nothing behind the last text: its windows too begin at every word.
    shingles = shingle_hashes(np.concatenate([words, np.zeros(max(WINDOWS) + SHINGLE, np.uint64)]))
    # Places as the template's first shingle would lie, which may be before the
    # text: the text is that of the window.
    places: set[tuple[int, int, int]] = set()
    for width, band, key in band_keys(shingles):
        if (width, band) in index.keys:
            hits = np.flatnonzero(index.maybe[width, band][key & np.uint32((1 << _FILTER) - 1)])
            for at, text in zip(hits.tolist(), (np.searchsorted(begins, hits, "right") - 1).tolist(), strict=True):
                for t, offset in index.keys[width, band].get(int(key[at]), ()) if text < len(texts) else ():
                    places.add((t, at - offset, text))
    found: dict[tuple[int, int], list[tuple[float, float, int, Place]]] = {}
    by_pair: dict[tuple[int, int], list[int]] = {}
    for t, at, text in sorted(places):
        by_pair.setdefault((text, t), []).append(at)
    for (text, t), starts in by_pair.items():
        own = index.shingles[t]
        distinct, counts = np.unique(own, return_counts=True)
        counts = np.append(counts, 0)
        begin, end = int(begins[text]), int(begins[text + 1]) - SHINGLE + 1
        slack = len(own) // 4
        low, high = max(begin, starts[0] - slack), min(end, starts[-1] + len(own) + slack)
        if high <= low:
            continue
        # Number of each of the text's shingles among the template's.
        near = shingles[low:high]
        ids = np.minimum(np.searchsorted(distinct, near), len(distinct) - 1)
        ids[distinct[ids] != near] = len(distinct)

        def part(a: int, b: int) -> float:
            """Share of the template that lies in shingles a to b of all."""
            seen = np.zeros(len(counts), bool)
            seen[ids[a - low : max(a, b) - low]] = True  # noqa: B023
            return float(counts[seen].sum() / len(own))  # noqa: B023

        for at in starts:
            # The place within its text, and some words more on either side.
            start, first, last = max(begin, at), max(begin, at - slack), min(end, at + len(own) + slack)
            if last <= first:
                continue
            share = part(first, last)
            if share >= containment:
                tight = part(start, min(last, at + len(own)))
                found.setdefault((text, t), []).append((share, tight, start, Place(text, t, start, share, len(own), at, (first, last + SHINGLE - 1))))
    out = []
    for (_, t), hits in sorted(found.items()):
        taken: list[int] = []
        for *_, at, place in sorted(hits, key=lambda x: (-x[0], -x[1], abs(x[3].at - x[2]), x[2])):
            if all(abs(at - x) >= len(index.shingles[t]) for x in taken):
                taken.append(at)
                out.append(place)
    return words, begins, out


def scan(texts: list[str | None], index: Index, containment: float) -> list[tuple[int, str, int, float]]:
    """Text number, template, first word and share of the template found there,
    of every template."""
    _, begins, places = places_of(texts, index, containment)
    return [(p.text, index.names[p.template], p.start - int(begins[p.text]), p.share) for p in places]


def license_of(name: str) -> str:
    return name.split(" (")[0]


def _says(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([words[i : n + i] == x for i, x in enumerate(phrase)]).any())


@cache
def _phrase(text: str) -> np.ndarray:
    return word_hashes([text])[0]


def quoted(texts: list[str | None], index: Index, containment: float) -> list[tuple[int, str, int, float]]:
    """As :func:`scan`, with one row a place.

    A place counts if its text says what tells the license from its siblings
    (``NEEDS``, ``BARS``). Where templates of one license overlap, that of which
    most was found counts. Where licenses do, the highest share counts (then the
    longer match), but a template of over twice the length goes before the lines
    in it, and ``VAGUE`` licenses only count where no other does.
    """
    words, begins, places = places_of(texts, index, containment)
    kept: dict[tuple[int, str], list[Place]] = {}
    best: dict[int, float] = {}
    for p in sorted(places, key=lambda p: (-p.matched, -p.share, p.start)):
        name = index.names[p.template]
        here = words[slice(*p.words)]
        if not all(_says(here, _phrase(x)) for x in NEEDS.get(name, NEEDS.get(license_of(name), ()))) or any(_says(here, _phrase(x)) for x in BARS.get(name, ())):
            continue
        own = kept.setdefault((p.text, license_of(name)), [])
        same = [q for q in own if p.over(q)]
        if not same:
            own.append(p)
        for q in same or [p]:
            best[id(q)] = max(best.get(id(q), 0.0), p.share)
    chosen: dict[int, list[Place]] = {}
    for vague, p in sorted(((x in VAGUE, p) for (_, x), own in kept.items() for p in own), key=lambda x: (x[0], -x[1].matched, x[1].start)):
        now = chosen.setdefault(p.text, [])
        rivals = [q for q in now if p.over(q)]
        if not rivals or not vague and all(q.length <= 2 * p.length and best[id(p)] > best[id(q)] for q in rivals):
            chosen[p.text] = [q for q in now if q not in rivals] + [p]
    rows = [(p.text, index.names[p.template], p.start - int(begins[p.text]), p.share) for own in chosen.values() for p in own]
    return sorted(rows, key=lambda x: (x[0], x[2], x[1]))


def find(docs: DataFrame, templates: dict[str, str] = KNOWN, containment: float = 0.8) -> DataFrame:
    """doc_id, license, word, share: every place where a text quotes a template,
    one row a place (:func:`quoted`).

    ``word`` counts the text's words before it. Null and empty texts quote
    nothing; a null doc_id and repeated rows give rows of their own; other
    columns are ignored; an empty table gives no rows. A task holds the template
    index and a few megabytes of text.
    """
    index = Index.of(templates)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, body = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.nan_to_num(pa.compute.binary_length(body).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in tokens.slices(lengths.tolist(), 2_000_000):
                rows = [(names[a + i], *rest) for i, *rest in quoted(body.slice(a, b - a).to_pylist(), index, containment)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "license", "word", "share"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scanned, "doc_id long, license string, word long, share double")
