"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case; shingles are runs of SHINGLE words. A template is cut into
windows of WINDOW shingles, each STRIDE after the one before; a text is cut the same way, by half a window, so that
every place of a template in a text is nearly aligned with some window of it. Each window has BANDS x ROWS MinHash
values; two windows that agree on a whole band are candidates. With a window likeness of EXPECTED or more the chance
of agreement in some band is at least ``collision(EXPECTED)``, 0.999 with these settings. A candidate is
verified on the text: the share of the template's shingles in the text's span around the window, exactly.

Templates shorter than a window (a line that names a license) are looked up by their rarest shingles, so many that a
text without any of them has less than CONTAINMENT of the template: none is missed. All of it is exact containment
in the end.

The templates are a parameter, a bounded list: TEMPLATES holds full texts, short public notices, and the lines that
call a license by its name, in all versions and usual spellings. They are broadcast; a text meets
them in its own row, so nothing is shuffled and no text is held together with another.

Null and empty texts: no matches. Texts of any length are scanned whole. Ties: a span goes to the template with more
shingles in it, then the larger containment, then the longer one, then the smaller name; words around a short
name give way to all others ("under the BSD" to "BSD 3-Clause"). Repeated rows are scanned each. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mix64, shingles, spread, table

SHINGLE, WINDOW, STRIDE, BANDS, ROWS, EXPECTED = 3, 24, 6, 24, 2, 0.5
#: Share of a template's shingles that a match needs.
CONTAINMENT = 0.8
#: Full texts by license name, read where a scan is planned and broadcast with the rest.
FULL = resources.files(__package__) / "licenses"  # also where the package lies in a zip
# Short notices by license name.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: GNU licenses: short name, words before "Public License", versions.
GNU = (("GPL", "General", "1 2 3"), ("LGPL", "Lesser General", "2.1 3"), ("LGPL", "Library General", "2"), ("AGPL", "Affero General", "1 3"))
#: Creative Commons licenses: the ways to write each element, and all versions.
ELEMENTS = {"BY": ("Attribution",), "NC": ("NonCommercial", "Non-Commercial"), "ND": ("NoDerivatives", "NoDerivs", "No-Derivatives"), "SA": ("ShareAlike", "Share-Alike")}
CREATIVE, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("", "1.0", "2.0", "2.5", "3.0", "4.0")
#: Other licenses: name, and how a line calls it.
OTHER = {
    "MIT": ("MIT", "Expat"), "Apache": ("Apache",), "Apache-1.1": ("Apache License Version 1.1", "Apache 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache v2", "Apache License v2", "Apache Software License 2.0", "Apache Software License Version 2.0"),
    "BSD": ("BSD", "BSD-style"), "ISC": ("ISC",), "Zlib": ("zlib",),
    "BSD-2-Clause": ("BSD 2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD"), "BSD-3-Clause": ("BSD 3-Clause", "3-clause BSD", "New BSD", "Modified BSD", "Revised BSD"),
    "BSD-4-Clause": ("BSD 4-Clause", "4-clause BSD", "Original BSD"), "0BSD": ("0BSD", "Zero-Clause BSD"),
    "MPL": ("Mozilla Public License", "MPL"),
    **{f"MPL-{v}": (f"Mozilla Public License {v}", f"Mozilla Public License version {v}", f"Mozilla Public License v{v}", f"Mozilla Public License v. {v}", f"MPL {v}", f"MPL v{v}", f"MPLv{v}") for v in ("1.0", "1.1", "2.0")},
    "EPL": ("Eclipse Public License", "EPL"), **{f"EPL-{v}": (f"Eclipse Public License {v}", f"Eclipse Public License version {v}", f"Eclipse Public License v{v}", f"Eclipse Public License v {v}", f"EPL {v}") for v in ("1.0", "2.0")},
    "BSL-1.0": ("Boost Software License",), "CDDL": ("Common Development and Distribution License", "CDDL"), "EUPL": ("European Union Public Licence", "European Union Public License", "EUPL"),
    "Artistic": ("Artistic",), "Artistic-2.0": ("Artistic License 2.0",), "GFDL": ("GNU Free Documentation License", "GFDL"), "Unlicense": ("The Unlicense unlicense.org", "Unlicense"), "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero", "creativecommons.org/publicdomain/zero/1.0"), "ODbL": ("Open Database License", "ODbL"), "OFL": ("SIL Open Font License",),
    "public-domain": ("released into the public domain", "dedicated to the public domain", "placed in the public domain", "in the public domain"),
    "rights-reserved": ("All rights reserved", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Tutti i diritti riservati", "Todos os direitos reservados", "Все права защищены"),
}
_verbs = ("licensed", "licenced", "released", "distributed", "available", "published", "provided", "covered")
_before = ("the", "under", "an", "a", "of", "this", "and", "or")

_word = re.compile(r"[^\W_]+")


def calls(name: str) -> list[str]:
    """Lines that call a license by a name; one of less than SHINGLE words is only told by the words around it, marked ~."""
    tag = [f"SPDX-License-Identifier: {name}"]
    if len(_word.findall(name)) >= SHINGLE:
        return [name, *tag]
    return ["~" + line for line in tag + around_of(name)]


def around_of(name: str) -> list[str]:
    around = [f"{b} {name} {kind}" for b in _before for kind in ("license", "licence")]
    return around + [f"{v} under {the}{name}" for v in _verbs for the in ("", "the ")] + [f"under the terms of the {name}", f"under the terms of {name}"]


def reference_lines() -> dict[str, list[str]]:
    """Lines that name a license, by license."""
    found: dict[str, list[str]] = {}
    for short, kind, versions in GNU:
        name = f"GNU {kind} Public License"
        found.setdefault(short, []).extend([name, *calls(short), *calls(f"GNU {short}")])
        for v in versions.split():
            number = v if "." in v else f"{v}.0"
            lines = [f"{name} {x}" for x in (v, f"v{v}", f"version {v}", f"({short}) version {v}", f"({short}) v{v}", f"as published by the Free Software Foundation, version {v}", f"as published by the Free Software Foundation; either version {v} of the License")]
            lines.append(f"version {v} of the {name}")
            for x in (f"{short} {number}", f"{short} {v}", f"{short}v{v}", f"{short} v{v}", f"{short} version {v}"):
                lines += [*calls(x), *calls(f"GNU {x}")]
            found.setdefault(f"{short}-{number}", []).extend(lines)
    for code in CREATIVE:
        spoken = ["-".join(p) for p in itertools.product(*[ELEMENTS[e] for e in code.split("-")])]
        for v in CC_VERSIONS:
            at = f" {v}" if v else ""
            lines = [*calls(f"CC {code}{at}"), *calls(f"Creative Commons {code}{at}"), f"creativecommons.org/licenses/{code.lower()}{at.replace(' ', '/')}"]
            lines += [f"Creative Commons {s}{tail}" for s in spoken for tail in ((f" {v}", f" {v} International", f" {v} Unported", f" {v} Generic", f" License {v}", f" International {v}") if v else ("",))]
            found[f"CC-{code}{at.replace(' ', '-')}"] = lines
    for license, names in OTHER.items():
        found.setdefault(license, []).extend(line for n in names for line in calls(n))
    return found


def templates() -> dict[str, str]:
    """Notices, full texts and lines; what follows # or, for words around a short name, ~ tells templates of one license apart."""
    out = dict(NOTICES)
    texts = {p.name: p for p in FULL.iterdir() if p.name.endswith(".txt")} if FULL.is_dir() else {}
    if not texts:
        raise FileNotFoundError(f"no license texts in {FULL}")
    out.update({f"{name.removesuffix('.txt')}#text": texts[name].read_text(encoding="utf-8") for name in sorted(texts)})
    for license, lines in reference_lines().items():
        seen = {tuple(words_of(x)[0]): x for x in reversed(lines)}
        out.update({f"{license}{'~' if x[0] == '~' else '#'}{k}": x for k, x in enumerate(reversed(seen.values()))})
    return out


def collision(likeness: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two windows of this likeness agree on some band."""
    return 1 - (1 - likeness**rows) ** bands


def words_of(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Folded words and their places in the text."""
    found = [(m[0].lower().encode(), m.span()) for m in _word.finditer(text or "")]
    return [w for w, _ in found], [s for _, s in found]


TEMPLATES = templates()


def band_keys(windows: list[np.ndarray]) -> np.ndarray:
    """BANDS keys for each window's shingle hashes."""
    k = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        factors = mix64(k) | np.uint64(1)
        low = np.array([(w[:, None] * factors).min(0) for w in windows], np.uint64).reshape(-1, BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.ones((len(low), 1), np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
    return key


def _windows(n: int, width: int, stride: int) -> list[tuple[int, int]]:
    """Spans of shingle numbers that cover 0 to n."""
    if n <= width:
        return [(0, n)] if n else []
    starts = list(range(0, n - width, stride)) + [n - width]
    return [(s, s + width) for s in starts]


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the hashes are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


@dataclass
class Templates:
    """Shingle sets by name, names by band key of the long ones, names and places by the rarest shingles of the short ones."""

    texts: dict[str, str]
    sets: dict[str, np.ndarray] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    index: dict[int, set[str]] = field(default_factory=dict)
    rare: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def __post_init__(self):
        hashes, short, uses = WordHashes(), {}, Counter()
        for name, text in sorted(self.texts.items()):
            h = shingles(hashes.of(words_of(text)[0]), SHINGLE)
            if not len(h):
                continue
            self.sets[name], self.lengths[name] = np.unique(h), len(h)
            if len(h) < WINDOW:
                short[name] = h
                uses.update(self.sets[name].tolist())
                continue
            for key in band_keys([h[a:b] for a, b in _windows(len(h), WINDOW, STRIDE)]).ravel().tolist():
                self.index.setdefault(key, set()).add(name)
        for name, h in short.items():
            # a text without all of the so many rarest ones has too few of the rest
            own = sorted(self.sets[name].tolist(), key=lambda x: (uses[x], x))
            for x in own[: len(own) - math.ceil(CONTAINMENT * len(own)) + 1]:
                self.rare.setdefault(x, []).append((name, int(np.flatnonzero(h == np.uint64(x))[0])))
        long = [v for k, v in self.sets.items() if k not in short]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *long]))
        self.keys = np.array(sorted(self.rare), np.uint64)

    def scan(self, text: str | None, hashes: WordHashes) -> list[tuple[str, int, int, float]]:
        """(name, begin, end, containment) of each match in code points, without overlaps."""
        tokens, places = words_of(text)
        h = shingles(hashes.of(tokens), SHINGLE)
        if len(tokens) < SHINGLE or not len(h):
            return []
        found: set[tuple[str, int]] = set()
        for i in np.flatnonzero(_among(h, self.keys)).tolist():
            found.update((name, max(0, i - at)) for name, at in self.rare[int(h[i])])
        # windows without any template shingle can't collide in a band: their minima are of other shingles
        near = np.concatenate([[0], np.cumsum(_among(h, self.grams))])
        if near[-1]:
            starts = np.array([a for a, _ in _windows(len(h), WINDOW, STRIDE)])
            ends = np.minimum(starts + WINDOW, len(h))
            on = near[ends] > near[starts]
            spans = list(zip(starts[on].tolist(), ends[on].tolist(), strict=True))
            for k in range(0, len(spans), 512):
                part = spans[k : k + 512]
                for (a, _), keys in zip(part, band_keys([h[a:b] for a, b in part]).tolist(), strict=True):
                    for key in keys:
                        found.update((name, a) for name in self.index.get(key, ()))
        # windows less than half a template apart are verified together, on all starts that any of them allows
        places_of: dict[tuple[str, int], list[int]] = {}
        for name, a in found:
            places_of.setdefault((name, a // max(1, self.lengths[name] // 2)), []).append(a)
        matches = []
        for (name, _), at in places_of.items():
            n, own = self.lengths[name], self.sets[name]
            low, high = max(0, min(at) - n), min(len(h), max(at) + min(n, WINDOW) + n)
            inside = np.isin(h[low:high], own)
            hit = np.flatnonzero(inside)
            if not len(hit):
                continue
            # the best run of the template's length
            sums = np.concatenate([[0], np.cumsum(inside)])
            starts = np.arange(0, max(1, high - low - n + 1))
            s = int(starts[np.argmax(sums[np.minimum(starts + n, len(sums) - 1)] - sums[starts])])
            run = h[low + s : min(high, low + s + n)]
            common = len(np.intersect1d(run, own))
            if common >= CONTAINMENT * len(own):
                on = np.flatnonzero(np.isin(run, own)) + low + s
                matches.append((0 if "~" in name else common, common / len(own), n, name, places[on[0]][0], places[min(len(places), on[-1] + SHINGLE) - 1][1]))
        out: list[tuple[str, int, int, float]] = []
        for _, share, _, name, begin, end in sorted(set(matches), key=lambda m: (-m[0], -m[1], -m[2], m[3], m[4])):
            if all(end <= b or begin >= e for _, b, e, _ in out):
                out.append((re.split("[#~]", name)[0], begin, end, share))
        return sorted(out, key=lambda m: m[1])


MATCHES = "array<struct<license:string,begin:int,end:int,containment:double>>"


def licenses(text: Column, templates: Templates, spark: SparkSession) -> Column:
    """MATCHES of a text column."""
    sent = spark.sparkContext.broadcast(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t, hashes = sent.value, WordHashes()
        for batch in batches:
            yield pa.array([[{"license": n, "begin": a, "end": b, "containment": c} for n, a, b, c in t.scan(x, hashes)] for x in batch.to_pylist()], kind)

    return run(text)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match in every document; documents without one have no row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.explode(licenses(F.col("text"), Templates(TEMPLATES), spark)).alias("m"))
    return rows.select("doc_id", F.col("m.license").alias("license"), F.col("m.begin").alias("begin_char"), F.col("m.end").alias("end_char"), F.col("m.containment").alias("containment"))
