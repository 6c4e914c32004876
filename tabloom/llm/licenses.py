"""Operator 9: find licence notices by conditional compression against templates, confirmed word by word."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licence notices. <v> stands for any version number.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache", "Licensed under the Apache License, Version <v>."),
    ("Apache", "Released under the Apache License, Version <v>."),
    (
        "Apache",
        'Licensed under the Apache License, Version <v> (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("GPL", "This work is licensed under the GNU General Public License, version <v>."),
    ("GPL", "Licensed under the GNU General Public License, version <v>."),
    ("GPL", "Released under the GNU GPL, version <v>."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version <v> of the License, or (at your option) any later version.",
    ),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version <v>."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version <v>."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. <v>."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY", "Licensed under CC BY <v>."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution <v> International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA <v>."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike <v> International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC <v>."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial <v> International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND <v>."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Share of a template's words that may differ.
TOLERANCE = 0.1


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    packer: zstandard.ZstdCompressor


_WORD = re.compile(r"<v>|[^\W_]+(?:\.\d+)*")
_VERSION = re.compile(r"v?\d+(\.\d+)*")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; version numbers stay whole."""
    return _WORD.findall(text.lower())


def _packer(dictionary: str = "") -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False)
    raw = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    return tuple(Template(name, tuple(words(t)), _packer(t)) for name, t in TEMPLATES)


@lru_cache(1)
def _span() -> int:
    """The most words that a stretch of at most TOLERANCE differing words can have."""
    return max(int(len(t.words) * (1 + TOLERANCE)) for t in templates())


@lru_cache(1)
def gate() -> str:
    """A pattern of pairs of neighbouring words around which candidate windows lie; no match can be without one.

    A template in which d words may differ has d + 1 pairs here that share no word. A word replaced, left out or put in spoils one of them at
    most, so that one is whole in every stretch that matches. The pairs are the longest, those that serve other templates already first.
    """
    chosen: dict[tuple[str, str], None] = {}
    for t in sorted(templates(), key=lambda t: len(t.words)):
        need, used = int(TOLERANCE * len(t.words)) + 1, set()
        pairs = [(i, t.words[i : i + 2]) for i in range(len(t.words) - 1) if "<v>" not in t.words[i : i + 2]]
        for i, pair in sorted(pairs, key=lambda x: (x[1] not in chosen, -len(x[1][0]) - len(x[1][1]), x[0])):
            if need and not used & {i, i + 1}:
                chosen[pair] = None
                used |= {i, i + 1}
                need -= 1
        if need:
            raise ValueError(f"the {t.license} notice of {len(t.words)} words has too few pairs for a gate")
    return "(?i)" + "|".join(rf"{re.escape(a)}[\W_]+{re.escape(b)}" for a, b in sorted(chosen))


@lru_cache(1)
def _plain() -> zstandard.ZstdCompressor:
    return _packer()


def windows(text: str) -> tuple[list[re.Match], list[list[tuple[int, int]]]]:
    """The words of a text, and its candidate regions, each cut into windows: ranges of words.

    A region holds all words that stand within a template's length of one of gate()'s pairs. Windows are two such lengths long and
    begin at every multiple of one, so every stretch that can match lies in one window whole.
    """
    found = list(_WORD.finditer(text))
    starts, span = np.array([m.start() for m in found]), _span()
    out: list[list[tuple[int, int]]] = []
    region = None
    for hit in re.finditer(gate(), text):
        at = max(int(np.searchsorted(starts, hit.start(), "right")) - 1, 0)
        lo, hi = max(at - span, 0), min(at + span + 1, len(found))
        if region and lo <= region[1]:
            region[1] = hi
            continue
        if region:
            out.append(region)
        region = [lo, hi]
    if region:
        out.append(region)
    cut = lambda lo, hi: [(i, min(i + 2 * span, hi)) for i in range(lo, max(hi - span, lo + 1), span)]
    return found, [cut(lo, hi) for lo, hi in out if hi > lo]


def differences(template: tuple[str, ...], block: list[str]) -> tuple[int, str | None, int, int]:
    """The fewest words to insert, delete or replace that turn the template into some stretch of the block, the version
    that stands for <v> there, and where it starts and ends (of the first such stretch). By Sellers' dynamic programme,
    a row per word."""
    n = len(block)
    column = np.arange(n + 1)
    names = np.array(block, object)
    row = np.zeros(n + 1, np.int64)
    rows = [row]
    for w in template:
        same = np.array([bool(_VERSION.fullmatch(x)) for x in block]) if w == "<v>" else names == w
        new = np.empty(n + 1, np.int64)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + ~np.asarray(same, bool), row[1:] + 1)
        row = np.minimum.accumulate(new - column) + column
        rows.append(row)
    j, least = int(row.argmin()), int(row.min())
    end = j
    i, version = len(template), None
    while i and j:
        w, x = template[i - 1], block[j - 1]
        same = bool(_VERSION.fullmatch(x)) if w == "<v>" else x == w
        if rows[i][j] == rows[i - 1][j - 1] + (not same):
            if w == "<v>" and same:
                version = x
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return least, version, j, end


def stretches(template: tuple[str, ...], block: list[str], most: float) -> list[tuple[int, str | None, int, int]]:
    """differences() for all stretches of at most `most` differing words that don't overlap, the best first."""
    left, out = list(block), []
    has = set(block)
    versions = any(map(_VERSION.fullmatch, has))
    if sum(not versions if w == "<v>" else w not in has for w in template) > most:  # each of these words differs anywhere
        return out
    while (hit := differences(template, left))[0] <= most and hit[3] > hit[2]:
        out.append(hit)
        left[hit[2] : hit[3]] = [""] * (hit[3] - hit[2])  # equals no word
    return out


def _apart(hits: list[tuple]) -> list[tuple]:
    """The matches (differing words, words matched, template, version, start, end) that stay. Of overlapping ones of a licence that
    with the most words matched; of a licence and another, not the one that another beats by fewer differing words and at least as
    many matched."""
    own: dict[str, list[tuple]] = {}
    for x in sorted(set(hits), key=lambda x: (-x[1], x[0], x[4], x[2])):
        mine = own.setdefault(templates()[x[2]].license, [])
        if not any(y[4] < x[5] and x[4] < y[5] for y in mine):
            mine.append(x)
    kept: list[tuple] = []
    for x in sorted((x for mine in own.values() for x in mine), key=lambda x: (x[0], -x[1], x[2], x[4])):
        if not any(y[4] < x[5] and x[4] < y[5] and y[0] < x[0] and y[1] >= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[4], x[5], x[2]))


def scan_text(text: str) -> list[tuple[str, str | None, float, int, int, bool, int, int]]:
    """(license, version, reduction, differing words, template's words, confirmed, line, word) of each notice in a text, line and word
    being the numbers of those that it begins with.

    Each template, as a raw zstandard dictionary, saves some of a window's compressed size, which ranks it. All that save
    anything are compared with the window word by word; confirmed is every stretch in which at most TOLERANCE of the template's
    words differ, see _apart() for overlaps. A region without any gives the best-ranked template of all its windows as not confirmed.
    """
    found, regions = windows(text)
    lower = [m.group().lower() for m in found]
    line = lambda i: text.count("\n", 0, found[i].start())
    out = []
    for region in regions:
        hits, saved, best = [], {}, (0.0, 0, 0, 0)
        for lo, hi in region:
            raw = text[found[lo].start() : found[hi - 1].end()].encode("utf-8", "surrogatepass")
            plain = len(_plain().compress(raw))
            own = lower[lo:hi]
            for k, t in enumerate(templates()):
                less = 1 - len(t.packer.compress(raw)) / plain
                best = max(best, (less, -k, lo, hi), key=lambda x: x[:2])
                if less > 0:
                    for d, version, i, j in stretches(t.words, own, TOLERANCE * len(t.words)):
                        hits.append((d, len(t.words) - d, k, version, lo + i, lo + j))
                        saved[k, lo + i] = max(less, saved.get((k, lo + i), 0.0))
        for d, _, k, version, i, _ in _apart(hits):
            out.append((templates()[k].license, version, saved[k, i], d, len(templates()[k].words), True, line(i), i))
        if not hits and best[0] > 0:
            less, k, lo, hi = best
            t = templates()[-k]
            d, version, i, _ = differences(t.words, lower[lo:hi])
            i = min(lo + i, hi - 1)
            out.append((t.license, version, less, d, len(t.words), False, line(i), i))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per occurrence of a licence notice in a text: doc_id, line and word (where it begins, from 0), license, version,
    reduction (share of the window's compressed size that the template saves), differing_words, template_words, confirmed.

    Whole texts are searched, in windows of words around gate()'s pairs, so long lines are like any others; candidate regions in which
    no template is confirmed give one row for the template that ranks first, confirmed being false, or none if no template saves
    anything. Of equal matches at one place the template listed first counts. Null and empty texts have no rows; repeated rows
    repeat theirs; an empty table has none; other columns, of whatever names, are not looked at.
    """
    names = ["doc_id", "license", "version", "reduction", "differing_words", "template_words", "confirmed", "line", "word"]

    def run(batches):
        for b in batches:
            hit = pc.fill_null(pc.match_substring_regex(b.column(1), gate()), False)
            b = b.filter(hit)
            rows = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) for r in scan_text(t)]
            cols = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            ids = b.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, license string, version string, reduction double, differing_words int, template_words int, confirmed boolean, line int, word int"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
