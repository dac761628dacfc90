"""License scans: fuzzy search for short notices.

A notice that may differ by k edits is cut into k + 1 seeds; wherever it occurs with k edits at most, one of
the seeds occurs unchanged (pigeonhole). One automaton finds all seeds of all notices in a single pass over
the text; around each hit the ``regex`` library matches the whole notice with at most k insertions, deletions and substitutions.
Line ends with the comment marks behind them and runs of blanks count as one blank, so wrapped and commented notices are found; spans are
those of the text as it is.
Notices of other versions and variants lie within k edits of each other, so all that are known compete: of matches
of one span only those with the fewest edits stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Creative Commons Attribution 4.0 International",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "apache-1.0": "Licensed under the Apache License, Version 1.0",
    "apache-1.1": "Licensed under the Apache License, Version 1.1",
    "gpl-1.0": "licensed under the GNU General Public License, version 1",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "mpl-1.0": "subject to the terms of the Mozilla Public License, v. 1.0",
    "mpl-1.1": "subject to the terms of the Mozilla Public License, v. 1.1",
    **{f"cc-by-{v}": f"Creative Commons Attribution {v} International" for v in ("1.0", "2.0", "2.5", "3.0")},
    **{f"cc-by-nc-{v}": f"Licensed under CC BY-NC {v}" for v in ("1.0", "2.0", "2.5", "3.0")},
    **{f"cc-by-{kind}-{v}": f"Licensed under CC BY-{kind.upper()} {v}" for kind in ("sa", "nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "zlib": "must be plainly marked as such, and must not be misrepresented",
    "bsl-1.0": "Boost Software License - Version 1.0",
    "epl-2.0": "Eclipse Public License v2.0",
    "epl-1.0": "Eclipse Public License v1.0",
    "artistic-2.0": "The Artistic License 2.0",
    "cc0-1.0": "dedicated all copyright and related and neighboring rights",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Characters of a notice for each edit that is allowed.
CHARS_AN_EDIT = 12
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower(text: str) -> str:
    """Lower case, of the same length, so that spans hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


_GAP = re.compile(r"[\n\t\r\f\v\u00a0\u2028]|  ")
_MARK = r"(?:/\*|//|--|\.\.|[*#;%!|>\"]|dnl(?=\s)|rem(?=\s))[*#;/%!|>-]*(?=\s)"
#: What goes on a gap: blanks, and comment marks at the beginning of a line.
_REST = re.compile(rf"(?:(?<=[\n\r])[ \t]*{_MARK}|\s+)")


class Flat:
    """A lower-case text with one blank for each gap, and where its characters were."""

    def __init__(self, text: str):
        low = lower(text)
        self.at, self.was = [0], [0]
        if not _GAP.search(low):
            self.text = low
            return
        parts, done, size = [], 0, 0
        while m := _GAP.search(low, done):
            start = m.start()
            while start > done and low[start - 1] == " ":
                start -= 1
            # A gap with a line end goes on behind the comment marks of the next line.
            end = m.end()
            while more := _REST.match(low, end):
                end = more.end()
            parts += [low[done:start], " "]
            size += start - done
            self.at += [size, size + 1]
            self.was += [start, end]
            size, done = size + 1, end
        self.text = "".join(parts) + low[done:]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span in the text itself; an end within a gap is the gap's start."""
        k, n = bisect.bisect_right(self.at, start) - 1, bisect.bisect_left(self.at, end) - 1
        return self.was[k] + start - self.at[k], self.was[n] + end - self.at[n]


def fewest_edits(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The matches without those whose span another notice has with fewer edits; equally good ones all stay."""
    beaten, open_ = set(), []
    for i in sorted(range(len(found)), key=lambda i: found[i][1]):
        name, start, end, edits = found[i]
        open_ = [j for j in open_ if found[j][2] > start]
        for j in open_:
            other, a, b, least = found[j]
            if other != name and 2 * (min(b, end) - start) >= min(b - a, end - start):
                beaten |= {i} if least < edits else {j} if edits < least else set()
        open_.append(i)
    return [x for i, x in enumerate(found) if i not in beaten]


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, chars_an_edit: int = CHARS_AN_EDIT):
        self.patterns: list[tuple[str, int, int, regex.Pattern]] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for name, notice in notices.items():
            low = lower(notice)
            k = len(low) // chars_an_edit
            cuts = [round(i * len(low) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(low[a:b], []).append((len(self.patterns), a))
            self.patterns.append((name, len(low), k, regex.compile(f"(?e)(?:{regex.escape(low)}){{e<={k}}}")))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """``(notice, start, end, edits)`` of every match, in characters; a notice's matches don't overlap.

        A match gives way to another notice's with fewer edits that shares at least half of the shorter of both.
        """
        flat = Flat(text)
        low = flat.text
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(low):
            for n, offset in places:
                _, length, k, _ = self.patterns[n]
                start = end + 1 - size - offset
                windows.setdefault(n, []).append([max(0, start - 2 * k - 1), min(len(low), start + length + 2 * k + 1)])
        out = []
        for n, spans in sorted(windows.items()):
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            name, _, _, pattern = self.patterns[n]
            for a, b in merged:
                out += [(name, m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(low, a, b)]
        return [(name, *flat.span(a, b), edits) for name, a, b, edits in fewest_edits(out)]

    def scan_all(self, text: str) -> list[tuple[str, int, int, int]]:
        """The same without seeds: every pattern over the whole text (slow; what ``scan`` has to find)."""
        flat = Flat(text)
        found = [(name, m.start(), m.end(), sum(m.fuzzy_counts)) for name, _, _, pattern in self.patterns for m in pattern.finditer(flat.text)]
        return [(name, *flat.span(a, b), edits) for name, a, b, edits in fewest_edits(found)]


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, chars_an_edit: int = CHARS_AN_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, notice, start, end, edits, span)``: one row per match in a text; ``span`` is the text matched.

    Letter case, line ends with comment marks, and the number of blanks don't count. Null and empty texts have no match. Repeated rows are scanned each; null ids stay; other
    columns aren't read.
    """
    data = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_an_edit)
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch["text"]):
                text = value.as_py()
                for name, start, end, edits in scanner.scan(text) if text else ():
                    at.append(i)
                    found.append((name, start, end, edits, text[start:end]))
            if found:
                names, starts, ends, edits, spans = zip(*found)
                yield pa.record_batch(
                    [batch["id"].take(pa.array(at, pa.int64())), pa.array(names), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(edits, pa.int32()), pa.array(spans)],
                    names=["id", "notice", "start", "end", "edits", "span"],
                )

    return data.mapInArrow(run, f"id {kind}, notice string, start int, end int, edits int, span string").withColumnRenamed("id", id_col)
