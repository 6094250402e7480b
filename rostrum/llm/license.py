"""License scans by patience alignment of texts and license templates.

For each template, words that occur once in both the text and the template are anchors; the
longest increasing subsequence of the anchors (by patience sorting) is kept, and the gaps
between kept anchors are aligned the same way, where words may be unique again; common
heads and tails of a gap match outright.  Coverage is the share of the template's words
that are aligned.  A template that shares too few distinct words with the text to reach
the threshold is skipped: its coverage can't be reached.

A statement may stand anywhere: it is found wherever a longest common subsequence, which no
alignment exceeds, reaches the threshold within SPREAD template lengths.  Words outside of that
count for another statement: scattered over a long text, common words would cover short
templates by chance.  Where patience alignment falls short of the words a statement's
surroundings hold, the longest common subsequence gives the coverage.

One pass over whole texts; templates are a small fixed table.  Edge cases: null and empty
texts match nothing; repeated rows give repeated rows; an empty table gives an empty
result; extra columns are ignored.  ``hits`` lists every statement of every template, in the
order of the text; the other columns repeat the best (of equal ones the first template's).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame

#: Coverage from which a template counts as found.
THRESHOLD = 0.8
#: Words in which a statement's needed words may lie, as a multiple of its template's.
SPREAD = 4

# Short license statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}

HIT = ["license", "coverage", "first_word", "last_word"]

_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting with links to the pile before."""
    tops: list[int] = []
    at: list[int] = []
    link = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        link[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = link[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        wanted = set(b[low:high])
        in_a = Counter(w for w in a[lo:hi] if w in wanted)
        in_b = Counter(b[low:high])
        place = {b[j]: j for j in range(low, high)}
        anchors = [(i, place[a[i]]) for i in range(lo, hi) if in_a.get(a[i]) == 1 and in_b[a[i]] == 1]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        for (i, j), (i2, j2) in zip([(lo - 1, low - 1), *kept], [*kept, (hi, high)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


class Template:
    """A template's words with the bit masks of their places, forwards and backwards."""

    def __init__(self, own: list[str], threshold: float = THRESHOLD) -> None:
        self.words, self.size, self.reach = own, len(own), SPREAD * len(own)
        self.need = max(1, ceil(threshold * len(own) - 1e-9))
        self.counts = Counter(own)
        self.ahead: dict[str, int] = {}
        self.back: dict[str, int] = {}
        for j, w in enumerate(own):
            self.ahead[w] = self.ahead.get(w, 0) | 1 << j
            self.back[w] = self.back.get(w, 0) | 1 << len(own) - 1 - j

    def reached(self, own: Iterable[str], masks: dict[str, int], goal: int) -> tuple[int, int]:
        """Longest common subsequence with ``own`` (bit-parallel), and the words of ``own`` it takes; stops at ``goal``."""
        full = v = (1 << self.size) - 1
        best = taken = 0
        for n, w in enumerate(own, 1):
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
            if u and (length := self.size - v.bit_count()) > best:
                best, taken = length, n
                if best >= goal:
                    break
        return best, taken

    def cores(self, own: list[str], at: list[int]) -> list[tuple[int, int]]:
        """Disjoint shortest runs of ``own`` (the template's words in a text, at places ``at``) that cover what is needed.

        Each ends as early as any after the one before, so no text has more disjoint ones.
        """
        out, x = [], 0
        while x < len(at):
            end = bisect_left(at, at[x] + self.reach)
            best, taken = self.reached(own[x:end], self.ahead, self.need)
            if best >= self.need:
                end = x + taken
                _, taken = self.reached(reversed(own[x:end]), self.back, self.need)
                out.append((end - taken, end))
                x = end
                continue
            # a later window has to hold as many further words as were missing
            last = end + self.need - best - 1
            if last >= len(at):
                break
            x = max(x + 1, bisect_right(at, at[last] - self.reach))
        return out

    def statements(self, text: list[str]) -> list[tuple[float, int, int]]:
        """(share of the template that is aligned, first and last aligned place in the text) of every statement."""
        at = [i for i, w in enumerate(text) if w in self.ahead]
        own = [text[i] for i in at]
        cores = self.cores(own, at)
        out, low = [], 0
        for k, (start, end) in enumerate(cores):
            lo = max(low, bisect_right(at, at[end - 1] - self.reach))
            hi = min(cores[k + 1][0] if k + 1 < len(cores) else len(at), bisect_left(at, at[start] + self.reach))
            part = own[lo:hi]
            share = len(align(part, self.words))
            held = Counter(part)
            if share < sum(min(n, held[w]) for w, n in self.counts.items()):  # anchors crossed, or no word was unique
                share, _ = self.reached(part, self.ahead, self.size)
            _, taken = self.reached(part, self.ahead, share)
            hi = lo + taken
            _, taken = self.reached(reversed(own[lo:hi]), self.back, share)
            out.append((share / self.size, at[hi - taken], at[hi - 1]))
            low = hi
        return out


def coverage(text: list[str], template: list[str], threshold: float = THRESHOLD) -> tuple[float, int, int]:
    """The best statement's share of the template and its first and last place (0 and -1 if none reaches the threshold)."""
    return max(Template(template, threshold).statements(text) if template else [], key=lambda s: s[0], default=(0.0, -1, -1))


def hits_of(text: list[str], known: dict[str, Template]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of every statement of every template, in the order of the text."""
    held = set(text)
    out = []
    for name, t in known.items():
        if len(t.ahead.keys() - held) <= t.size - t.need:
            out += [(name, *s) for s in t.statements(text)]
    return sorted(out, key=lambda h: h[2:])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the best license (null if none), coverage, first_word and last_word (-1 if none), and all hits."""
    known = {k: Template(words(v), threshold) for k, v in (templates or TEMPLATES).items()}
    rank = {name: k for k, name in enumerate(known)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                hits = hits_of(words(text), known)
                best = min(hits, key=lambda h: (-h[1], rank[h[0]], h[2]), default=(None, 0.0, -1, -1))
                rows.append((doc_id, *best, [dict(zip(HIT, h, strict=True)) for h in hits]))
            yield pd.DataFrame(rows, columns=["doc_id", *HIT, "hits"])

    fields = "license string, coverage double, first_word long, last_word long"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {fields}, hits array<struct<{fields}>>")
