"""Periodic runs of words: maximal stretches that repeat one shortest block of words four times or more.

Every run has a Lyndon root: at some position, the longest Lyndon word under one of two opposite orders of the words is
as long as the run's period. Both Lyndon arrays come from suffix grouping alone, the first phase of a two-phase suffix sorter:
suffixes start in groups by first word; groups are taken from the greatest down, every member looks for the nearest
suffix before it in a lower group, and those found are moved to a new group just above their own, longer by the group's context for
each member that found them. The context's length when a group is taken is the Lyndon array of its members.
No suffix is sorted further. Each root is then extended through longest common extensions to both sides; these
come from names of all blocks of 1, 2, 4, ... words, so they are exact and a query costs a step per power of two.

A run of exponent four holds each of its words four times, so texts are first cut at words that occur less often in
their piece, again and again; no run and no extension of one crosses such a word. What is left is grouped.

Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. NULL, empty and blank texts have no words and no runs. Texts are
never cut short; a long one costs time in proportion to its words, times a logarithm for the extensions. Equal rows get equal
results, tables may be empty, and only the column named is read.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words worked on at a time; a longer text is a part of its own.
PART_WORDS = 400_000
RESULT = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position; negative codes are separators, which get 0."""
    n = len(codes)
    left, lengths = list(range(n)), [0] * n
    by_code: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        if c >= 0:
            by_code.setdefault(c, []).append(i)
    members = [by_code[c] for c in sorted(by_code)]
    group = [-1] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    context = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    g = len(members) - 1
    while g >= 0:
        size, taken = context[g], [i for i in members[g] if group[i] == g]
        for i in taken:
            lengths[i], left[i] = size, i - 1
        found: dict[int, int] = {}
        for i in taken:
            p = left[i]  # the nearest to the left that is not taken yet; paths are halved
            while p >= 0 and left[p] != p:
                q = left[p]
                if q >= 0:
                    left[p] = left[q]
                p = q
            left[i] = p
            if p >= 0 and group[p] >= 0:
                found[p] = found.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in found.items():
            moves.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            new, upper = len(members), above[old]
            moved = moves[times, old]
            members.append(moved)
            context.append(context[old] + times * size)
            below.append(old)
            above.append(upper)
            above[old] = new
            if upper < len(below):
                below[upper] = new
            for p in moved:
                group[p] = new
        g = below[g]
    return lengths


class Extensions:
    """Longest common extensions of positions of a word sequence, to the right and to the left."""

    def __init__(self, codes: np.ndarray, longest: int):
        names = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        self.levels = [names]
        while 2 << len(self.levels) <= 2 * longest and len(names) > 1 << len(self.levels) - 1:
            half = 1 << len(self.levels) - 1
            pairs = names[: len(names) - half] * (int(names.max()) + 1) + names[half:]
            names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            self.levels.append(names)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from `a` on equal those from `b` on."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = (a < len(names)) & (b < len(names))
                fits[fits] = names[a[fits]] == names[b[fits]]
                step = fits.astype(np.int64) << k
                a, b, total = a + step, b + step, total + step
        return total

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and including `a` equal those up to `b`."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = (a >= size - 1) & (b >= size - 1)
                fits[fits] = names[a[fits] - size + 1] == names[b[fits] - size + 1]
                step = fits.astype(np.int64) << k
                a, b, total = a - step, b - step, total + step
        return total


def pieces_with_runs(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for words in pieces that may hold runs: every word of a piece occurs in it `LEAST_EXPONENT` times at least."""
    stays = np.ones(len(codes), bool)
    piece = doc
    while True:
        at = np.flatnonzero(stays)
        if not len(at):
            return stays
        key = piece[at] * (int(codes.max()) + 1) + codes[at]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = counts[inverse] >= LEAST_EXPONENT
        kept = at[often]
        if not len(kept):
            return np.zeros(len(codes), bool)
        begins = np.r_[True, (np.diff(kept) > 1) | (np.diff(piece[kept]) != 0)]
        number = np.cumsum(begins) - 1
        long = np.bincount(number)[number] >= LEAST_LENGTH
        new = np.zeros(len(codes), bool)
        new[kept[long]] = True
        if (new == stays).all():
            return stays
        stays, piece = new, np.zeros(len(codes), np.int64)
        piece[kept] = number


def find_runs(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(position, length, period) of all runs in the concatenation of documents; none crosses a document's border."""
    nothing = np.empty((0, 3), np.int64)
    at = np.flatnonzero(pieces_with_runs(codes, doc)) if len(codes) >= LEAST_LENGTH else np.empty(0, np.int64)
    if not len(at):
        return nothing
    # the pieces that are left, a separator in front of each
    begins = np.r_[True, (np.diff(at) > 1) | (np.diff(doc[at]) != 0)]
    number = np.cumsum(begins)
    place = np.arange(len(at)) + number
    joined = -np.ones(len(at) + int(number[-1]), np.int64)
    joined[place] = codes[at]
    origin = np.zeros(len(joined), np.int64)
    origin[place] = at
    walls = np.flatnonzero(joined < 0)
    distinct = joined.copy()
    distinct[walls] = -1 - np.arange(len(walls))
    longest = int(np.diff(np.r_[walls, len(joined)]).max())
    extend = Extensions(distinct, longest)
    reverse = np.where(joined < 0, -1, int(codes.max()) - joined)
    found = []
    for ordered in (joined, reverse):
        period = np.array(lyndon_array(ordered.tolist()), np.int64)
        root = np.flatnonzero((period > 0) & (np.arange(len(period)) + period < len(period)))
        p = period[root]
        forward = extend.right(root, root + p)
        backward = extend.back(root - 1, root + p - 1)
        length = backward + p + forward
        is_run = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * p)
        found.append(np.stack([(root - backward)[is_run], length[is_run], p[is_run]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    runs[:, 0] = origin[runs[:, 0]]
    return runs


def _part(texts: list[list[bytes]]) -> list[tuple[int, list[dict], str]]:
    words = list(chain.from_iterable(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    table = dict(zip(dict.fromkeys(words), count()))
    codes = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    first = np.r_[0, np.cumsum(sizes)]
    runs = find_runs(codes, np.repeat(np.arange(len(texts)), sizes))
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    border = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, own in enumerate(texts):
        here = runs[border[k] : border[k + 1]]
        if len(here):
            own = [w for w, stays in zip(own, kept[first[k] : first[k + 1]].tolist()) if stays]
        # sorted by start, length, period so far; the order wanted is by start, then period
        listed = sorted(((s - int(first[k]), n, p) for s, n, p in here.tolist()), key=lambda r: (r[0], r[2]))
        out.append((int(sizes[k]), [{"start": s, "length": n, "period": p} for s, n, p in listed], b" ".join(own).decode()))
    return out


def runs_of(texts: list[bytes | None]) -> list[tuple[int, list[dict], str]]:
    """Number of words, runs by start and period, and the text with every run cut to its first period, of each text."""
    out, part, held = [], [], 0
    for text in texts:
        words = (text or b"").split()  # bytes: at the six ASCII blanks only
        if part and held + len(words) > PART_WORDS:
            out += _part(part)
            part, held = [], 0
        part.append(words)
        held += len(words)
    return out + (_part(part) if part else [])


def word_runs(text: str | Column) -> Column:
    """Struct of `n_words`, `runs` (start in words, length, period; by start, then period) and `collapsed`.

    `collapsed` holds the words, joined by one space, without those that some run contains after its first period.
    """

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        rows = (r for start in range(0, len(raw), 256) for r in runs_of(raw.slice(start, 256).to_pylist()))
        n, runs, collapsed = zip(*rows) if len(raw) else ((), (), ())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())], ["n_words", "runs", "collapsed"])

    return found(text)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties: the least start, then period. NULL without runs."""

    def order(a: Column, b: Column) -> Column:
        here, there = a["length"] * b["period"], b["length"] * a["period"]
        by_start = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(here != there, F.signum(there - here)).otherwise(by_start).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))
