"""Periodic runs of words: maximal stretches that repeat with a smallest period, found document by document.

For a period p a harmonic grid of places is laid over the text. A run of period p is at least max(p, min_length - p) words
longer than its period, so of the pairs (i, i + p) of a grid with that spacing at least one lies in it, and both words are
equal there. From such a pair the run extends as far as the longest common extensions (LCE) of i and i + p reach, forward
and backward. LCEs come from a difference cover D modulo v: for any two places a few words on both are in the cover at
once, so words are compared up to there; only suffixes at covered places are sorted (by windows of v words, then by
doubling, which stays in the cover), and a sparse table over the LCPs of neighbours gives the rest. Only documents in
which a pair gets that far are sorted at all. The work is n log n pairs for n words, in arrays over many documents at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkseek.llm.common import fresh
from sparkseek.llm.kernels import WORDS, buffers, slices

#: A perfect difference set modulo 31; every shift is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_FLUSH = 1 << 20


def _shifts() -> np.ndarray:
    """By residues of two places: the smallest step after which both are in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    table = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    for step in reversed(range(PERIOD)):
        hit = inside[step : step + PERIOD]
        table[hit[:, None] & hit[None, :]] = step
    return table


SHIFT = _shifts()


class Suffixes:
    """Covered suffixes of some segments of codes, sorted. A segment (begin, end) has words in [begin, end) and the
    terminator 0 at end. lce() takes two places of one segment, both in the cover."""

    def __init__(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        sizes = ends - begins + 1
        place = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        segment = np.repeat(np.arange(len(begins)), sizes)
        covered = np.isin(place % PERIOD, COVER)
        self.place, segment = place[covered], segment[covered]
        padded = np.append(codes, np.zeros(PERIOD, codes.dtype))
        bits = max(1, int(padded.max()).bit_length())
        step = max(1, 62 // bits)
        self.rank = np.searchsorted(segment, segment)
        tied = np.flatnonzero(np.bincount(self.rank, minlength=len(segment))[self.rank] > 1)
        for at in range(0, PERIOD, step):
            if not len(tied):
                break
            key = np.zeros(len(tied), np.int64)
            for t in range(at, min(PERIOD, at + step)):
                key = key << bits | padded[self.place[tied] + t]
            tied = self._refine(tied, key)
        self.levels = [self.rank]
        width = PERIOD
        self.where = np.full(len(codes) + 1, -1, np.int64)
        self.where[self.place] = np.arange(len(self.place))
        while len(tied):  # suffixes that are equal so far have no terminator so far, so both go on in the cover
            self.rank = self.rank.copy()
            tied = self._refine(tied, self.levels[-1][self.where[self.place[tied] + width]])
            self.levels.append(self.rank)
            width *= 2
        self._table(padded)

    def _refine(self, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Splits groups of equal rank by key: the rank of a suffix is the number of suffixes before its group."""
        group = self.rank[tied]
        order = np.lexsort((key, group))
        group, key, tied = group[order], key[order], tied[order]
        first = np.ones(len(tied), bool)
        first[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        outer = np.searchsorted(group, group)
        self.rank[tied] = group + starts[run] - outer
        sizes = np.diff(np.append(starts, len(tied)))
        return tied[sizes[run] > 1]

    def _table(self, padded: np.ndarray) -> None:
        """LCPs of neighbours in the order of suffixes, and minima over 1, 2, 4, ... of them."""
        order = np.argsort(self.rank, kind="stable")
        a, b = self.place[order[:-1]], self.place[order[1:]]
        lcp = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level, width = self.levels[k], PERIOD << k
            x, y = self.where[a + lcp], self.where[b + lcp]
            same = (x >= 0) & (y >= 0)
            same[same] = level[x[same]] == level[y[same]]
            lcp[same] += width
        live = np.arange(len(a))
        for _ in range(PERIOD):
            live = live[padded[a[live] + lcp[live]] == padded[b[live] + lcp[live]]]
            live = live[padded[a[live] + lcp[live]] > 0]
            if not len(live):
                break
            lcp[live] += 1
        self.minima = [lcp]
        while 2 * (1 << len(self.minima) - 1) <= len(lcp):
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))
        self.levels = []

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[self.where[i]], self.rank[self.where[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def _compare(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words of i and j (i < j) up to where both are in the cover, and which pairs got there."""
    shift = SHIFT[i % PERIOD, j % PERIOD]
    same = np.zeros(len(i), np.int64)
    live = np.flatnonzero(shift > 0)
    t = 0
    while len(live):
        live = live[codes[i[live] + t] == codes[j[live] + t]]
        t += 1
        same[live] = t
        live = live[shift[live] > t]
    return same, same == shift


class _Sequence:
    """Documents' codes one after another, a terminator before, between and behind them, with LCEs in one direction."""

    def __init__(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.codes, self.begins, self.ends = codes, begins, ends
        self.sorted: dict[int, Suffixes] = {}
        self.part = np.full(len(begins), -1, np.int64)

    def lce(self, i: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
        same, reached = _compare(self.codes, i, j)
        far = np.flatnonzero(reached)
        if len(far):
            new = np.unique(doc[far])
            new = new[self.part[new] < 0]
            if len(new):
                new = new[np.argsort(self.begins[new])]
                self.part[new] = len(self.sorted)
                self.sorted[len(self.sorted)] = Suffixes(self.codes, self.begins[new], self.ends[new])
            for k, suffixes in self.sorted.items():
                own = far[self.part[doc[far]] == k]
                if len(own):
                    same[own] += suffixes.lce(i[own] + same[own], j[own] + same[own])
        return same


def runs_of(codes: np.ndarray, sizes: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, ordered by document, start and period.

    codes: the words of all documents one after another as numbers from 1; sizes: words of each. A run has a length of at
    least max(min_length, 2 * period)."""
    least = max(2, min_length)
    starts = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= least)
    long = long[np.argsort(-sizes[long], kind="stable")]  # for a period, documents long enough come first
    n = sizes[long]
    if not len(n):
        return (np.zeros(0, np.int64),) * 4
    begins = np.cumsum(n + 1) - n
    ends = begins + n
    w = np.zeros(int(ends[-1]) + 1, np.int32)
    doc = np.full(len(w), -1, np.int32)
    spread = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
    w[begins[spread] + inner] = codes[starts[long][spread] + inner]
    doc[begins[spread] + inner] = spread
    last = len(w) - 1
    forward = _Sequence(w, begins, ends)
    backward = _Sequence(np.ascontiguousarray(w[::-1]), last - ends + 1, last - begins + 1)
    found: list[tuple[np.ndarray, ...]] = []

    def resolve(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
        alike = (doc[i] >= 0) & (doc[i] == doc[i + p])
        i, p = i[alike], p[alike]
        own = doc[i]
        after = forward.lce(i, i + p, own)
        # back from the words before both; a terminator ends it
        before = backward.lce(last - (i + p - 1), last - (i - 1), own)
        start, length = i - before, before + after + p
        good = length >= np.maximum(least, 2 * p)
        found.append(_smallest(own[good], start[good], length[good], p[good]))

    pairs, held = [], 0
    longest = int(n[0])
    root = int(len(w) ** 0.5) + 1
    limit = np.append(ends, 0)[np.searchsorted(-n, -2 * np.arange(longest // 2 + 1), "right") - 1]  # by period: end of the last document that can have it
    near = min(longest // 2, root)
    for p in range(1, near + 1):
        step, end = max(p, least - p), int(limit[p])
        at = np.flatnonzero(w[0 : end - p : step] == w[p:end:step]) * step
        if len(at):
            pairs.append((at, np.full(len(at), p, np.int64)))
            if (held := held + len(at)) > _FLUSH:
                resolve(pairs)
                pairs, held = [], 0
    # longer periods, all of them at once for the k-th place of their grids
    far = np.arange(near + 1, longest // 2 + 1)
    k = 0
    while len(far):
        far = far[(k + 1) * far < limit[far]]  # the limit falls with the period, so what is out stays out
        at = far[w[k * far] == w[(k + 1) * far]]
        if len(at):
            pairs.append((k * at, at))
            if (held := held + len(at)) > _FLUSH:
                resolve(pairs)
                pairs, held = [], 0
        k += 1
    if pairs:
        resolve(pairs)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    own, start, length, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    start = start - begins[own]
    own = long[own]
    order = np.lexsort((period, start, own))
    return own[order], start[order], length[order], period[order]


def _smallest(own, start, length, period) -> tuple[np.ndarray, ...]:
    """Each stretch once, with its smallest period: multiples of it repeat over the same stretch."""
    order = np.lexsort((period, length, start))
    own, start, length, period = own[order].astype(np.int64), start[order], length[order], period[order]
    first = np.ones(len(own), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return own[first], start[first], length[first], period[first]


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string column: bytes of all words without blanks, bytes of each word, its code from 1 (equal for equal
    words of the column, exactly), and the words of each row."""
    raw, offsets = buffers(texts)
    full = WORDS[raw] > 0
    new = full.copy()
    new[1:] &= ~full[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    new[heads] = full[heads]
    start = np.flatnonzero(new)
    place = np.append(0, np.cumsum(full))
    begin = place[start]
    packed = raw[full]
    size = np.diff(np.append(begin, len(packed)))
    at = np.append(begin, len(packed)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])
    codes = column.dictionary_encode().indices.to_numpy() + 1 if len(start) else np.zeros(0, np.int32)
    sizes = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(texts))[: len(texts)]
    return packed, size, codes.astype(np.int32), sizes.astype(np.int64)


def joined(packed: np.ndarray, size: np.ndarray, sizes: np.ndarray, kept: np.ndarray):
    """Kept words of each row joined by one space, as an Arrow column."""
    rows = np.repeat(np.arange(len(sizes)), sizes)[kept]
    lens = size[kept]
    out = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    out[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = packed[np.repeat(kept, size)]
    # a space stands behind each word; the one behind a row's last word is cut off
    total = np.append(0, np.cumsum(lens + 1))
    n = np.bincount(rows, minlength=len(sizes))
    last = np.cumsum(n)
    inner = np.ones(len(out), bool)
    inner[total[last[n > 0]] - 1] = False
    ends = np.append(0, np.cumsum(np.where(n > 0, total[last] - total[last - n] - 1, 0)))
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[inner]))]).cast(pa.string())


def find_runs(docs: DataFrame, keep: list | None = None, text_col: str = "text", min_length: int = 12) -> DataFrame:
    """All rows of docs, its columns (or those in keep), and

    runs: array of (start, length, period), numbers of words from 0, ordered by start and period: every stretch of at least
    max(min_length, 2 * period) words whose smallest period is period and which no neighbouring word extends keeping it;
    collapsed: the words joined by one space, without those that lie in a run after its first period words.

    Words are what blanks (U+0020, U+0009 to U+000D) separate. Null and empty texts have no runs and an empty collapsed
    text. Rows are independent, so repeated rows and repeated or null ids give a result each. Columns that have these
    names already get theirs with underscores. There is no shuffle; a task works on some megabytes of text at a time, or
    on one text where that is longer."""
    keep = [c for c in keep or docs.columns if c in docs.columns]
    kept = docs.select(*keep)
    runs_name, text_name = fresh(kept, "runs", "collapsed")
    body, = fresh(kept, "text_of_runs")

    def work(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            packed, size, codes, sizes = words_of(batch.column(body))
            own, start, length, period = runs_of(codes, sizes, min_length)
            change = np.zeros(len(codes) + 1, np.int64)
            base = (np.cumsum(sizes) - sizes)[own] + start
            np.add.at(change, base + period, 1)
            np.add.at(change, base + length, -1)
            stays = np.cumsum(change[:-1]) == 0
            ends = np.append(0, np.cumsum(np.bincount(own, minlength=len(sizes)))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), items), joined(packed, size, sizes, stays)],
                names=[*keep, runs_name, text_name],
            )

    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    shape = T.StructType([*kept.schema.fields, T.StructField(runs_name, T.ArrayType(run)), T.StructField(text_name, T.StringType())])
    return docs.select(*keep, docs[text_col].alias(body)).mapInArrow(work, shape)
