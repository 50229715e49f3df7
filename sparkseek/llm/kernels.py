"""Array kernels for tasks: hashed tokens and n-grams of Arrow text columns, without a Python step for each word."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return mix64((code + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _classes(blanks_only: bool) -> np.ndarray:
    kind = np.ones(256, dtype=np.uint8)
    if not blanks_only:
        kind[:128] = 2
        kind[48:58] = kind[65:91] = kind[97:123] = 1
    kind[9:14] = kind[32] = 0
    return kind


#: By byte: 0 for blanks, 1 for all others.
WORDS = _classes(True)
#: By byte: 0 for blanks, 1 for letters, digits and all of a character beyond ASCII, 2 for ASCII punctuation.
WORDS_AND_MARKS = _classes(False)
#: By byte: 1 for letters, digits and all of a character beyond ASCII.
ALNUM = np.where(WORDS_AND_MARKS == 1, 1, 0).astype(np.uint8)
FOLDED, EXACT = _byte_values(True), _byte_values(False)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, _BLOCK), base, dtype=np.uint64)
        full[0] = 1
        cache[base] = have = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and where each row starts and the last ends. Nulls are empty."""
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, values: np.ndarray = FOLDED, places: bool = False):
    """Hash and row of every token, in order: maximal runs of bytes of one class other than 0 within a row.

    With places, also where tokens start and end in raw. Works in blocks of some 0.5 MB that end between tokens."""
    out, at, n = [], 0, len(raw)
    row_start = offsets[:-1][np.diff(offsets) > 0]
    while at < n:
        to = min(n, at + _BLOCK)
        while to < n:  # back to the start of a row or a blank, or on to one
            k = np.searchsorted(row_start, to, "right")
            row = row_start[k - 1] if k else 0
            gap = np.flatnonzero(classes[raw[max(at + 1, row, to - 65536) : to]] == 0)
            if row > at or len(gap):
                to = max(row, max(at + 1, row, to - 65536) + gap[-1] if len(gap) else 0)
                break
            to = min(n, to + 65536)
            if len(gap := np.flatnonzero(classes[raw[at:to]] == 0)):
                to = at + gap[-1] + (gap[-1] == 0)
                break
        out.append(_block(raw, at, to, row_start, classes, values))
        at = to
    start, end, hashed = (np.concatenate(x) if out else np.zeros(0, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (np.int64, np.int64, np.uint64), strict=True))
    rows = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    return (hashed, rows, start, end) if places else (hashed, rows)


def _block(raw, at, to, row_start, classes, values):
    part = raw[at:to]
    kind = classes[part]
    new = np.empty(len(part), dtype=bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    inside = row_start[np.searchsorted(row_start, at) : np.searchsorted(row_start, to)] - at
    new[inside] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(part))
    full = kind[start] > 0
    start, end = start[full], end[full]
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(values[part] * _powers(_R, len(part)), out=total[1:])
    hashed = (total[end] - total[start]) * _powers(_R_INVERSE, len(part) + 1)[start]
    return start + at, end + at, mix64(hashed + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def ngrams(hashed: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of n tokens within a row."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    last = len(hashed) - n + 1
    total = np.full(last, n, dtype=np.uint64)
    for k in range(n):
        total = mix64(total + hashed[k : k + last] * np.uint64(0x8EBC6AF09C88C6E3))
    whole = rows[:last] == rows[n - 1 :]
    return total[whole], rows[:last][whole]


def shingle_sets(texts, width: int):
    """For every row of an Arrow text column its sorted distinct shingles, as 64-bit hashes of A-Z folded words.

    A row of fewer words than width has its whole sequence as one shingle, a row without words none."""
    raw, offsets = buffers(texts)
    hashed, rows = tokens(raw, offsets)
    n_words = np.bincount(rows, minlength=len(texts))
    grams, gram_rows = ngrams(hashed, rows, width)
    ends, word_ends = np.cumsum(np.bincount(gram_rows, minlength=len(texts))), np.cumsum(n_words)
    for k in range(len(texts)):
        if n_words[k] >= width:
            yield np.unique(grams[(ends[k - 1] if k else 0) : ends[k]])
        elif n_words[k]:
            words = hashed[word_ends[k] - n_words[k] : word_ends[k]]
            yield ngrams(words, np.zeros(len(words), np.int32), len(words))[0]
        else:
            yield np.zeros(0, np.uint64)


def slices(batch, most_bytes: int = 2_000_000):
    """Parts of a record batch of some megabytes, so that what is made of a part stays small whatever the batch."""
    size = max(1, batch.num_rows * most_bytes // max(most_bytes, batch.nbytes))
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


class Frequent:
    """The most frequent of many 64-bit keys, in bounded memory: beyond 4 * size keys, the 2 * size most frequent so far
    are kept. Counts are what was seen of a key since it was last let go."""

    def __init__(self, size: int):
        self.size, self.keys, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        self.counts[spot[known]] += counts[known]
        if not known.all():
            self.keys = np.insert(self.keys, spot[~known], keys[~known])
            self.counts = np.insert(self.counts, spot[~known], counts[~known])
        if len(self.keys) > 4 * self.size:
            top = np.sort(np.argpartition(self.counts, -2 * self.size)[-2 * self.size :])
            self.keys, self.counts = self.keys[top], self.counts[top]

    def at_least(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        often = self.counts >= least
        return self.keys[often], self.counts[often]
