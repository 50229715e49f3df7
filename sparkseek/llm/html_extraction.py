"""Main text of web pages: a recurrent labeller reads the blocks of a page from both ends and classifies each.

A block is a leaf of the page's tree with text (html_blocks). It is read as the tags and class words on its path, the hashed
words of its text and a few counts. Two LSTMs, one from the first block on and one from the last, carry what they have read,
so that each block is judged by the whole page around it; a logistic unit over both states tells main text from the rest.
It is trained on a bounded sample of pages that mark their article, and on as many pages made from their texts in other
layouts (html_pages).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.common import fresh
from sparkseek.llm.html_blocks import PLACES, Block, blocks
from sparkseek.llm.html_pages import Maker, marked, read_labels
from sparkseek.llm.kernels import FOLDED, WORDS_AND_MARKS, slices, tokens

HIDDEN, WORD_PLACES, COUNTS = 24, 32, 8
INPUTS = PLACES + WORD_PLACES + COUNTS
#: Blocks whose inputs are in memory at once.
_WINDOW = 1 << 15


class Direction(NamedTuple):
    """An LSTM: gates are input, forget, output and candidate, in this order."""

    inputs: np.ndarray
    states: np.ndarray
    bias: np.ndarray


class Labeller(NamedTuple):
    forward: Direction
    backward: Direction
    out: np.ndarray  # forward states, backward states, bias

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, np.float32).tobytes() for x in (*self.forward, *self.backward, self.out))


_SHAPES = [(INPUTS, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (4 * HIDDEN,)] * 2 + [(2 * HIDDEN + 1,)]


def unpacked(data: bytes) -> Labeller:
    flat, parts, at = np.frombuffer(data, np.float32), [], 0
    for shape in _SHAPES:
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape).copy())
        at += size
    return Labeller(Direction(*parts[:3]), Direction(*parts[3:6]), parts[6])


def inputs(found: list[Block]) -> np.ndarray:
    """What the labeller reads of each block."""
    x = np.zeros((len(found), INPUTS), np.float32)
    at = np.repeat(np.arange(len(found)), [len(b.places) for b in found])
    x[at, np.fromiter((p for b in found for p in b.places), np.int64, len(at))] = 1
    texts = [b.text.encode("utf-8", "replace") for b in found]
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    hashed, rows = tokens(np.frombuffer(b"".join(texts), np.uint8), offsets, WORDS_AND_MARKS, FOLDED)
    count = np.bincount(rows, minlength=len(found))
    place = rows * WORD_PLACES + (hashed % np.uint64(WORD_PLACES)).astype(np.int64)
    sign = np.where(hashed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    bags = np.bincount(place, sign, len(found) * WORD_PLACES).reshape(-1, WORD_PLACES)
    x[:, PLACES : PLACES + WORD_PLACES] = bags / np.sqrt(np.maximum(count, 1))[:, None]
    chars = np.array([len(b.text) for b in found], np.float32)
    rest = x[:, PLACES + WORD_PLACES :]
    rest[:, 0] = np.log1p(chars) / 4
    rest[:, 1] = np.log1p(count) / 3
    rest[:, 2] = np.array([b.linked for b in found]) / np.maximum(chars, 1)
    rest[:, 3] = [b.text[-1:] in ".!?:;。…\"”" for b in found]
    rest[:, 4] = chars > 80
    rest[:, 5] = [b.text[:1] in "©|»•" for b in found]
    rest[:, 6] = count < 4
    rest[:, 7] = [sum(map(str.isdigit, b.text[:64])) / 16 for b in found]
    return x


def _gates(z: np.ndarray) -> np.ndarray:
    """In place: three sigmoids and a tanh."""
    np.clip(z, -30, 30, out=z)
    s = z[:, : 3 * HIDDEN]
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    np.reciprocal(s, out=s)
    np.tanh(z[:, 3 * HIDDEN :], out=z[:, 3 * HIDDEN :])
    return z


def _read(net: Direction, out: np.ndarray, x_of, sizes: np.ndarray, backward: bool) -> np.ndarray:
    """What one direction adds to the logit of every block. sizes: blocks of each page, falling; all pages are read in step,
    the k-th block of each at once, and inputs are made for some steps at a time."""
    starts = np.cumsum(sizes) - sizes
    first = starts + sizes - 1 if backward else starts
    turn = -1 if backward else 1
    logit = np.zeros(int(sizes.sum()), np.float32)
    h, c = np.zeros((len(sizes), HIDDEN), np.float32), np.zeros((len(sizes), HIDDEN), np.float32)
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")  # pages that have a k-th block
    step = 0
    while step < len(active):
        until = step + 1
        held = active[step]
        while until < len(active) and held + active[until] <= _WINDOW:
            held += active[until]
            until += 1
        at = np.concatenate([first[: active[t]] + turn * t for t in range(step, until)])
        z = x_of(at) @ net.inputs + net.bias
        done = 0
        for t in range(step, until):
            n = active[t]
            g = _gates(z[done : done + n] + h[:n] @ net.states)
            c[:n] = g[:, HIDDEN : 2 * HIDDEN] * c[:n] + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
            h[:n] = g[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c[:n])
            logit[at[done : done + n]] = h[:n] @ out
            done += n
        step = until
    return logit


def scores(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of being main text, for all blocks of each page."""
    order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
    flat = [b for k in order for b in pages[k]]
    sizes = np.array([len(pages[k]) for k in order], np.int64)
    if len(flat) <= _WINDOW:
        whole = inputs(flat)
        x_of = whole.__getitem__
    else:
        x_of = lambda at: inputs([flat[i] for i in at])
    logit = _read(model.forward, model.out[:HIDDEN], x_of, sizes, False)
    logit += _read(model.backward, model.out[HIDDEN:-1], x_of, sizes, True) + model.out[-1]
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    out: list = [None] * len(pages)
    for k, part in zip(order, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
        out[k] = part
    return out


def _pass(net: Direction, x: np.ndarray, active: np.ndarray):
    """States of a batch of pages; x: blocks in order of steps. Keeps what the way back needs."""
    n, at, kept = int(active[0]), 0, []
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    z = x @ net.inputs + net.bias
    states = np.empty((len(x), HIDDEN), np.float32)
    for n in active:
        g = _gates(z[at : at + n] + h[:n] @ net.states)
        before, c = c[:n], g[:, HIDDEN : 2 * HIDDEN] * c[:n] + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
        squashed = np.tanh(c)
        kept.append((g, before, squashed, h[:n]))
        h = g[:, 2 * HIDDEN : 3 * HIDDEN] * squashed
        states[at : at + n] = h
        at += n
    return states, kept


def _back(net: Direction, x: np.ndarray, active: np.ndarray, kept: list, slope: np.ndarray) -> Direction:
    """Gradients by backpropagation through time; slope: of the loss by each state."""
    dz = np.empty((len(x), 4 * HIDDEN), np.float32)
    states = np.zeros_like(net.states)
    dh, dc, at = np.zeros((int(active[0]), HIDDEN), np.float32), np.zeros((int(active[0]), HIDDEN), np.float32), len(x)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at -= n
        g, before, squashed, h = kept[t]
        i, f, o, a = (g[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        down = dh[:n] + slope[at : at + n]
        cell = dc[:n] + down * o * (1 - squashed**2)
        d = dz[at : at + n]
        d[:, :HIDDEN] = cell * a * i * (1 - i)
        d[:, HIDDEN : 2 * HIDDEN] = cell * before * f * (1 - f)
        d[:, 2 * HIDDEN : 3 * HIDDEN] = down * squashed * o * (1 - o)
        d[:, 3 * HIDDEN :] = cell * i * (1 - a**2)
        states += h.T @ d
        dh[:n] = d @ net.states.T
        dc[:n] = cell * f
    return Direction(x.T @ dz, states, dz.sum(axis=0))


def learn(pages: list[tuple[list[Block], np.ndarray]], seed: int = 12, epochs: int = 10, size: int = 48, rate: float = 0.01, drop: float = 0.08) -> Labeller:
    """Trains on labelled pages by Adam; the same pages in the same order give the same labeller."""
    random = np.random.default_rng(seed)
    shapes = _SHAPES
    weights = [(random.normal(size=s) * 0.3 / np.sqrt(max(s[0] / 8, 1))).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shapes]
    weights[2][HIDDEN : 2 * HIDDEN] = weights[5][HIDDEN : 2 * HIDDEN] = 1.0
    weights[6][:-1] = random.normal(size=2 * HIDDEN) * 0.3
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pages = [p for p in pages if p[0]]
    read = [(inputs(found), label) for found, label in pages]
    step, n_steps = 0, max(1, epochs * -(-len(read) // size))
    for _ in range(epochs if read else 0):
        order = random.permutation(len(read))
        for begin in range(0, len(order), size):
            batch = sorted((read[k] for k in order[begin : begin + size]), key=lambda p: -len(p[1]))
            sizes = np.array([len(y) for _, y in batch])
            starts = np.cumsum(sizes) - sizes
            active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
            ahead = np.concatenate([starts[:n] + t for t, n in enumerate(active)])
            behind = np.concatenate([starts[:n] + sizes[:n] - 1 - t for t, n in enumerate(active)])
            x, y = np.concatenate([x for x, _ in batch]), np.concatenate([y for _, y in batch])
            x = x * (random.random(x.shape, np.float32) >= drop)
            nets = Direction(*weights[:3]), Direction(*weights[3:6])
            run = [_pass(net, x[at], active) for net, at in zip(nets, (ahead, behind), strict=True)]
            both = np.empty((len(x), 2 * HIDDEN), np.float32)
            both[ahead, :HIDDEN], both[behind, HIDDEN:] = run[0][0], run[1][0]
            logit = both @ weights[6][:-1] + weights[6][-1]
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
            slopes = error[:, None] * weights[6][:-1]
            grads = [
                *_back(nets[0], x[ahead], active, run[0][1], slopes[ahead, :HIDDEN]), *_back(nets[1], x[behind], active, run[1][1], slopes[behind, HIDDEN:]),
                np.append(error @ both, error.sum()),
            ]
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            step += 1
            now = rate * min(1.0, 1.5 * (1 - step / n_steps) + 0.02)
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                weights[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Labeller(Direction(*weights[:3]), Direction(*weights[3:6]), weights[6])


def training_pages(pages: list[str], made: int, seed: int = 12) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of pages that mark their article, and of so many pages made of all pages' texts."""
    out, prose, rest = [], [], []
    for page in pages:
        found = blocks(page)
        if (labels := marked(found)) is not None:
            out.append((found, labels))
            for b, main in zip(found, labels, strict=True):
                (prose if main else rest).append(b.text[:600])
        else:
            prose += [b.text[:600] for b in found if len(b.text) > 80]
            rest += [b.text[:600] for b in found if len(b.text) <= 80]
    maker = Maker(seed, prose, [t for t in rest if len(t) < 200])
    return out + [read_labels(maker.page()) for _ in range(made)]


def train_labeller(pages: DataFrame, html_col: str = "html", max_pages: int = 300, max_chars: int = 100_000, made: int = 1500) -> Labeller:
    """Fits a labeller to at most max_pages different pages of at most max_chars characters, the ones with the smallest
    hashes, in one task. Pages that mark no article give their texts only; without pages only made ones are learned from."""
    hashed = pages.where(F.length(html_col).between(1, max_chars)).select(F.xxhash64(html_col).alias("hash"), F.col(html_col).alias("html"))
    least = hashed.select("hash").distinct().orderBy("hash").limit(max_pages).agg(F.max("hash")).collect()[0][0]
    sample = hashed.where(F.col("hash") <= least) if least is not None else hashed.limit(0)
    sample = sample.groupBy("hash").agg(F.first("html").alias("html"))

    def work(batches):
        kept = [page for batch in batches for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([learn(training_pages(kept, made)).packed()], pa.binary())], names=["model"])

    rows = sample.repartition(1).sortWithinPartitions("hash").select("html").mapInArrow(work, "model binary").collect()  # one row of fixed size
    return unpacked(rows[0]["model"]) if rows else learn(training_pages([], made))


def extract_main_text(pages: DataFrame, model: Labeller, keep: list | None = None, html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """All rows of pages, its columns (or those in keep), and main_text: the blocks that the labeller takes for main text, in
    page order, joined by an empty line; empty where there are none, as in null and empty pages.

    Texts are whole: character references decoded, runs of white space as one space, nothing cut. Rows are independent, so
    repeated rows give the same text each. A column of that name already gets ours with an underscore. There is no shuffle;
    a task works on some megabytes of pages at a time, or on one page where that is longer."""
    keep = [c for c in keep or pages.columns if c in pages.columns]
    kept = pages.select(*keep)
    name, = fresh(kept, "main_text")
    body, = fresh(kept, "html_of_page")
    told = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [blocks(page) for page in batch.column(body).to_pylist()]
            texts = ["\n\n".join(b.text for b, p in zip(page, score, strict=True) if p >= threshold) for page, score in zip(found, scores(told.value, found), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, name])

    return pages.select(*keep, pages[html_col].alias(body)).mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))
