"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are words and runs of punctuation, with case; unigrams and bigrams are hashed to 2**bits places, where a token
that follows itself makes the same bigram whichever token it is. A document's
vector has for each place its share of all the document's n-grams, times a fixed scale, so long and short texts weigh
alike; its score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.kernels import EXACT, WORDS_AND_MARKS, buffers, ngrams, slices, tokens

BITS = 18
SCALE = 8.0
#: The bigram of a token and itself, whichever it is.
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def places(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of every unigram and bigram of an Arrow text column, by row, and how many each row has."""
    hashed, rows = tokens(*buffers(texts), classes=WORDS_AND_MARKS, values=EXACT)
    pairs, pair_rows = ngrams(hashed, rows, 2)
    again = (hashed[1:] == hashed[:-1])[rows[1:] == rows[:-1]]
    pairs[again] = _AGAIN
    both = np.concatenate([hashed, pairs]) >> np.uint64(64 - bits)
    both_rows = np.concatenate([rows, pair_rows])
    order = np.argsort(both_rows, kind="stable")
    return both[order].astype(np.int32), np.bincount(both_rows, minlength=len(texts))


def ftrl(rows, bits: int = BITS, epochs: int = 3, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.01) -> np.ndarray:
    """Weights, the last one the intercept, from rows of (places, shares, label), taken in their order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rows = [(np.append(at, 1 << bits), np.append(share, 1.0), label) for at, share, label in rows]
    for _ in range(epochs):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, bits: int = BITS, epochs: int = 3,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled documents: at most max_rows labels, the first in the order of a hash of their id.

    Labels that are null or of ids without a document are left out. Several labels of an id, agreeing or not, are an
    example each, and so are several documents of an id. Updates run in one task, over that bounded sample,
    in the order of the hash. Without any label all weights are 0 and every score is 0.5."""
    order = [F.xxhash64("id"), "id", "label"]
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(*order).limit(max_rows)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # max_rows short rows at most

    def vectors(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            at, count = places(batch.column("text"), bits)
            ends = np.cumsum(count)
            found = [np.unique(at[e - c : e], return_counts=True) for e, c in zip(ends, count, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary())],
                names=["id", "label", "places", "counts"],
            )

    def learn(batches):
        rows = []
        for batch in batches:
            for label, at, count in zip(*(batch.column(c).to_pylist() for c in ("label", "places", "counts")), strict=True):
                count = np.frombuffer(count, np.int32)
                rows.append((np.frombuffer(at, np.int32), count * (SCALE / max(1, count.sum())), label))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(rows, bits, epochs).astype(np.float64).tobytes()], pa.binary())})

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = (
        sample.select("id", "label", "text").mapInArrow(vectors, f"id {id_type}, label int, places binary, counts binary")
        .repartition(1).sortWithinPartitions(*order, F.xxhash64("places", "counts"))
        .mapInArrow(learn, "weights binary").collect()
    )  # one row of fixed size
    return np.frombuffer(rows[0]["weights"], np.float64) if rows else np.zeros((1 << bits) + 1)


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list | None = None, text_col: str = "text") -> DataFrame:
    """All rows of docs, its columns (or those in keep), and score: the probability of label 1, from 0 to 1.

    Null and empty texts get the score of the intercept alone. A column of docs named score is replaced."""
    docs = docs.drop("score")
    keep = [c for c in keep or docs.columns if c in docs.columns]
    bits = (len(weights) - 1).bit_length() - 1
    weights = weights.astype(np.float32)

    def predict(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            at, count = places(batch.column(text_col), bits)
            total = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
            ends = np.cumsum(count)
            logit = weights[-1] + SCALE * (total[ends] - total[ends - count]) / np.maximum(count, 1)
            score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return docs.mapInArrow(predict, docs.select(*keep).schema.add("score", "double"))
