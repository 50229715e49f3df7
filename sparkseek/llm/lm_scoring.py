"""Language-model scoring by cross-entropy difference.

Two bigram models with the same vocabulary, order and smoothing, one of target documents and one of all the others,
score every document; what counts is the difference of their losses by token. Every document is scored by counts
without its own, so none is judged by what it put into a model itself.

P(w | v) = (count(v w) + mass / V) / (count(v) + mass), V the number of distinct words. The logarithm falls into a term
of the bigram and one of its context, so each key (bigram or context) needs its own counts only. Keys of a document are
dealt by hash in packed rows, some three million to a bucket; a bucket counts its keys over all documents and sends back
sums of terms. Keys that are common (at most _COMMON of them) are counted first, by pre-aggregation, and broadcast;
their terms are added where the documents are, so that no bucket gets a row for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, scratch
from sparkseek.llm.kernels import ALNUM, FOLDED, buffers, mix64, slices, tokens
from sparkseek.llm.ngram_join import _lists

_PER_BUCKET = 3_000_000
_COMMON = 65_536
_START = np.uint64(0x3C6EF372FE94F82B)
_REGISTERS = 14


def document_keys(texts):
    """Of every row of an Arrow text column, its keys and how often it has them: (keys, counts, row) sorted by row, and
    the number of tokens by row. The lowest bit of a key tells contexts (1) from bigrams (0)."""
    hashed, row = tokens(*buffers(texts), classes=ALNUM, values=FOLDED)
    context = np.append(_START, hashed[:-1]) if len(hashed) else hashed
    if len(hashed):  # there may be texts without a token only
        context[np.append(True, row[1:] != row[:-1])] = _START
    pair = mix64(context * np.uint64(0x9FB21C651E98DF25) + hashed) & ~np.uint64(1)
    keys, rows = np.concatenate([pair, mix64(context) | np.uint64(1)]), np.concatenate([row, row])
    ends, begin = np.searchsorted(row, np.arange(len(texts)), "right"), 0
    out_keys, out_counts, n_keys = [], [], np.zeros(len(texts), np.int64)
    n = len(hashed)
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            own, count = np.unique(np.concatenate([keys[begin:end], keys[n + begin : n + end]]), return_counts=True)
            out_keys.append(own)
            out_counts.append(count)
            n_keys[k] = len(own)
        begin = end
    empty = np.zeros(0, np.int64)
    del rows
    return (np.concatenate(out_keys) if out_keys else empty.astype(np.uint64), np.concatenate(out_counts) if out_counts else empty,
            np.repeat(np.arange(len(texts)), n_keys), np.bincount(row, minlength=len(texts)), hashed)


def vocabulary_size(registers: np.ndarray) -> float:
    """Distinct values by the HyperLogLog estimate of its registers, with linear counting of few."""
    m = len(registers)
    estimate = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -registers)
    zeros = int((registers == 0).sum())
    return m * np.log(m / zeros) if estimate <= 2.5 * m and zeros else float(estimate)


def _terms(keys, own, target, in_target, in_other, mass, size):
    """Loss terms of both models for entries: own is what the scored document itself has put into in_target or in_other."""
    is_context = (keys & np.uint64(1)).astype(bool)
    add, sign = np.where(is_context, mass, mass / size), np.where(is_context, 1.0, -1.0)
    return (sign * own * np.log(np.maximum(in_target - np.where(target, own, 0), 0) + add), sign * own * np.log(np.maximum(in_other - np.where(target, 0, own), 0) + add))


def cross_entropy_difference(docs: DataFrame, mass: float = 10.0, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target") -> DataFrame:
    """For every row of docs (id_col, target_col, n_tokens, target_loss, other_loss, difference): losses by token, in
    nats, of the model of rows whose target_col is true and of that of all other rows; a low difference is near target.

    Tokens are runs of letters and digits, A-Z lower-cased. A text without tokens, null or empty, has 0 tokens and null
    losses. A null target_col counts as false. Without any target row its model is uniform. Repeated rows are scored
    alike, each without one of them only: the other copies stay in the model and vote for it, so texts that occur twice
    or more score lower losses than others. Deduplicate first where that matters. Rows without an id are rows like
    others. Keys are compared by 48 bits within a bucket."""
    with scratch(docs.sparkSession) as keep:
        return keep(_scored(docs, mass, id_col, text_col, target_col))


def _scored(docs: DataFrame, mass: float, id_col: str, text_col: str, target_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(target_col, F.lit(False)).alias("target"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    slim = rows.select("row", "target", "text")

    def survey(batches):
        """Registers of the vocabulary, the number of entries, and the keys that are common in this task."""
        registers, entries = np.zeros(1 << _REGISTERS, np.int64), 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                found, count, _, _, words = document_keys(part.column("text"))
                place, rest = (words >> np.uint64(64 - _REGISTERS)).astype(np.int64), (words << np.uint64(_REGISTERS)) >> np.uint64(32)
                zeros = 33 - np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
                np.maximum.at(registers, place, zeros)
                entries += len(found)
                both, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, count]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > 4 * _COMMON:
                    top = np.argpartition(counts, -2 * _COMMON)[-2 * _COMMON :]
                    top.sort()
                    keys, counts = keys[top], counts[top]
        top = np.flatnonzero(counts >= 16)
        seen = np.flatnonzero(registers)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(seen), 0), np.full(len(top), 1), [2]]).astype(np.int32)), pa.array(np.concatenate([seen, keys[top].view(np.int64), [0]]).astype(np.int64)), pa.array(np.concatenate([registers[seen], counts[top], [entries]]).astype(np.int64))],
            names=["kind", "k", "v"],
        )

    surveyed = cut(
        slim.select("text").mapInArrow(survey, "kind int, k long, v long")
        .groupBy("kind", "k").agg(F.max("v").alias("most"), F.sum("v").alias("total"))
    )
    registers = np.zeros(1 << _REGISTERS)
    for r in surveyed.where("kind = 0").collect():  # at most 2**14 rows
        registers[r["k"]] = r["most"]
    size = vocabulary_size(registers)
    entries = surveyed.where("kind = 2").agg(F.sum("total")).first()[0] or 0
    common = np.sort(surveyed.where("kind = 1").orderBy(F.desc("total"), "k").limit(_COMMON).select("k").toPandas()["k"].to_numpy(np.int64).view(np.uint64))  # _COMMON numbers
    told = spark.sparkContext.broadcast(common)

    def find(keys, common):
        spot = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
        return spot, (common[spot] == keys if len(common) else np.zeros(len(keys), bool))

    def count_common(batches):
        common = told.value
        totals = np.zeros((2, len(common)), np.int64)
        for batch in batches:
            for part in slices(batch):
                keys, count, row, _, _ = document_keys(part.column("text"))
                target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)[row]
                spot, known = find(keys, common)
                for which, mask in enumerate((known & target, known & ~target)):
                    totals[which] += np.bincount(spot[mask], count[mask], len(common)).astype(np.int64)[: len(common)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(common))), pa.array(totals[0]), pa.array(totals[1])], names=["k", "a", "b"])

    exact = np.zeros((2, max(1, len(common))))
    if len(common):
        for r in slim.select("target", "text").mapInArrow(count_common, "k long, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            exact[:, r["k"]] = r["a"], r["b"]
    model = spark.sparkContext.broadcast((common, exact))
    buckets = max(64, -(-entries // _PER_BUCKET))
    dealt_schema = "bucket int, rows binary, targets binary, lengths binary, keys binary, counts binary, sums binary"
    names = [c.split()[0] for c in dealt_schema.split(", ")]

    def deal(batches):
        """Keys by bucket, and for buckets below 0 the sums of terms of common keys and numbers of tokens."""
        common, exact = model.value
        for batch in batches:
            for part in slices(batch):
                keys, count, row, n_tokens, _ = document_keys(part.column("text"))
                ids, is_target = part.column("row").to_numpy(), part.column("target").to_numpy(zero_copy_only=False).astype(bool)
                out = {c: [] for c in names}
                spot, known = find(keys, common)
                sums = np.zeros((len(ids), 3))
                sums[:, 2] = n_tokens
                if known.any():
                    terms = _terms(keys[known], count[known], is_target[row[known]], exact[0][spot[known]], exact[1][spot[known]], mass, size)
                    for which, term in enumerate(terms):
                        sums[:, which] += np.bincount(row[known], term, len(ids))
                place = mix64(ids.view(np.uint64)) % np.uint64(buckets)
                for b in np.unique(place):
                    mine = place == b
                    for name, value in zip(names, (-1 - int(b), ids[mine].tobytes(), b"", b"", b"", b"", sums[mine].tobytes()), strict=True):
                        out[name].append(value)
                keys, count, row = keys[~known], count[~known], row[~known]
                bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket * len(ids) + row, kind="stable")
                keys, count, row, bucket = keys[order], count[order], row[order], bucket[order]
                if len(keys):
                    run = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])))
                    length = np.diff(np.append(run, len(keys))).astype(np.int32)
                    edge = np.flatnonzero(np.append(True, bucket[run][1:] != bucket[run][:-1]))
                    short = keys.view(np.uint8).reshape(-1, 8)[:, :6]
                    for a, b in zip(edge.tolist(), np.append(edge[1:], len(run)).tolist(), strict=True):
                        first, last, owner = run[a], run[a] + length[a:b].sum(), row[run[a:b]]
                        for name, value in zip(names, (int(bucket[first]), ids[owner].tobytes(), is_target[owner].tobytes(), length[a:b].tobytes(), short[first:last].tobytes(), count[first:last].astype(np.int32).tobytes(), b""), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names[1:])]))

    back = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("sums", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        if number < 0:
            return pa.Table.from_arrays([pa.array([-1 - number] * len(table), pa.int32()), table.column("rows"), table.column("sums")], schema=back)
        length = _lists(table.column("lengths"), np.int32)
        keys = np.zeros((length.sum(), 8), np.uint8)
        keys[:, :6] = _lists(table.column("keys"), np.uint8).reshape(-1, 6)
        keys, own = keys.view(np.uint64).ravel(), _lists(table.column("counts"), np.int32).astype(np.float64)
        ids, target = _lists(table.column("rows"), np.int64), _lists(table.column("targets"), np.bool_)
        run = np.repeat(np.arange(len(length), dtype=np.int32), length)
        order = np.argsort(keys, kind="stable")
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(np.append(False, keys[order][1:] != keys[order][:-1]))
        mine = target[run]
        in_target, in_other = np.bincount(group, own * mine), np.bincount(group, own * ~mine)
        sums = np.zeros((len(length), 3))
        for which, term in enumerate(_terms(keys, own, mine, in_target[group], in_other[group], mass, size)):
            sums[:, which] = np.bincount(run, term, len(length))
        part = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ids, sums, part = ids[order], sums[order], part[order]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        bounds = list(zip(edge.tolist(), np.append(edge[1:], len(part)).tolist(), strict=True))
        return pa.Table.from_pydict({"part": [int(part[a]) for a, _ in bounds], "rows": [ids[a:b].tobytes() for a, b in bounds], "sums": [sums[a:b].tobytes() for a, b in bounds]}, schema=back)

    def gather(table: pa.Table) -> pa.Table:
        ids, where = np.unique(_lists(table.column("rows"), np.int64), return_inverse=True)
        sums = _lists(table.column("sums"), np.float64).reshape(-1, 3)
        a, b, n = (np.bincount(where, sums[:, k], len(ids)) for k in range(3))
        return pa.Table.from_arrays([pa.array(ids), pa.array(a), pa.array(b), pa.array(np.rint(n).astype(np.int64))], names=["row", "a", "b", "n"])

    scored = (
        slim.mapInArrow(deal, dealt_schema).groupBy("bucket").applyInArrow(count, "part int, rows binary, sums binary")
        .groupBy("part").applyInArrow(gather, "row long, a double, b double, n long")
    )
    loss = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return rows.select("id", "target", "row").join(scored, "row").select(
        F.col("id").alias(id_col), F.col("target").alias(target_col), F.col("n").alias("n_tokens"),
        loss("a").alias("target_loss"), loss("b").alias("other_loss"), (loss("a") - loss("b")).alias("difference"),
    )
