"""Text analysis and the inverted index, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.storage import numbered, written
from sparkseek.functions.text import MARKS, STOPWORDS, normalized, porter_stem, token_array, with_stems


#: Documents of a block: 2 to this power.
_BLOCK_BITS = 3
#: Blocks of a pack of postings: 2 to this power.
_PACK_BITS = 6
_STEMS_KEPT = 200_000


class Index(NamedTuple):
    """postings(key, doc_id, tf, and positions where asked for), doc_stats(doc_id, len), term_stats(key, df).

    A stored index has more: postings also (seg, block, len, lines, and bounds of blocks); documents(doc_id, len, size, mtime), with a row of
    length 0 for a document without words; blocks(key, seg, block, n, max_tf, max_share, first_doc); stored(doc_id, words);
    pages(doc_id, page, text); boxes(doc_id, word, line, x, y, w, h); scope: number of documents with words, and all words."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    documents: DataFrame | None = None
    blocks: DataFrame | None = None
    stored: DataFrame | None = None
    pages: DataFrame | None = None
    boxes: DataFrame | None = None
    scope: tuple[int, int] | None = None


def tokens(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, raw, norm): a row for each word; null and empty texts have none."""
    return corpus.select(F.col(id_col).alias("doc_id"), F.posexplode(token_array(F.col(text_col))).alias("pos", "raw")).withColumn("norm", normalized(F.col("raw")))


def vocabulary_keys(norms: DataFrame, stem: bool = True) -> DataFrame:
    """(norm, key) of the distinct norms: each distinct word is stemmed once."""
    distinct = norms.select("norm").where(F.col("norm") != "").distinct()
    return with_stems(distinct, "norm") if stem else distinct.withColumn("key", F.col("norm"))


def keyed(words: DataFrame, stem: bool) -> DataFrame:
    """Words with norm and their key."""
    words = words.where(F.col("norm") != "")
    return with_stems(words, "norm") if stem else words.withColumn("key", F.col("norm"))


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, ord, norm, key, is_last, ranked) from queries(query_id, query_text).

    Terms of one character go, repeated ones count once at their first place, and stopwords go unless a query has
    nothing else: then they stay and ranked is false. A query without usable terms has no rows."""
    words = (
        queries.select("query_id", F.posexplode(token_array(F.col("query_text"))).alias("pos", "raw"))
        .withColumn("norm", normalized(F.col("raw"))).where(F.length("norm") >= 2)
        .groupBy("query_id", "norm").agg(F.min("pos").alias("pos"))
        .withColumn("stopword", F.col("norm").isin(STOPWORDS))
    )
    per_query = Window.partitionBy("query_id")
    words = words.withColumn("ranked", F.max(~F.col("stopword")).over(per_query)).where(~F.col("ranked") | ~F.col("stopword"))
    words = words.withColumn("ord", F.row_number().over(per_query.orderBy("pos")) - 1)
    words = words.withColumn("is_last", F.col("ord") == F.max("ord").over(per_query))
    return keyed(words, stem).select("query_id", "ord", "norm", "key", "is_last", "ranked")


def build_index(corpus: DataFrame, stem: bool = True, id_col: str = "doc_id", text_col: str = "text", positions: bool = True) -> Index:
    """The tables that searches read. One shuffle, of postings: a document's words are counted where its text is read.
    Ranked search needs no positions; without them counting is much cheaper."""
    words = keyed(tokens(corpus, id_col, text_col), stem)
    counts = [F.count("*").alias("tf"), *([F.array_sort(F.collect_list("pos")).alias("positions")] if positions else [])]
    return with_statistics(words.groupBy("key", "doc_id").agg(*counts))


def doc_blocks(ids: DataFrame) -> DataFrame:
    """(doc_id, block) of distinct ids, written: documents in order of their ids, 2 ** _BLOCK_BITS to a block. Blocks are in the
    order of their documents and have no gap within a range of ids."""
    ordered = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), _BLOCK_BITS)))


class Batch(NamedTuple):
    """What a store makes an index of: words(doc_id, block, len, size, mtime, words, lines), the words of each document and the
    line of each, once; pages and boxes as an Index has them."""

    words: DataFrame
    stem: bool
    pages: DataFrame | None = None
    boxes: DataFrame | None = None


def analysed(corpus: DataFrame, stem: bool = True, pages: DataFrame | None = None, boxes: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Batch:
    """The words of corpus(doc_id, text, and size and mtime where it has them) for a store. One shuffle: texts are sorted by id
    over ranges, and numbered and split in that order, in which words come out.

    A document without words has a row of length 0. Rows without an id are left out; of several rows with one id one is
    taken. Of pages(doc_id, page, text) blank ones are left out."""
    meta = [F.col(c) if c in corpus.columns else F.lit(None).cast("long").alias(c) for c in ("size", "mtime")]
    texts = corpus.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *meta)
    lines = F.flatten(F.transform("by_line", lambda words, line: F.array_repeat(line, F.size(words))))
    real = lambda w: (F.octet_length(w) == F.length(w)) | (F.regexp_replace(w, f"[{MARKS}]", "") != "")
    once = texts.where("doc_id IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id").dropDuplicates(["doc_id"])
    words = once.withColumn("block", F.shiftright(F.monotonically_increasing_id(), _BLOCK_BITS)).withColumn("by_line", F.transform(F.split("text", "\n"), token_array))
    words = words.select("doc_id", "block", "size", "mtime", F.flatten("by_line").alias("words"), lines.alias("lines"))
    words = words.withColumn("len", F.size(F.filter("words", real)))
    return Batch(words, stem, None if pages is None else pages.select("doc_id", "page", "text").where(F.trim("text") != ""), boxes)


def packed_postings(words: DataFrame, stem: bool) -> DataFrame:
    """(key, first, doc_ids, short, data): the postings of words as a Batch has them, in packs. A pack has what the documents of
    an Arrow batch, of at most 2 ** _PACK_BITS blocks, have of a key; first is the first one's block. Words are grouped where they are read, by a stable sort of their
    codes, so no occurrence is shuffled or spilled alone; distinct words are stemmed once for a task. The documents of a batch
    are taken some packs' blocks at a time, so that what is sorted in memory doesn't grow with the batch.

    data begins with the place of each document's record: its block, counted from first, its length, tf, n, positions and
    lines. n is 0 but for the first document of a block: how many have the key there. Then their largest tf follows, and
    the tf and length of the one with the largest share. Where all these numbers have two bytes, they are in short instead."""
    ids = words.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = lambda *columns: np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
        before = lambda counts: np.cumsum(counts) - counts
        stems: dict = {}

        def parts(full: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            starts = changes(full.column("block").to_numpy() >> _PACK_BITS)
            cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, 1 << _BLOCK_BITS + _PACK_BITS))]).tolist()
            for at, end in zip(cuts, [*cuts[1:], full.num_rows], strict=True):
                yield full.slice(at, end - at)

        for batch in (part for full in batches for part in parts(full)):
            n_words = batch.column("norms").value_lengths().to_numpy(zero_copy_only=False)
            norms = batch.column("norms").flatten().dictionary_encode()
            code, keys = norms.indices.to_numpy(), norms.dictionary
            if stem:
                if len(stems) > _STEMS_KEPT:
                    stems.clear()
                stemmed = pa.array([stems[w] if w in stems else stems.setdefault(w, porter_stem(w)) for w in keys.to_pylist()], pa.string()).dictionary_encode()
                code, keys = stemmed.indices.to_numpy()[code], stemmed.dictionary
            order = np.argsort(code, kind="stable")
            if (none := keys.index("").as_py()) >= 0:
                order = order[code[order] != none]
            if not len(order):
                continue
            code, doc = code[order], np.repeat(np.arange(len(n_words)), n_words)[order]
            position, line = order - before(n_words)[doc], batch.column("lines").flatten().to_numpy()[order]
            at = changes(code, doc)  # where postings begin
            tf, code, doc = np.diff(np.append(at, len(doc))), code[at], doc[at]
            block, size = batch.column("block").to_numpy()[doc], batch.column("len").to_numpy()[doc]
            first = changes(code, block >> _PACK_BITS)  # where packs begin
            n = np.diff(np.append(first, len(at)))
            of = np.repeat(np.arange(len(first)), n)
            opens = changes(code, block)  # where blocks begin
            n_here, share = np.diff(np.append(opens, len(at))), tf / np.maximum(size, 1)
            highest = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, opens), n_here))
            highest = highest[changes(np.repeat(np.arange(len(opens)), n_here)[highest])]
            length = 4 + 2 * tf
            length[opens] += 3
            whole = n + np.add.reduceat(length, first)
            base, record = before(whole), before(length)
            record += (base + n - record[first])[of]
            data = np.zeros(whole.sum(), np.int32)
            data[base[of] + np.arange(len(of)) - first[of]] = record - base[of]
            data[record], data[record + 1], data[record + 2] = block - block[first][of], size, tf
            data[record[opens] + 3] = n_here
            for k, values in enumerate((np.maximum.reduceat(tf, opens), tf[highest], size[highest])):
                data[(record + 4 + 2 * tf + k)[opens]] = values
            place = np.repeat(record + 4 - at, tf) + np.arange(len(position))
            data[place], data[place + np.repeat(tf, tf)] = position, line
            long = np.maximum.reduceat(data, base) >= 1 << 15
            listed = lambda values, ends, mask=None: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)

            def only(some: np.ndarray, kind: type) -> pa.Array:
                return listed(pa.array(data[np.repeat(some, whole)].astype(kind)), np.append(0, np.cumsum(whole * some)), pa.array(~some))

            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(code[first])), pa.array(block[first]), listed(batch.column("doc_id").take(pa.array(doc)), np.append(first, len(at))), only(~long, np.int16), only(long, np.int32)],
                ["key", "first", "doc_ids", "short", "data"],
            )

    norms = F.transform("words", normalized).alias("norms")
    return words.select("doc_id", "block", "len", norms, "lines").mapInArrow(pack, f"key string, first long, doc_ids array<{ids}>, short array<smallint>, data array<int>")


def unpacked(packs: DataFrame) -> DataFrame:
    """(key, doc_id, block, len, tf, positions, lines, n, max_tf, max_share) of packs, in their order: where each key stands, by
    numbers of words and of lines; and, with the first document of a block, the bounds of the key in the block."""
    each = packs.withColumn("data", F.coalesce("data", F.col("short").cast("array<int>"))).drop("short").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("doc_ids") - 1)))
    at = lambda more: F.get("data", F.get("data", F.col("k")) + more)
    tf, opens = at(2), at(3) > 0
    places = lambda shift: F.slice("data", F.get("data", F.col("k")) + 5 + shift, tf)
    bound = lambda value: F.when(opens, value)
    return each.select(
        "key", F.get("doc_ids", F.col("k")).alias("doc_id"), (F.col("first") + at(0)).alias("block"), at(1).alias("len"), tf.cast("long").alias("tf"), places(0).alias("positions"), places(tf).alias("lines"),
        bound(at(3).cast("long")).alias("n"), bound(at(2 * tf + 4).cast("long")).alias("max_tf"), bound(at(2 * tf + 5) / at(2 * tf + 6)).alias("max_share"),
    )


def with_bounds(postings: DataFrame, run: Column) -> DataFrame:
    """postings(key, doc_id, block, len, tf, positions, lines) dealt by key and run, a number that whole blocks share, and sorted,
    with the bounds that unpacked() gives."""
    dealt = postings.withColumn("run", run).repartition("key", "run")
    block = Window.partitionBy("key", "run", "block")
    nth = F.row_number().over(block.orderBy("doc_id"))
    bounds = {"n": F.count("*").over(block), "max_tf": F.max("tf").over(block), "max_share": F.max(F.col("tf") / F.col("len")).over(block)}
    every = dealt.withColumns({"nth": nth} | bounds)
    return every.withColumns({c: F.when(F.col("nth") == 1, F.col(c)) for c in bounds}).drop("run", "nth").sortWithinPartitions("key", "block", "doc_id")


def with_statistics(postings: DataFrame) -> Index:
    """Postings with the statistics of documents and terms that follow from them."""
    doc_stats = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    term_stats = postings.groupBy("key").agg(F.count("*").alias("df"))
    return Index(postings, doc_stats, term_stats)


def rank_vocabulary(vocab: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """(rank, word, df) of the words of vocab(word, df) that lemmas(word) has (None: of all), from frequent to rare. Words are
    sorted over ranges of frequency and word, so those of one frequency, most of any vocabulary, are in many tasks."""
    kept = vocab if lemmas is None else vocab.join(lemmas.select("word").distinct(), "word", "left_semi")
    return numbered(kept.select("word", "df"), [-F.col("df"), F.col("word")], "rank").select("rank", "word", "df")


def vocabulary_counts(vocab: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(kept, dropped): how many words rank_vocabulary keeps and drops."""
    known = lemmas.select("word", F.lit(1).alias("known")).distinct()
    return vocab.join(known, "word", "left").agg(F.count("known").alias("kept"), F.count_if(F.col("known").isNull()).alias("dropped"))
