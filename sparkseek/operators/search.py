"""Retrieval: ranked search, and what a reader is shown of a hit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.storage import temporary, written
from sparkseek.operators.index import Index, keyed, tokens
from sparkseek.operators.substring import substring_matches

# BM25 (Robertson and Zaragoza 2009).
K1, B = 1.2, 0.75


#: So many rows of terms and their words, which are short, are broadcast.
_BROADCAST = 200_000
#: So many keys are pushed to a scan; so many rows of terms are looked at for that.
_PUSHED = 500
_HEAD = 20_000
#: Of queries of more terms, blocks that lack one of the so many rarest are left out before any other term is looked at.
_RAREST = 3
#: Of so many terms, words are compared with those that share their first letters; of more, their prefixes of all lengths are looked up.
_HEADS = 2_000
_LETTERS = 3
#: Documents of a task that finds their best lines for every query.
_DOCS = 8192


def expanded(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, ord, key, ranked, n_terms), written: the keys that each query term stands for, the last one as a prefix.

    Prefixes are expanded against the distinct keys only: keys are exploded into their prefixes of the lengths that
    queries have, so the expansion is an equi-join."""
    return _expanded(_asked(terms), index)


def _asked(terms: DataFrame) -> DataFrame:
    """terms with n_terms, written."""
    return written(terms.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id"))))


def _expanded(asked: DataFrame, index: Index) -> DataFrame:
    columns = ["query_id", "ord", "key", "ranked", "n_terms"]
    prefixes = asked.where("is_last").withColumnRenamed("key", "prefix")
    lengths = prefixes.select(F.length("prefix").alias("k")).distinct().agg(F.collect_set("k").alias("lengths"))  # one row, as long as the longest word at most
    starts = (
        index.term_stats.select("key").join(F.broadcast(lengths))
        .withColumn("k", F.explode("lengths")).where(F.col("k") <= F.length("key"))
        .select("key", F.left("key", F.col("k")).alias("prefix"))
    )
    return written(asked.where(~F.col("is_last")).select(columns).unionByName(prefixes.join(starts, "prefix").select(columns)))


def _matcher(asked: DataFrame, index: Index) -> Callable[[DataFrame], DataFrame]:
    """A function that gives the rows of a table with a key for each term of asked that the key matches, with its query_id,
    ord, ranked and n_terms; the last term of a query matches as a prefix.

    Terms are broadcast, and not the keys that they stand for: these grow with the vocabulary, and where they are too many
    for that, all postings would be moved to meet them. A key meets the terms that share its head, its first letters (a
    shorter prefix is there for every head that it has in the index), or, for many terms, heads of all lengths that terms
    have. Terms that are too many to be broadcast are expanded."""
    n, lengths = asked.agg(F.count("*"), F.collect_set(F.length("key"))).first()
    if not n:
        return lambda df: df.limit(0).join(asked.drop("norm", "is_last"), "key")
    if n > _BROADCAST:
        wanted = _expanded(asked, index)
        return lambda df: df.join(wanted, "key")
    term, first = asked.select("query_id", "ord", "ranked", "n_terms", "is_last", F.col("key").alias("term")), lambda c: F.left(c, F.lit(_LETTERS))
    head = None
    if n <= _HEADS:
        short = F.col("is_last") & (F.length("term") < _LETTERS)
        known = index.term_stats.select(first("key").alias("head")).distinct()
        heads = written(term.where(~short).withColumn("head", first("term")).unionByName(known.join(F.broadcast(term.where(short)), F.startswith("head", "term"))))
        head = first("key") if heads.count() <= _BROADCAST else None
    if head is None:
        heads = term.withColumn("head", F.col("term"))
        head = F.explode(F.array(*(F.when(F.length("key") >= k, F.left("key", F.lit(k))) for k in sorted(lengths))))
    same = F.when(F.col("is_last"), F.startswith("key", "term")).otherwise(F.col("key") == F.col("term"))
    return lambda df: df.withColumn("head", head).join(F.broadcast(heads), "head").where(same).drop("head", "term", "is_last")


def term_matches(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, ord, doc_id, tf, df, ranked, n_terms): documents of each query term, the last one as a prefix.

    An expanded prefix is one term: tf is summed, df counts documents with any expansion. Terms are broadcast to the
    postings where they are few: then postings of other words are not moved at all."""
    found = (
        _matcher(_asked(terms), index)(index.postings.select("key", "doc_id", "tf"))
        .groupBy("query_id", "ord", "doc_id", "ranked", "n_terms").agg(F.sum("tf").alias("tf"))
    )
    return found.join(found.groupBy("query_id", "ord").agg(F.count("*").alias("df")), ["query_id", "ord"])


def search(terms: DataFrame, index: Index, limit: int = 20, metadata: DataFrame | None = None, prune_from: int = 20_000_000) -> DataFrame:
    """(query_id, doc_id, score, rank) of the documents that have all terms of a query, at most limit.

    Ranked by BM25, ties by doc_id; a query of stopwords only is not scored and lists documents by doc_id. With
    metadata(doc_id, size, mtime) these come along, 0 where a document has none. Of a stored index, which has bounds of
    blocks, where the queries' words have prune_from postings or more only the blocks that can have a hit are scored
    (see scored_blocks); below that, looking at the bounds would cost more than it saves."""
    if index.blocks is None:
        hits = _top(_all_scores(terms, index), limit)
    else:
        with temporary(terms.sparkSession) as keep:
            hits = keep(scored_blocks(terms, index, limit, prune_from=prune_from)[0])
    if metadata is None:
        return hits
    return hits.join(metadata.select("doc_id", "size", "mtime"), "doc_id", "left").select("query_id", "doc_id", "score", "rank", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime", F.lit(0)).alias("mtime"))


def _top(scored: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")


def _idf(n) -> Column:
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _all_scores(terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score) of all matches."""
    scope = index.doc_stats.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))  # one row
    listed = (
        term_matches(terms.where(~F.col("ranked")), index).groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms")).where(F.col("found") == F.col("n_terms"))
        .select("query_id", "doc_id", F.lit(0.0).alias("score"))
    )  # stopwords only: neither scores nor lengths are read, and each task keeps the first documents only
    return (
        term_matches(terms.where("ranked"), index).join(index.doc_stats, "doc_id").join(F.broadcast(scope))
        .withColumn("part", _idf(F.col("n")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
        .groupBy("query_id", "doc_id")
        .agg(F.sum("part").alias("score"), F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
        .where(F.col("found") == F.col("n_terms")).select("query_id", "doc_id", "score")
    ).unionByName(listed)


def _with_keys(df: DataFrame, keys: list | None) -> DataFrame:
    """The rows that have one of a few keys, which are pushed to the scan; all where they are many (None)."""
    return df if keys is None else df.where(F.col("key").isin(keys))


def _few_keys(df: DataFrame) -> list | None:
    rows = df.select("key").distinct().limit(_PUSHED + 1).collect()
    return [r["key"] for r in rows] if len(rows) <= _PUSHED else None


def _small(df: DataFrame, rows: int = _BROADCAST) -> DataFrame:
    """Broadcast where there are few rows, which are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scored_blocks(terms: DataFrame, index: Index, limit: int, first: int = 64, prune_from: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """What search() gives of a stored index, and (query_id, rows, rows_scored): how many postings a query's words have in
    blocks that have all of them, and how many of these were scored; None where nothing is pruned.

    A block of documents has, for each key, the largest tf and the largest share of a document's words; so a block's best
    possible score is known before its postings are read. For each query, the first blocks by these bounds are scored; the
    score of the last hit is a threshold, and of the others only blocks that can reach it are scored. Blocks of a query
    that isn't ranked go by their first possible document instead. Frequencies of single keys are in the index; only for
    prefixes of several keys documents are counted.

    Of long queries, only blocks that have the rarest terms are gathered for the others: what is grouped goes by the
    documents that may be hits, not by all that have one of the words."""
    asked = _asked(terms)
    matching = _matcher(asked, index)
    head = matching(index.term_stats).select("query_id", "ord", "key", "ranked").limit(_HEAD + 1).collect()
    if len(head) <= _HEAD:
        keys = sorted({r["key"] for r in head}) if len({r["key"] for r in head}) <= _PUSHED else None
        count = Counter((r["query_id"], r["ord"]) for r in head if r["ranked"])
        many_keys, n_queries = any(c > 1 for c in count.values()), len({r["query_id"] for r in head})
    else:
        keys, many_keys, n_queries = None, True, asked.select("query_id").distinct().count()
    postings = matching(_with_keys(index.postings.select("key", "seg", "block", "doc_id", "tf", "len"), keys))
    n, mean = index.scope[0], index.scope[1] / max(1, index.scope[0])
    df = written(matching(_with_keys(index.term_stats, keys)).groupBy("query_id", "ord").agg(F.sum("df").alias("df"), F.count("*").alias("n_keys"), F.first("ranked").alias("ranked"), F.first("n_terms").alias("n_terms")))
    n_rows = df.agg(F.sum("df")).first()[0] or 0
    if many_keys:
        several = df.where("n_keys > 1 AND ranked").select("query_id", "ord")
        found = postings.join(F.broadcast(several) if len(head) <= _HEAD else several, ["query_id", "ord"], "left_semi")
        found = found.select("query_id", "ord", "doc_id").distinct().groupBy("query_id", "ord").agg(F.count("*").alias("own"))
        df = written(df.join(found, ["query_id", "ord"], "left").withColumn("df", F.coalesce("own", "df")))
    idf = df.select("query_id", "ord", _idf(F.lit(n)).alias("idf"))
    idf = F.broadcast(idf) if len(head) <= _HEAD else _small(idf)
    part = F.when(F.col("ranked"), F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))).otherwise(0.0)

    of_blocks, anchors, n_anchors = matching(_with_keys(index.blocks, keys)), None, 0
    if (df.agg(F.max("n_terms")).first()[0] or 0) > _RAREST:
        whole = df.withColumn("known", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("known") == F.col("n_terms"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "ord"))
        rarest = whole.withColumn("nth", nth).where(F.col("nth") <= _RAREST).select("query_id", "ord")
        held = of_blocks.join(F.broadcast(rarest) if len(head) <= _HEAD else _small(rarest), ["query_id", "ord"], "left_semi")
        held = held.select("query_id", "ord", "seg", "block", "n_terms").distinct().groupBy("query_id", "seg", "block").agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
        anchors = written(held.where(F.col("found") == F.least("n_terms", F.lit(_RAREST))).select("query_id", "seg", "block"))
        n_anchors = anchors.count()
        of_blocks = of_blocks.join(F.broadcast(anchors) if n_anchors <= _BROADCAST else anchors, ["query_id", "seg", "block"], "left_semi")

    def scores(chosen: DataFrame | None, n_blocks: int) -> DataFrame:
        read, of = postings, []
        chosen = None if chosen is None else chosen.select("query_id", "seg", "block")
        if chosen is not None and n_blocks <= _BROADCAST:
            read = postings.join(F.broadcast(chosen), ["query_id", "seg", "block"])
        elif chosen is not None:  # postings are summed up where they are read, and their sums meet the blocks
            of = ["seg", "block"]
        summed = read.groupBy("query_id", "ord", *of, "doc_id", "len", "ranked", "n_terms").agg(F.sum("tf").alias("tf")).join(idf, ["query_id", "ord"])
        if of:
            summed = summed.join(chosen, ["query_id", *of])
        return (
            summed.groupBy("query_id", *of, "doc_id", "n_terms").agg(F.sum(part).alias("score"), F.count("*").alias("found"))
            .where(F.col("found") == F.col("n_terms")).select("query_id", "doc_id", "score")
        )

    if n_rows < prune_from:
        return _top(scores(anchors, n_anchors), limit), None
    bound = F.when(F.col("ranked"), F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B) / F.col("max_tf") + K1 * B / (F.col("max_share") * mean))).otherwise(0.0)
    blocks = written(
        of_blocks.groupBy("query_id", "ord", "seg", "block", "ranked", "n_terms")
        .agg(F.sum("n").alias("rows"), F.sum("max_tf").alias("max_tf"), F.sum("max_share").alias("max_share"), F.min("first_doc").alias("first_doc"))
        .join(idf, ["query_id", "ord"]).groupBy("query_id", "seg", "block", "ranked", "n_terms")
        .agg(F.sum(bound).alias("bound"), F.count("*").alias("found"), F.max("first_doc").alias("first_doc"), F.sum("rows").alias("rows"))
        .where(F.col("found") == F.col("n_terms")).drop("found", "n_terms")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "first_doc", "seg", "block")
    best = blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).drop("place")  # the same each time
    hits = written(_top(scores(best, first * n_queries), limit))
    last = hits.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"), F.col("doc_id").alias("last_doc"))
    reaches = F.when(F.col("ranked"), F.col("bound") + 1e-8 >= F.col("least")).otherwise(F.col("first_doc") <= F.col("last_doc"))
    rest = blocks.join(best.select("query_id", "seg", "block"), ["query_id", "seg", "block"], "left_anti")
    rest = written(rest.join(F.broadcast(last) if n_queries <= _BROADCAST else last, "query_id", "left").where(F.col("least").isNull() | reaches).select(blocks.columns))
    if n_rest := rest.count():
        hits = _top(scores(rest, n_rest).unionByName(hits.select("query_id", "doc_id", "score")), limit)
    scored = best.select("query_id", "rows").unionByName(rest.select("query_id", "rows")).groupBy("query_id").agg(F.sum("rows").alias("rows_scored"))
    return hits, blocks.groupBy("query_id").agg(F.sum("rows").alias("rows")).join(scored, "query_id")


def hit_tokens(hits: DataFrame, terms: DataFrame, words: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, doc_id, pos, raw, key, matched): all words of the hits, with whether they match a term of the query;
    the last term also matches words that begin with it. Only hits are read, not the corpus."""
    of_hits = hits.select("query_id", "doc_id").join(keyed(words, stem), "doc_id")
    exact = terms.select("query_id", F.col("key").alias("term"), "is_last")
    matching = of_hits.join(exact, (of_hits["query_id"] == exact["query_id"]) & F.when(F.col("is_last"), F.col("key").startswith(F.col("term"))).otherwise(F.col("key") == F.col("term")), "left")
    return matching.groupBy(of_hits["query_id"], "doc_id", "pos", "raw", "key").agg(F.count("term").alias("n")).select("query_id", "doc_id", "pos", "raw", "key", (F.col("n") > 0).alias("matched"))


def snippets(hits: DataFrame, terms: DataFrame, words: DataFrame, size: int = 20, stem: bool = True, start: str = "[", end: str = "]", ellipsis: str = "…") -> DataFrame:
    """(query_id, doc_id, snippet): of every hit the size words that hold most distinct terms, the earliest on ties,
    matches marked. The window begins a quarter of its size before its first match."""
    marked = hit_tokens(hits, terms, words, stem)
    last = marked.groupBy("query_id", "doc_id").agg(F.max("pos").alias("last"))
    per_hit = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(0, size - 1 - size // 4)
    by_hit = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("cover"), "pos")
    chosen = (
        marked.where("matched").withColumn("cover", F.size(F.collect_set("key").over(per_hit)))
        .withColumn("n", F.row_number().over(by_hit)).where("n = 1")
        .select("query_id", "doc_id", F.greatest(F.lit(0), F.col("pos") - size // 4).alias("from"))
    )
    shown = F.when(F.col("matched"), F.concat(F.lit(start), "raw", F.lit(end))).otherwise(F.col("raw"))
    inside = (
        marked.join(chosen, ["query_id", "doc_id"]).where(F.col("pos").between(F.col("from"), F.col("from") + size - 1))
        .groupBy("query_id", "doc_id", "from").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("w")))).alias("ws"))
    )
    text = F.array_join(F.col("ws")["w"], " ")
    return inside.join(last, ["query_id", "doc_id"]).select(
        "query_id", "doc_id",
        F.concat(F.when(F.col("from") > 0, ellipsis).otherwise(""), text, F.when(F.col("from") + size - 1 < F.col("last"), ellipsis).otherwise("")).alias("snippet"),
    )


def best_page(terms: DataFrame, pages: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, doc_id, page, coverage) from pages(doc_id, page, text): of every document with a term, the page with
    most distinct terms, the earliest on ties. All terms count, the last one too."""
    words = keyed(tokens(pages.withColumn("at", F.struct("doc_id", "page")), "at"), stem).join(terms.select("key").distinct(), "key", "left_semi").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.page").alias("page"), "key").distinct()
    covered = words.join(terms.select("query_id", "key"), "key").groupBy("query_id", "doc_id", "page").agg(F.count_distinct("key").alias("coverage"))
    best = covered.groupBy("query_id", "doc_id").agg(F.max(F.struct("coverage", (-F.col("page")).alias("minus"))).alias("b"))
    return best.select("query_id", "doc_id", (-F.col("b.minus")).alias("page"), F.col("b.coverage").alias("coverage"))


def best_passage(terms: DataFrame, lines: DataFrame, window: int = 10, scan_limit: int = 50_000, stem: bool = True) -> DataFrame:
    """(query_id, doc_id, first_line, coverage) from lines(doc_id, line, text): the window lines that hold most distinct
    terms, the earliest on ties; among lines before scan_limit. Only lines with a term are rows, as coverage can rise
    only there. Documents without a term are not listed: they are shown from the top."""
    read = lines.where(F.col("line") < scan_limit).withColumn("at", F.struct("doc_id", "line"))
    asked = terms.select("key").distinct()
    words = keyed(tokens(read, "at"), stem).join(asked, "key", "left_semi").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.line").alias("line"), "key").distinct()
    return _best_lines(words.join(terms.select("query_id", "key"), "key"), window)


def _best_lines(found: DataFrame, window: int) -> DataFrame:
    sliding = Window.partitionBy("query_id", "doc_id").orderBy("line").rangeBetween(-(window - 1), 0)
    covered = found.withColumn("coverage", F.size(F.collect_set("key").over(sliding)))
    best = covered.groupBy("query_id", "doc_id").agg(F.max(F.struct("coverage", (-F.col("line")).alias("minus"))).alias("b"))
    return best.select("query_id", "doc_id", F.greatest(-F.col("b.minus") - (window - 1), F.lit(0)).alias("first_line"), F.col("b.coverage").alias("coverage"))


def preview_lines(passages: DataFrame, lines: DataFrame, window: int = 10, before: int = 150, max_lines: int = 300, max_bytes: int = 64 << 10) -> DataFrame:
    """(query_id, doc_id, line, text): the lines shown around a passage, from 150 lines before its middle, at most
    max_lines and max_bytes."""
    first = F.greatest(F.col("first_line") + window // 2 - before, F.lit(0))
    near = passages.select("query_id", "doc_id", first.alias("from")).join(lines, "doc_id").where(F.col("line").between(F.col("from"), F.col("from") + max_lines - 1))
    running = Window.partitionBy("query_id", "doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("bytes", F.sum(F.octet_length("text") + 1).over(running)).where(F.col("bytes") <= max_bytes).select("query_id", "doc_id", "line", "text")


def match_spans(hits: DataFrame, terms: DataFrame, words: DataFrame, max_marks: int = 2000, stem: bool = True) -> DataFrame:
    """(query_id, doc_id, pos, raw, key): words of the hits whose key is a query key, whole words only, the first
    max_marks of a document."""
    matching = hits.select("query_id", "doc_id").join(keyed(words, stem), "doc_id").join(terms.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    return matching.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_marks).select("query_id", "doc_id", "pos", "raw", "key")


def _places(hits: DataFrame, asked: DataFrame, index: Index, column: str) -> DataFrame:
    """(query_id, doc_id, key, column): the postings of hits for what asked(query_id, key) has of their queries. Postings of
    other documents go where they are read, so how many keys a prefix stands for doesn't count."""
    pairs = hits.select("query_id", "doc_id")
    read = _with_keys(index.postings.select("key", "doc_id", column), _few_keys(asked)).join(_small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    return read.join(_small(pairs), "doc_id").join(_small(asked), ["query_id", "key"], "left_semi").select("query_id", "doc_id", "key", column)


def indexed_spans(hits: DataFrame, terms: DataFrame, index: Index, max_marks: int = 2000) -> DataFrame:
    """The same as match_spans() of a stored index with positions: no text is split again."""
    places = _places(hits, terms.select("query_id", "key").distinct(), index, "positions")
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    marks = places.select("query_id", "doc_id", "key", F.explode("positions").alias("pos")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_marks)
    words = index.stored.select("doc_id", "words").join(_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return marks.join(words, "doc_id").select("query_id", "doc_id", "pos", F.get("words", F.col("pos")).alias("raw"), "key")


def indexed_snippets(hits: DataFrame, terms: DataFrame, index: Index, size: int = 20, start: str = "[", end: str = "]", ellipsis: str = "…") -> DataFrame:
    """The same as snippets() of a stored index with positions: matches come from the postings of the hits, words from what
    the index stores of them."""
    places = _places(hits, expanded(terms, index).select("query_id", "key").distinct(), index, "positions")
    marks = places.select("query_id", "doc_id", "key", F.explode("positions").alias("pos"))
    ahead = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(0, size - 1 - size // 4)
    covered = marks.withColumn("cover", F.size(F.collect_set("key").over(ahead)))
    best = covered.groupBy("query_id", "doc_id").agg(F.max(F.struct("cover", (-F.col("pos")).alias("minus"))).alias("b"), F.collect_set("pos").alias("at"))
    best = best.select("query_id", "doc_id", F.greatest(F.lit(0), -F.col("b.minus") - size // 4).alias("from"), "at")
    words = index.stored.select("doc_id", "words").join(_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    near = best.withColumn("at", F.filter("at", lambda p: p.between(F.col("from"), F.col("from") + size - 1))).join(words, "doc_id")
    shown = F.transform(F.slice("words", F.col("from") + 1, F.lit(size)), lambda w, i: F.when(F.array_contains("at", F.col("from") + i), F.concat(F.lit(start), w, F.lit(end))).otherwise(w))
    return near.select(
        "query_id", "doc_id",
        F.concat(F.when(F.col("from") > 0, ellipsis).otherwise(""), F.array_join(shown, " "), F.when(F.col("from") + size < F.size("words"), ellipsis).otherwise("")).alias("snippet"),
    )


def indexed_passage(terms: DataFrame, index: Index, window: int = 10, scan_limit: int = 50_000, hits: DataFrame | None = None) -> DataFrame:
    """The same as best_passage() of a stored index with positions, of all documents or of hits: lines come from the postings."""
    asked = terms.select("query_id", "key").distinct()
    if hits is not None:
        places = _places(hits, asked, index, "lines")
    else:  # a word's postings are moved once, to where their documents are, however many queries have it
        places = _with_keys(index.postings.select("key", "doc_id", "lines"), _few_keys(asked)).join(_small(asked.select("key").distinct()), "key", "left_semi")
        places = places.repartition(max(int(index.postings.sparkSession.sparkContext.defaultParallelism), -(-index.scope[0] // _DOCS)), "doc_id").join(_small(asked), "key")
    found = places.select("query_id", "doc_id", "key", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line") < scan_limit)
    return _best_lines(found, window)


def best_cluster(spans: DataFrame, marks: int = 8) -> DataFrame:
    """(query_id, doc_id, pos, distinct_keys): where the marks consecutive spans with most distinct keys begin, the
    earliest on ties."""
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    ahead = spans.withColumn("distinct_keys", F.size(F.collect_set("key").over(order.rowsBetween(0, marks - 1))))
    best = ahead.groupBy("query_id", "doc_id").agg(F.max(F.struct("distinct_keys", (-F.col("pos")).alias("minus"))).alias("b"))
    return best.select("query_id", "doc_id", (-F.col("b.minus")).alias("pos"), F.col("b.distinct_keys").alias("distinct_keys"))


def matching_cells(terms: DataFrame, cells: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, table_id, row, col, first): cells(table_id, row, col, text) that hold a query key, and which is the
    first of its table."""
    words = keyed(tokens(cells.withColumn("at", F.struct("table_id", "row", "col")), "at"), stem)
    found = words.join(terms.select("query_id", "key"), "key").select("query_id", F.col("doc_id.table_id").alias("table_id"), F.col("doc_id.row").alias("row"), F.col("doc_id.col").alias("col")).distinct()
    order = Window.partitionBy("query_id", "table_id").orderBy("row", "col")
    return found.withColumn("first", F.row_number().over(order) == 1)


def match_boxes(terms: DataFrame, ocr_words: DataFrame, indexed: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, path, status, boxes): for each query and indexed path with words read from it, the boxes of matching
    words in line order; status tells an image without text ('empty') from one that has some ('indexed')."""
    words = keyed(tokens(ocr_words.withColumn("at", F.struct("path", "line", "x", "y", "w", "h")), "at", "word"), stem)
    found = words.join(terms.select("query_id", "key"), "key").select("query_id", F.col("doc_id.path").alias("path"), F.struct("doc_id.line", "doc_id.x", "doc_id.y", "doc_id.w", "doc_id.h").alias("box"))
    boxes = found.groupBy("query_id", "path").agg(F.array_sort(F.collect_set("box")).alias("boxes"))
    state = indexed.select("path").join(ocr_words.select("path", F.lit("indexed").alias("s")).distinct(), "path", "left").select("path", F.coalesce("s", F.lit("empty")).alias("status"))
    return state.join(boxes, "path", "left").select("query_id", "path", "status", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)).alias("boxes"))


def filter_history(history: DataFrame, queries: DataFrame, tab: str = "all") -> DataFrame:
    """(query_id, id): entries of history(id, content_type, preview, ocr_text) in a tab whose preview or image text has
    the query as it is typed, in any case."""
    within = history if tab == "all" else history.where(F.col("content_type") == tab)
    text = F.lower(F.concat_ws("\n", "preview", "ocr_text"))
    asked = queries.select("query_id", F.lower(F.trim("query_text")).alias("q"))
    return substring_matches(within.select("id", text.alias("text")), asked).select("query_id", "id")


def in_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame], rows: int = 10_000) -> DataFrame:
    """What run gives for queries, broadcast in counted blocks of some rows each, together."""
    n = max(1, -(-queries.count() // rows))
    blocks = [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(n)) == k) for k in range(n)]
    return reduce(DataFrame.union, [run(F.broadcast(b)) for b in blocks])
