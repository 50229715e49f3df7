"""Line deduplication: lines that many documents share stay in one of them only.

Lines are exploded, normalised and hashed to 128 bits; distinct documents are counted by hash; lines of hashes over
the threshold are dropped except in the document with the largest id, and documents are put together by position.
DataFrame functions only. Shuffles carry hashes and positions; texts move once, for the reassembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import BLANKS, ascii_lower, cut, fresh


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, its text without repeated lines, with n_lines and n_dropped added.

    A key of min_chars code points or more that min_docs or more documents hold loses all its lines, except those in
    the largest id that holds it. A null text is one empty line and comes back as the empty string. Rows with the same
    id are one document when documents are counted; repeated rows get equal results. Rows without an id are not
    counted and never keep a repeated line. Columns of docs named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text, mark, lines, drop, did, dmark = fresh(docs, "text_0", "mark_0", "lines_0", "drop_0", "drop_id_0", "drop_mark_0")
    docs = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(mark, F.xxhash64(text))

    key = line_key(F.col("line"))
    long_lines = (
        docs.select(F.col(id_col).alias("id"), F.col(mark).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    # Written out, so that both sides of the join below are plain shuffles and a hot line can be split.
    repeated = cut(
        long_lines.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    dropped = (
        long_lines.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "mark")
        .agg(F.collect_set("pos").alias(drop))
        .select(F.col("id").alias(did), F.col("mark").alias(dmark), drop)
    )
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda i: F.get(F.col(lines), i))
    columns = [F.col(c) for c in docs.columns if c not in (text, mark, text_col)]
    return (
        docs.join(dropped, F.col(id_col).eqNullSafe(F.col(did)) & (F.col(mark) == F.col(dmark)), "left")
        .withColumn(lines, F.split(text, "\n", -1))
        .select(
            *columns,
            F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text_col),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
