"""A training corpus from raw documents, in stages that are written as Parquet and read again one after another.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps. All but
the last return the columns of documents; the last adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, fresh, scratch, table
from sparkseek.llm.decontaminate import contaminated
from sparkseek.llm.language_id import FINE, identify, learned, train_prototypes
from sparkseek.llm.line_dedup import dedup_lines
from sparkseek.llm.mixing import mix
from sparkseek.llm.ngram_join import jaccard_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones included, and texts in none of the languages of docs.lang. With
    no language to learn, all texts stay that have a letter."""
    prototypes = train_prototypes(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    fine = train_prototypes(docs, dim=FINE, pooled=True)
    return learned(identify(docs, prototypes), fine).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three or more documents share stay in one; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the smallest id
    stays. Documents without an id or without words stay."""
    kept = jaccard_groups(docs.select("doc_id", "text"), width=5, num=80, den=100)
    kept = kept.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, as it is or with other values, go."""
    mark, = fresh(docs, "text_mark")
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id"), F.col("mark").alias("m")).distinct()
    marked = docs.withColumn(mark, F.xxhash64("text"))
    return marked.join(cut(found), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col(mark) == F.col("m")), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources 5 : 2 : 1 over 150% of all words: documents of which it takes something, with how much."""
    return mix(docs, weights=(5, 2, 1), share=1.5, max_repeats=2).where(F.col("taken") > 0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL can't express hyperdimensional profiles or template windows; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables of earlier stages, and what stages wrote on the way, are deleted at the end."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
        return kept(STAGES[-1][1](spark, docs, sf_dir))
