"""Search as an equi-join: rows and queries meet on the query's rarest key, and what meets is verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
_FEW = 200_000


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters, one pass over the text; of none, the empty one."""
    return F.array(F.lit("")) if n == 0 else F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(_FEW + 1).count() <= _FEW else df


def substring_matches(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows(..., text) with each query of queries(query_id, q) whose q their text contains; an empty q is in all texts. Null
    texts and queries match nothing.

    A query of three characters or more is found by its rarest gram of three, a shorter one by itself as a gram: the grams
    that queries have are counted over the texts first, then each query's rarest one is joined with the texts that have
    it. Texts without such grams aren't moved, where the queries' grams are few enough to be broadcast, which is counted."""
    asked = queries.where(F.col("q").isNotNull()).withColumn("n_", F.least(F.length("q"), F.lit(GRAM)))
    lengths = sorted(r["n_"] for r in asked.select("n_").distinct().collect())  # four at most
    if not lengths:
        return rows.join(queries.select("query_id", "q"), F.lit(False))
    of = lambda text: F.flatten(F.array(*(grams(text, n) for n in lengths)))
    own = F.when(F.col("n_") == 0, grams(F.col("q"), 0))
    for n in range(1, GRAM + 1):
        own = own.when(F.col("n_") == n, grams(F.col("q"), n))
    met = meet(rows.where(F.col("text").isNotNull()), of(F.col("text")), asked.select("query_id", "q", own.alias("keys_")))
    return met.where(F.contains("text", F.col("q")))


def meet(rows: DataFrame, keys: Column, asked: DataFrame) -> DataFrame:
    """Each row with each query of asked(query_id, ..., keys_) whose rarest key is among the row's keys. A query all of whose
    keys a row has is with that row once; what a row must have besides is to be verified.

    The keys that queries have are counted over the rows first. A query with a key that no row has meets none."""
    columns = [c for c in asked.columns if c != "keys_"]
    of_query = asked.select(*columns, F.explode("keys_").alias("key_"))
    wanted = _small(of_query.select("key_").distinct())
    counted = rows.select(F.explode(keys).alias("key_")).join(wanted, "key_").groupBy("key_").agg(F.count("*").alias("rows_"))
    rarest = of_query.join(counted, "key_", "left").groupBy(*columns).agg(F.min(F.struct(F.coalesce("rows_", F.lit(0)).alias("n"), F.col("key_"))).alias("r"))
    chosen = _small(rarest.where("r.n > 0").select(*columns, F.col("r.key_").alias("key_")))
    return rows.withColumn("key_", F.explode(keys)).join(chosen, "key_").drop("key_")
