"""Helpers shared by the corpus-preparation operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.storage import remove, shared_dir

#: What separates words, and what is stripped from lines (U+0020, U+0009 to U+000D).
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: ContextVar[list | None] = ContextVar("written", default=None)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder: lineage ends here and a lost executor costs no rerun.
    Within scratch() the table goes at the end of it; else it stays until the folder is cleared."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what cut() has written within. It gives a function that cuts a table which is to outlive it."""
    outer = _WRITTEN.get()
    token = _WRITTEN.set([])

    def keep(df: DataFrame) -> DataFrame:
        own = _WRITTEN.set(outer)
        try:
            return cut(df)
        finally:
            _WRITTEN.reset(own)

    try:
        yield keep
    finally:
        paths = _WRITTEN.get()
        _WRITTEN.reset(token)
        remove(spark, paths)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from the given ones."""
    have = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        found.append(name)
    return found


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """A table of few narrow columns, broadcast where its rows are counted and no more than max_rows; else as it is, for
    a join by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
