"""Search over many sources: registration, gates, and the whole plan from queries to ranked rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.storage import written
from sparkseek.operators.classify import utf8_cut
from sparkseek.operators.ranking import compose_score, dedup_results, explain_scores, fill_when_sparse, gather, pin_bonus, top_results, usage_bonus

# Fixed values of the contract of a registered source.
RELEVANCE_SPAN, FIELD_BYTES, MAX_ROWS = 300_000, 2048, 200
#: So many queries' rows are sorted in one task.
_QUERIES = 20_000


@dataclass
class Source:
    """A result source: a function of queries(query_id, query_text) that gives (query_id, id, title, relevance, ...)."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    always_on: bool = True
    min_length: int = 1
    scope_min_length: int = 0


@dataclass
class Sources:
    """Registered sources by name."""

    by_name: dict[str, Source] = field(default_factory=dict)

    def register_source(self, source: Source) -> Source:
        if source.name in self.by_name:
            raise ValueError(f"{source.name} is registered already")
        self.by_name[source.name] = source
        return source

    def candidates(self, queries: DataFrame, scope: str | None = None, failed: dict[str, str] | None = None) -> DataFrame | None:
        """What sources give, as one plan. With failed, each source runs on its own and its rows are written to the
        shared folder; one that fails, when it is planned or when it runs, gives no rows and its error goes into failed."""
        found, tasks = [], -(-queries.count() // _QUERIES)
        for s in self.by_name.values():
            if scope not in (None, s.name):
                continue
            try:
                rows = contract(s.name, s.run(gate_sources(queries, s, scope)), tasks)
                found.append(rows if failed is None else written(rows))
            except Exception as error:
                if failed is None:
                    raise
                failed[s.name] = str(error)
        return gather(*found) if found else None


def gate_sources(queries: DataFrame, source: Source, scope: str | None = None) -> DataFrame:
    """The queries that a source gets: in root search those of its least length if it is always on; in its own scope
    empty ones, and those of the least length there."""
    n = F.length(F.trim("query_text"))
    if scope == source.name:
        return queries.where((n == 0) | (n >= source.scope_min_length))
    return queries.where((n >= max(1, source.min_length)) if source.always_on else F.lit(False))


def contract(name: str, rows: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows of a source as candidates: ids in its namespace, texts cut to 2048 bytes, relevance from 0 to 100 (0 where
    it is no finite number) as intra, at most 200 rows of a query, the most relevant first. They are sorted in so many
    tasks: Spark would choose by compressed bytes, which tell little of rows that are much alike."""
    finite = F.coalesce(F.col("relevance").cast("double"), F.lit(0.0))
    relevance = F.when(F.isnan(finite) | (F.abs(finite) == float("inf")), 0.0).otherwise(F.least(F.greatest(finite, F.lit(0.0)), F.lit(100.0)))
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    text = lambda c: utf8_cut(F.col(c), FIELD_BYTES).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    dealt = rows.repartition(tasks, "query_id") if tasks > 1 else rows
    return (
        dealt.select("query_id", F.concat(F.lit(f"ext:{name}:"), "id").alias("id"), text("title"), text("subtitle"), relevance.alias("relevance"))
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= MAX_ROWS)
        .select("query_id", "id", "title", "subtitle", F.lit("extension").alias("category"), F.lit(name).alias("ext_name"), F.lit("fuzzy").alias("tier"),
                F.lit(0).alias("quality"), (F.col("relevance") / 100 * RELEVANCE_SPAN).alias("intra"), F.col("id").alias("exec"))
    )


def search_all(queries: DataFrame, candidates: DataFrame, weights: DataFrame, scores: DataFrame, pins: DataFrame, ext_weights: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Candidates of all sources to ranked rows: score, sparse fill, usage, pins, one row of each result, top n."""
    scored = compose_score(candidates, weights, ext_weights)
    boosted = pin_bonus(usage_bonus(fill_when_sparse(scored), scores), queries, pins)
    return explain_scores(top_results(dedup_results(boosted), n))
