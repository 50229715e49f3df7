"""Ranking of candidates from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.operators.fuzzy import FULL_QUALITY

# Fixed values of the score formula.
CATEGORIES = ["calc", "app", "command", "extension", "file", "dict"]
BAND, WEIGHT_SPAN, MATCH_SPAN, USAGE_SPAN, TIER_POINT = 1_000_000, 500_000, 300_000, 750_000, 100_000
TIER_BOOST = {"exact": 70, "prefix": 25, "word_start": 4, "fuzzy": 0}
PIN_BONUS = 20_000_000
FULL_USAGE = 40
SCOPE_BASES = {"content": 6_000_000, "catalog": 5_000_000, "extension": 4_000_000, "dictionary": 3_000_000}


def category_order(order: list[str] | None = None) -> list[str]:
    """Known categories in the order given, each at its first place, then those that are missing."""
    return list(dict.fromkeys([c for c in order or [] if c in CATEGORIES] + CATEGORIES))


def resolve_weights(spark: SparkSession, order: list[str] | None = None, weights: dict | None = None, balance: int = 50) -> DataFrame:
    """(category, band, hidden, match_max, usage_max): a row for each category. A weight of 50 is neutral, 0 hides."""
    weights = {c: min(100, max(0, (weights or {}).get(c, 50))) for c in CATEGORIES}
    rows = [
        (c, float((len(CATEGORIES) - i) * BAND + (weights[c] - 50) / 50 * WEIGHT_SPAN), weights[c] == 0, (100 - balance) / 50 * MATCH_SPAN, balance / 50 * USAGE_SPAN)
        for i, c in enumerate(category_order(order))
    ]
    return spark.createDataFrame(rows, "category string, band double, hidden boolean, match_max double, usage_max double")


def extension_weights(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """(ext_name, offset, ext_hidden) of extensions with a weight other than the neutral one."""
    rows = [(n, float((min(100, max(0, w)) - 50) / 50 * WEIGHT_SPAN), w <= 0) for n, w in weights.items()]
    return spark.createDataFrame(rows, "ext_name string, offset double, ext_hidden boolean")


def gather(*sources: DataFrame) -> DataFrame:
    """All candidates of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def compose_score(candidates: DataFrame, weights: DataFrame, ext_weights: DataFrame | None = None, root: bool = True) -> DataFrame:
    """Candidates(category, tier, quality, intra, ...) with base, match_bonus, penalty and score. In root search hidden
    categories and extensions go. Weights are tables of a row for each category or extension that a user has set."""
    tier = F.create_map(*[F.lit(x) for name, boost in TIER_BOOST.items() for x in (name, float(boost * TIER_POINT))])
    joined = candidates.join(F.broadcast(weights), "category")
    if ext_weights is not None:
        joined = joined.join(ext_weights, "ext_name", "left").withColumn("band", F.col("band") + F.coalesce("offset", F.lit(0.0))).withColumn("hidden", F.col("hidden") | F.coalesce("ext_hidden", F.lit(False))).drop("offset", "ext_hidden")
    if root:
        joined = joined.where(~F.col("hidden"))
    intra = F.coalesce(F.col("intra").cast("double"), F.lit(0.0))
    return (
        joined.withColumn("base", F.col("band") + F.greatest(intra, F.lit(0.0)))
        .withColumn("match_bonus", tier[F.col("tier")] + F.least(F.coalesce("quality", F.lit(0)) / FULL_QUALITY, F.lit(1.0)) * F.col("match_max"))
        .withColumn("penalty", 0.0 - F.least(intra, F.lit(0.0)))
        .withColumn("score", F.col("base") + F.col("match_bonus") - F.col("penalty"))
        .drop("band", "hidden", "match_max")
    )


def fill_when_sparse(candidates: DataFrame, fewer_than: int = 3, at_most: int = 5) -> DataFrame:
    """Candidates without those of category dict, unless their query has fewer than three others: then the best five."""
    fill = F.coalesce(F.col("category") == "dict", F.lit(False))
    sparse = candidates.groupBy("query_id").agg(F.count_if(~fill).alias("others")).where(F.col("others") < fewer_than).select(F.col("query_id").alias("asked"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    filled = candidates.where(fill).join(sparse, F.col("query_id").eqNullSafe(F.col("asked")), "left_semi")  # each task keeps the first ones only
    filled = filled.withColumn("place", F.row_number().over(best)).where(F.col("place") <= at_most).drop("place")
    return candidates.where(~fill).unionByName(filled)


def usage_bonus(candidates: DataFrame, scores: DataFrame, exempt: tuple = ("dict", "calc")) -> DataFrame:
    """Candidates with usage_bonus, added to their score: scores(id, usage_score) against the full one."""
    share = F.least(F.coalesce("usage_score", F.lit(0.0)) / FULL_USAGE, F.lit(1.0))
    bonus = F.when(F.col("category").isin(*exempt), F.lit(0.0)).otherwise(share * F.col("usage_max"))
    return candidates.join(scores.select("id", "usage_score"), "id", "left").withColumn("usage_bonus", bonus).withColumn("score", F.col("score") + F.col("usage_bonus")).drop("usage_score")


def pin_bonus(candidates: DataFrame, queries: DataFrame, pins: DataFrame) -> DataFrame:
    """Candidates with pin_bonus, added to their score, where pins(query, result_id) has the candidate under a query
    that begins with what is typed. Pinned queries are exploded into their prefixes, so both joins are equi-joins."""
    typed = queries.select("query_id", F.lower(F.trim("query_text")).alias("typed")).where(F.length("typed") > 0)
    prefixes = pins.select(F.lower(F.trim("query")).alias("q"), F.col("result_id").alias("id")).withColumn("typed", F.explode(F.transform(F.sequence(F.lit(1), F.length("q")), lambda k: F.left(F.col("q"), k)))).select("typed", "id").distinct()
    pinned = typed.join(prefixes, "typed").select("query_id", "id", F.lit(float(PIN_BONUS)).alias("pin_bonus")).distinct()
    return candidates.join(pinned, ["query_id", "id"], "left").withColumn("pin_bonus", F.coalesce("pin_bonus", F.lit(0.0))).withColumn("score", F.col("score") + F.col("pin_bonus"))


def dedup_results(ranked: DataFrame) -> DataFrame:
    """The best row of each key: the title for apps, else exec; rows without a key all stay."""
    key = F.when(F.col("category") == "app", F.concat(F.lit("t:"), "title")).otherwise(F.concat(F.lit("e:"), "exec"))
    keyed = ranked.withColumn("key", key)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    first = keyed.where(F.col("key").isNotNull()).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    return first.unionByName(keyed.where(F.col("key").isNull())).drop("key")


def merge_entries(sources: DataFrame, environment: list[str]) -> DataFrame:
    """Entries(key, priority, hidden, kind, only_show_in, not_show_in) of several folders: the one with the lowest
    priority number has its key, and is left out after that if it is hidden, no application, or not for environment."""
    first = Window.partitionBy("key").orderBy("priority")
    env = F.array(*map(F.lit, environment)).cast("array<string>")
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")
    only, never = split(F.col("only_show_in")), split(F.col("not_show_in"))
    won = sources.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return won.where(~F.coalesce("hidden", F.lit(False)) & (F.col("kind") == "Application")).where(((F.size(only) == 0) | F.arrays_overlap(only, env)) & ~F.arrays_overlap(never, env))


def top_results(ranked: DataFrame, n: int | None = 20) -> DataFrame:
    """Ranked rows with rank, at most n of a query; all of them in browse mode (n None). Ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    numbered = ranked.withColumn("rank", F.row_number().over(order))
    return numbered if n is None else numbered.where(F.col("rank") <= n)


def scoped_search(candidates: DataFrame, weights: DataFrame, scope: str, n: int | None = 20) -> DataFrame:
    """Ranked rows of one source: hidden ones too, without usage or pins, above the base of their scope."""
    scored = compose_score(candidates, weights, root=False)
    return top_results(scored.withColumn("score", F.lit(float(SCOPE_BASES[scope])) + F.col("match_bonus") - F.col("penalty")), n)


def explain_scores(ranked: DataFrame) -> DataFrame:
    """Ranked rows with a breakdown of their score."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in ranked.columns else F.lit(0.0).alias(c)
    return ranked.withColumn("breakdown", F.struct(*map(zero, ["base", "match_bonus", "usage_bonus", "pin_bonus", "penalty"])))


def rank_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, moved): by how many places each result moves up from before to after."""
    return before.select("query_id", "id", F.col("rank").alias("r0")).join(after.select("query_id", "id", F.col("rank").alias("r1")), ["query_id", "id"]).select("query_id", "id", (F.col("r0") - F.col("r1")).alias("moved"))
