"""Fuzzy title matching: candidates, quality, tiers and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.text import normalized
from sparkseek.operators.search import in_blocks

#: The quality of a perfect match, and by how much penalties lower candidates of files.
FULL_QUALITY = 1500
FOLDER_PENALTY, NO_PREVIEW_PENALTY, HIDDEN_PENALTY = -700_000, -300_000, -200_000
#: Characters of titles that are aligned at once.
_CELLS = 1 << 21
TIERS = ["exact", "prefix", "word_start", "fuzzy"]


def alignment_quality(query: str, title: str) -> int | None:
    """0 to FULL_QUALITY for the best way to find query's characters in title in order, or None where there is none.

    A character counts 16, 8 more at a word's start and 4 more right after the one before; a gap costs 3 and 1 for each
    character beyond the first. The sum is scaled by that of a query found whole at the title's start."""
    if not query:
        return FULL_QUALITY
    lowest = float("-inf")
    start = [i == 0 or not title[i - 1].isalnum() for i in range(len(title))]
    here = [16 + 8 * start[i] if c == query[0] else lowest for i, c in enumerate(title)]
    for q in query[1:]:
        after, gap = [lowest] * len(title), lowest
        for i, c in enumerate(title):
            if i >= 2:
                gap = max(gap - 1, here[i - 2] - 3)
            if c == q and i:
                best = max(here[i - 1] + 4, gap)
                if best > lowest:
                    after[i] = best + 16 + 8 * start[i]
        here = after
    best = max(here, default=lowest)
    if best == lowest:
        return None
    full = alignment_full(query)
    return max(1, min(FULL_QUALITY, round(FULL_QUALITY * best / full)))


def alignment_full(query: str) -> int:
    return sum(16 + 8 * (i == 0 or not query[i - 1].isalnum()) + 4 * (i > 0) for i in range(len(query)))


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points by row, 0 behind the end."""
    out = np.zeros((len(texts), width), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts])
    rows = np.repeat(np.arange(len(texts)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def alignment_qualities(queries: list[str], titles: list[str]) -> np.ndarray:
    """alignment_quality() of pairs, as arrays over all of them; 0 where there is none. The best gap before a place is the
    largest of all earlier scores less their distance, which is a running maximum."""
    out = np.zeros(len(queries), np.int64)
    order = np.argsort([len(t) for t in titles], kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(titles[order[end]]) <= _CELLS:
            end += 1
        own = order[at:end]
        out[own] = _qualities([queries[k] for k in own], [titles[k] for k in own])
        at = end
    return out


def _qualities(queries: list[str], titles: list[str]) -> np.ndarray:
    width, long = max(1, *(len(t) for t in titles)), max(1, *(len(q) for q in queries))
    title, query = _points(titles, width), _points(queries, long)
    known, which = np.unique(title, return_inverse=True)
    alnum = np.array([chr(c).isalnum() for c in known.tolist()])[which.reshape(title.shape)]
    gain = np.full(title.shape, 24.0)
    gain[:, 1:] = np.where(alnum[:, :-1], 16.0, 24.0)
    place = np.arange(width)
    here = np.where((title == query[:, :1]) & (title > 0), gain, -np.inf)
    size = np.array([len(q) for q in queries])
    for k in range(1, long):
        reach = np.maximum.accumulate(here + place, axis=1)
        best = np.full(title.shape, -np.inf)
        best[:, 1:] = here[:, :-1] + 4
        best[:, 2:] = np.maximum(best[:, 2:], reach[:, :-2] - place[2:] - 1)
        after = np.where((title == query[:, k : k + 1]) & (title > 0), best + gain, -np.inf)
        here = np.where((size > k)[:, None], after, here)
    best = here.max(axis=1)
    of = {q: alignment_full(q) for q in set(queries)}
    full = np.array([of[q] for q in queries])
    found = np.where(np.isfinite(best), best, 0)
    quality = np.clip(np.rint(FULL_QUALITY * found / np.maximum(full, 1)), 1, FULL_QUALITY)
    return np.where(size == 0, FULL_QUALITY, np.where(np.isfinite(best), quality, 0)).astype(np.int64)


def _mask(col: str) -> Column:
    """64 bits, of which each distinct character other than blanks sets one."""
    return F.expr(f"aggregate(filter(split({col}, ''), c -> trim(c) != ''), 0L, (m, c) -> m | shiftleft(1L, pmod(ascii(c), 64)))")


def fuzzy_candidates(queries: DataFrame, titles: DataFrame, title_col: str = "title") -> DataFrame:
    """(query_id, norm_query, all columns of titles, quality): titles that have the query's characters in its order,
    whatever case and accents.

    Queries are broadcast in counted blocks, and titles stay where they are read: they are compared by a mask of their
    characters, then by a pattern of the query's characters in order, both natively; only the rest are aligned, in Arrow
    batches, as arrays. So no task gets all titles that have a common character."""
    texts = titles.withColumn("norm_title", normalized(F.col(title_col))).withColumn("title_mask", _mask("norm_title"))
    asked = queries.select("query_id", normalized(F.trim("query_text")).alias("norm_query")).where(F.length("norm_query") > 0)
    letters = F.filter(F.split("norm_query", ""), lambda c: F.trim(c) != "")
    asked = asked.select("query_id", "norm_query", _mask("norm_query").alias("mask"), F.concat(F.lit("%"), F.array_join(F.transform(letters, lambda c: F.when(c.isin("%", "_", "\\"), F.concat(F.lit("\\"), c)).otherwise(c)), "%"), F.lit("%")).alias("in_order"))
    holds = (F.col("title_mask").bitwiseAND(F.col("mask")) == F.col("mask")) & F.expr("norm_title LIKE in_order")
    able = in_blocks(asked, lambda block: texts.join(block, holds).select("query_id", "norm_query", *titles.columns, "norm_title"))

    @F.pandas_udf("int")
    def quality(query: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series(alignment_qualities(query.str.replace(" ", "").tolist(), title.tolist()), dtype="int32")

    return able.withColumn("quality", quality("norm_query", "norm_title")).where(F.col("quality") > 0).drop("norm_title")


def best_field(candidates: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """(keys, field, score): of candidates with a quality column for each field in weights, the best weighted field,
    the first in weights on ties; fields that are null don't count."""
    fields = F.array(*[F.struct((F.col(f) * w).alias("score"), F.lit(-i).alias("minus"), F.lit(f).alias("field")) for i, (f, w) in enumerate(weights.items())])
    best = F.array_max(F.filter(fields, lambda x: x["score"].isNotNull()))
    return candidates.withColumn("b", best).where(F.col("b").isNotNull()).select(*keys, F.col("b.field").alias("field"), F.col("b.score").alias("score"))


def match_tier(title: Column, query: Column) -> Column:
    """exact, prefix, word_start or fuzzy, on normalised title and query. An empty query is fuzzy."""
    t, q = normalized(title), normalized(F.trim(query))
    quoted = F.regexp_replace(q, r"([^\p{L}\p{N}\s])", r"\\$1")
    return (
        F.when(F.length(q) == 0, "fuzzy").when(t == q, "exact").when(t.startswith(q), "prefix")
        .when(F.rlike(t, F.concat(F.lit(r"[^\p{IsAlphabetic}\p{N}]"), quoted)), "word_start").otherwise("fuzzy")
    )


def quality_threshold(query: Column, min_quality: float = 0.06) -> Column:
    """The least quality by length of the query: none for 1 character, then 1/3, 2/3, 7/9, 8/9 and all from 6 on."""
    n, base = F.length(query), min_quality * FULL_QUALITY
    return F.when(n <= 1, F.lit(0.0)).when(n <= 3, base * (n - 1) / 3).otherwise(base * (2 / 3 + F.least(n - 3, F.lit(3)) / 9))


def quality_gate(candidates: DataFrame, min_quality: float = 0.06, by: tuple = ("query_id", "source"), query_col: str = "norm_query") -> DataFrame:
    """Candidates of at least the threshold for their query, or of the third-best quality of their query and source
    where that is lower."""
    order = Window.partitionBy(*by).orderBy(F.desc("quality"))
    third = candidates.withColumn("n", F.row_number().over(order)).where("n <= 3").groupBy(*by).agg(F.max(F.when(F.col("n") == 3, F.col("quality"))).alias("third"))
    threshold = quality_threshold(F.col(query_col), min_quality)
    least = F.least(threshold, F.coalesce(F.col("third").cast("double"), threshold))
    return candidates.join(third, list(by)).where(F.col("quality") >= least).drop("third")


def candidate_cut(candidates: DataFrame, k: int = 128, by: tuple = ("query_id",), tie: str = "id") -> DataFrame:
    """The best k candidates by tier, then quality, ties by the column tie."""
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    order = Window.partitionBy(*by).orderBy(tier, F.desc("quality"), tie)
    return candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def file_penalties(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """Candidates of files with intra: the sum of penalties for folders, files without a preview and hidden ones.
    Dotfiles are left out unless they are shown."""
    shown = files if show_hidden else files.where(~F.col("name").startswith("."))
    penalty = F.when(F.col("is_dir"), F.lit(FOLDER_PENALTY)).otherwise(F.when(F.col("previewable"), F.lit(0)).otherwise(F.lit(NO_PREVIEW_PENALTY)))
    return shown.withColumn("intra", (penalty + F.when(F.col("hidden"), F.lit(HIDDEN_PENALTY)).otherwise(F.lit(0))).cast("double"))


def app_category(candidates: DataFrame) -> DataFrame:
    """Candidates of apps; those found by their description only rank with files."""
    return candidates.withColumn("category", F.when(F.col("field") == "description", "file").otherwise("app"))


def command_candidates(candidates: DataFrame, min_quality: float = 0.07) -> DataFrame:
    """Candidates of commands: queries of two characters or more, with a quality of their own."""
    return candidates.where((F.length("norm_query") >= 2) & (F.col("quality") >= min_quality * FULL_QUALITY)).withColumn("category", F.lit("command"))
