"""Spelling and dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Words of up to so many letters are met by deletions, at most 79 of a word; longer ones by three segments.
_SHORT = 12


def _places(word: Column) -> Column:
    """1 to the number of letters."""
    return F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: i > 0)


def _rest(word: Column, at: Column) -> Column:
    return F.substr(word, at, F.length(word))


def _deletions(word: Column, twice: Column) -> Column:
    """What one deletion, or two, leave of a word, and the word."""
    without = lambda w: F.transform(_places(w), lambda i: F.concat(F.left(w, i - 1), _rest(w, i + 1)))
    return F.array_distinct(F.concat(F.array(word), without(word), F.when(twice, F.flatten(F.transform(without(word), without))).otherwise(F.array().cast("array<string>"))))


def _swapped(word: Column, at: Column) -> Column:
    return F.concat(F.left(word, at - 1), F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1)), _rest(word, at + 2))


def _thirds(n: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the segments of a word of n letters, starts from 0."""
    one, two = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    return [(F.lit(0), one), (one, two - one), (two, n - two)]


def _key(length: Column | int, part: int, text: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.struct(length.cast("int").alias("length"), F.lit(part).alias("part"), text.alias("text"))


def _known_keys(word: Column) -> Column:
    n = F.length(word)
    thirds = _thirds(n)
    forms = [word, *(_swapped(word, start) for start, _ in thirds[1:])]
    segments = F.array_distinct(F.array(*(_key(n, part, F.substr(form, start + 1, size)) for form in forms for part, (start, size) in enumerate(thirds))))
    return F.when(n > _SHORT, segments).otherwise(F.transform(_deletions(word, F.lit(True)), lambda w: _key(0, 0, w)))


def _asked_keys(word: Column, tolerance: Column) -> Column:
    n, none = F.length(word), F.array().cast("array<struct<length int, part int, text string>>")
    at = [(n + more, part, start + shift, size) for more in range(-2, 3) for part, (start, size) in enumerate(_thirds(n + more)) for shift in range(-2, 3)]
    segments = F.array(*(F.when((length > _SHORT) & (start >= 0) & (start + size <= n), _key(length, part, F.substr(word, start + 1, size))) for length, part, start, size in at))
    short = F.transform(_deletions(word, tolerance > 1), lambda w: _key(0, 0, w))
    return F.concat(F.when(n <= _SHORT + 2, short).otherwise(none), F.when(n > _SHORT - 2, F.array_distinct(F.filter(segments, lambda k: k.isNotNull()))).otherwise(none))


def edits(a: Column, b: Column) -> Column:
    """The optimal string alignment distance of two strings if it is 0, 1 or 2, else null: insertions, deletions,
    substitutions and swaps of neighbours, none edited twice. With a swap and one more edit, that one lies wholly before
    or wholly behind the swap."""
    letter = lambda w, at: F.substr(w, at, F.lit(1))
    crossed = lambda i, j: (letter(a, i) == letter(b, j + 1)) & (letter(a, i + 1) == letter(b, j))
    firsts = lambda w: F.filter(_places(w), lambda i: i < F.length(w))

    def swap(x: Column, y: Column) -> Column:
        same = lambda i: (letter(x, i) == letter(y, i + 1)) & (letter(x, i + 1) == letter(y, i)) & (F.left(x, i - 1) == F.left(y, i - 1)) & (_rest(x, i + 2) == _rest(y, i + 2))
        return (F.length(x) == F.length(y)) & F.exists(firsts(x), same)

    def one(x: Column, y: Column) -> Column:
        return (F.levenshtein(x, y, 1) >= 0) | swap(x, y)

    def around(i: Column, j: Column) -> Column:
        before, behind = (F.left(a, i - 1), F.left(b, j - 1)), (_rest(a, i + 2), _rest(b, j + 2))
        fits = (j >= 1) & (j < F.length(b)) & crossed(i, j)
        return fits & (((before[0] == before[1]) & one(*behind)) | ((behind[0] == behind[1]) & one(*before)))

    swap_and_edit = F.exists(firsts(a), lambda i: around(i, i - 1) | around(i, i) | around(i, i + 1))
    return F.when(a == b, 0).when(one(a, b), 1).when((F.levenshtein(a, b, 2) == 2) | swap_and_edit, 2)


def corrections(words: DataFrame, vocab: DataFrame, limit: int = 8) -> DataFrame:
    """(word, correction, distance, rank, place): words of vocab(word, rank) within distance 1 of words of up to 4
    letters, else 2; by distance, then rank; at most limit of a word.

    A similarity join. Known words of up to 12 letters meet by strings that deletions leave of both. Longer ones are cut
    into three segments, and as two edits leave one of them whole, the typed word has it within two letters of its place;
    a swap over the border of two segments, which changes both, is made in the known word as well, so it has keys of
    three forms. So a word's keys are bounded in number, whatever its length. Levenshtein distance (a swap costs 2
    there) prunes, and edits() decides."""
    word, known_word = F.col("word"), F.col("correction")
    asked = words.select("word").where(F.length("word") > 0).distinct().withColumn("tolerance", F.when(F.length("word") <= 4, 1).otherwise(2))
    dealt = asked.withColumn("k", F.explode(_asked_keys(word, F.col("tolerance"))))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short rows, of which many more are made
    lengths = asked.agg(F.min(F.length("word")).alias("shortest"), F.max(F.length("word")).alias("longest"))  # one row
    within = F.length("correction").between(F.col("shortest") - 2, F.col("longest") + 2)  # no other word can be near
    known = vocab.select(word.alias("correction"), "rank").join(F.broadcast(lengths)).where(within).repartition(tasks, "correction").select("correction", "rank", F.explode(_known_keys(known_word)).alias("k"))
    near = dealt.join(known, "k").where(F.levenshtein("word", "correction", 4).between(0, 2 * F.col("tolerance"))).select("word", "tolerance", "correction", "rank").distinct()
    exact = near.withColumn("distance", edits(word, known_word)).where(F.col("distance") <= F.col("tolerance"))
    order = Window.partitionBy("word").orderBy("distance", "rank", "correction")
    return exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("word", "correction", "distance", "rank", "place")


def completions(prefixes: DataFrame, vocab: DataFrame, limit: int = 8) -> DataFrame:
    """(prefix, word, rank, place): words of vocab that begin with a prefix, by rank, at most limit. Words are exploded
    into prefixes of the lengths that are asked, so it is an equi-join."""
    asked = prefixes.select("prefix").where(F.length("prefix") > 0).distinct()
    lengths = asked.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row
    starts = vocab.select("word", "rank").join(F.broadcast(lengths)).select("word", "rank", F.explode(F.filter("lengths", lambda k: k <= F.length("word"))).alias("k"))
    starts = starts.select("word", "rank", F.left("word", F.col("k")).alias("prefix"))
    order = Window.partitionBy("prefix").orderBy("rank", "word")
    return starts.join(asked, "prefix").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("prefix", "word", "rank", "place")


def suggest(words: DataFrame, vocab: DataFrame, limit: int = 9, enough: int = 3) -> DataFrame:
    """(word, suggestion, stage, place): the word itself, then its completions, then corrections if completions are
    fewer than three; each suggestion once, at its first stage; at most limit."""
    asked = words.select("word").distinct()
    literal = asked.select("word", F.col("word").alias("suggestion"), F.lit(0).alias("stage"), F.lit(1).alias("at"))
    done = completions(asked.withColumnRenamed("word", "prefix"), vocab).select(F.col("prefix").alias("word"), F.col("word").alias("suggestion"), F.lit(1).alias("stage"), F.col("place").alias("at"))
    many = done.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    fixed = corrections(asked.join(many, "word", "left_anti"), vocab).select("word", F.col("correction").alias("suggestion"), F.lit(2).alias("stage"), F.col("place").alias("at"))
    first = literal.union(done).union(fixed).groupBy("word", "suggestion").agg(F.min(F.struct("stage", "at")).alias("s"))
    order = Window.partitionBy("word").orderBy("s.stage", "s.at", "suggestion")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("word", "suggestion", "s.stage", "place")


def fill_words(words: DataFrame, vocab: DataFrame, typos: bool = True) -> DataFrame:
    """(word, suggestion): for single words of three letters or more, corrections, or with typos off the word itself if
    vocab has it."""
    single = words.select("word").where(F.col("word").rlike(r"^\p{L}{3,}$")).distinct()
    if typos:
        return corrections(single, vocab).select("word", F.col("correction").alias("suggestion"))
    return single.join(vocab.select("word"), "word", "left_semi").withColumn("suggestion", F.col("word"))


def definition_table(raw: DataFrame) -> DataFrame:
    """(word, part_of_speech, num, text, quotes, synonyms) from raw(word, entry): dictionary entries in lines such as
    "n 1: text; "quote" [syn: {a}, {b}]". A part of speech holds until the next one; other lines go on a definition."""
    start = r"^\s*(?:(n|v|adj|adv|noun|verb)\s+)?(\d+)\s*:\s*(.*)$"
    only = r"^\s*(n|v|adj|adv|noun|verb)\s*:\s*(.*)$"
    lines = raw.select("word", F.posexplode(F.split("entry", "\n")).alias("at", "line"))
    one = lines.withColumn("num", F.nullif(F.regexp_extract("line", start, 2), F.lit(""))).withColumn("single", F.rlike("line", F.lit(only)))
    begins = F.col("num").isNotNull() | F.col("single")
    pos = F.nullif(F.coalesce(F.nullif(F.regexp_extract("line", start, 1), F.lit("")), F.regexp_extract("line", only, 1)), F.lit(""))
    so_far = Window.partitionBy("word").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        one.withColumn("pos", F.last(pos, ignorenulls=True).over(so_far)).withColumn("group", F.sum(begins.cast("int")).over(so_far)).where(F.col("group") > 0)
        .withColumn("body", F.trim(F.when(F.col("num").isNotNull(), F.regexp_extract("line", start, 3)).when(F.col("single"), F.regexp_extract("line", only, 2)).otherwise(F.col("line"))))
    )
    whole = numbered.groupBy("word", "group").agg(F.min_by("pos", "at").alias("part_of_speech"), F.max("num").cast("int").alias("num"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "body")))["body"], " ").alias("body"))
    synonyms = F.regexp_extract_all(F.regexp_extract("body", r"\[syn: ([^\]]*)\]", 1), F.lit(r"\{([^}]*)\}"), F.lit(1))
    quotes = F.regexp_extract_all("body", F.lit('"([^"]*)"'), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("body", r'\[syn: [^\]]*\]', ""), r'[;,]?\s*"[^"]*"', ""))
    return whole.select("word", "part_of_speech", F.coalesce("num", F.lit(1)).alias("num"), F.regexp_replace(text, r"[;:\s]+$", "").alias("text"), quotes.alias("quotes"), synonyms.alias("synonyms"))
