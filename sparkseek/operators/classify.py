"""Classification of clipboard history, snippets and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What makes a snippet a color, a URL or JSON.
COLOR = r"^(#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})|(?i:rgba?)\([0-9,. %]+\))$"
COLOR_FULL = r"^(#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})|(?i:rgb)\( *[0-9.%]+ *(, *[0-9.%]+ *){2}\)|(?i:rgba)\( *[0-9.%]+ *(, *[0-9.%]+ *){3}\))$"
URL = r"^https?://\S+$"
JSON_START = r'^(\{\s*"|\[\{|\[\[)'
# Shapes of entities in a selection.
ENTITY_URL = r"(?i)^(https?://|www\.)\S+$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
MATH = r"^[0-9\s+\-*/^%().,]+$"
UNIT = r"[\p{L}0-9][\p{L}0-9./^*%]*"
CONVERSION = rf"(?i)^([0-9]+(\.[0-9]+)?\s*)?{UNIT}\s+(to|in)\s+{UNIT}$"
WORD = r"^\p{L}[\p{L}'\-]*$"
# First words of a calculation, what else makes one, and how a date query looks.
CALC_WORDS = "now today tomorrow time days utc gmt pi sqrt sin cos tan log ln".split()
CALC_CHARS = r"[0-9+\-*/^%().!]"
SIDES = r"(?i)^\s*([A-Za-z0-9/^*]{1,16})\s+(?:to|in)\s+([A-Za-z0-9/^*]{1,16})\s*$"
DATE_PROBE = r"^(now|today|tomorrow|time in )|until"
TABS = ["all", "text", "image", "url", "color"]


def content_type(text: Column, mode: str = "snippet") -> Column:
    """color, url, json or text. In mode snippet JSON is told by how it begins; in mode full it is parsed, and colors
    must have three or four numbers."""
    s = F.trim(text)
    json = F.rlike(s, F.lit(JSON_START)) if mode == "snippet" else F.rlike(s, F.lit(r"^[\[{]")) & F.try_parse_json(s).isNotNull()
    return F.when(F.rlike(s, F.lit(COLOR if mode == "snippet" else COLOR_FULL)), "color").when(F.rlike(s, F.lit(URL)) & (F.length(s) > 8), "url").when(json, "json").otherwise("text")


def image_label(label: Column) -> dict[str, Column]:
    """byte_size, format, width and height of labels such as "83 KiB png 1068x904", null where they lack one. The
    format is the first word of letters that is no unit, whatever it is, in lower case."""
    size = F.regexp_extract(label, r"(?:^|\s)([0-9]+(?:\.[0-9]+)?)\s+(?:B|KiB|MiB|GiB)(?:\s|$)", 1)
    unit = F.regexp_extract(label, r"(?:^|\s)[0-9]+(?:\.[0-9]+)?\s+(B|KiB|MiB|GiB)(?:\s|$)", 1)
    factor = F.when(unit == "KiB", 1 << 10).when(unit == "MiB", 1 << 20).when(unit == "GiB", 1 << 30).otherwise(1)
    form = F.regexp_extract(label, r"(?:^|\s)(?!(?:B|KiB|MiB|GiB)(?:\s|$))([A-Za-z]+)(?:\s|$)", 1)
    side = lambda k: F.expr("null").cast("int") if k is None else F.regexp_extract(label, r"(?:^|\s)([0-9]+)x([0-9]+)(?:\s|$)", k).try_cast("int")
    return {"byte_size": (size.try_cast("double") * factor).cast("long"), "format": F.nullif(F.lower(form), F.lit("")), "width": side(1), "height": side(2)}


def classify_history(history: DataFrame, mode: str = "snippet", image_text: DataFrame | None = None) -> DataFrame:
    """history(id, content) as (id, kind, preview, content_type, color, byte_size, format, width, height, ocr_text).

    Rows "[[ binary data LABEL ]]" are images. The preview is the first line, "(blank)" if that is empty. image_text
    (id, byte_size, text) is attached where the size agrees, or is unknown and 0."""
    label = F.regexp_extract("content", r"^\[\[ binary data (.*) \]\]$", 1)
    image = F.col("content").rlike(r"^\[\[ binary data .* \]\]$")
    first = F.trim(F.substring_index(F.trim("content"), "\n", 1))
    kind = content_type(F.col("content"), mode)
    parts = image_label(label)
    out = history.select(
        "id", F.when(image, "image").otherwise("text").alias("kind"),
        F.when(image, label).when(F.length(first) > 0, first).otherwise("(blank)").alias("preview"),
        F.when(image, "image").otherwise(kind).alias("content_type"),
        F.when(~image & (kind == "color"), F.trim("content")).alias("color"),
        *[F.when(image, c).alias(n) for n, c in parts.items()],
    )
    if image_text is None:
        return out.withColumn("ocr_text", F.lit(None).cast("string"))
    cache = image_text.select("id", F.col("byte_size").alias("cached_size"), F.col("text").alias("ocr_text"))
    agrees = F.coalesce(F.col("byte_size"), F.lit(0)) == F.col("cached_size")
    return out.join(cache, "id", "left").withColumn("ocr_text", F.when((F.col("kind") == "image") & agrees, F.col("ocr_text"))).drop("cached_size")


def facet_counts(history: DataFrame) -> DataFrame:
    """One row with the number of entries in each tab."""
    return history.agg(F.count("*").alias("all"), *[F.count_if(F.col("content_type") == t).alias(t) for t in TABS[1:]])


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with chars, words and lines of a text; an empty one has no lines."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
    return docs.withColumns({"chars": F.length(text).cast("long"), "words": F.regexp_count(text, F.lit(r"\S+")).cast("long"), "lines": lines.cast("long")})


def detect_entities(snippets: DataFrame, text_col: str = "text") -> DataFrame:
    """snippets with entity: url, email, math (conversions too), word or none."""
    s = F.trim(text_col)
    is_math = F.rlike(s, F.lit(MATH)) & F.rlike(s, F.lit("[0-9]")) & F.rlike(s, F.lit(r"[+\-*/^%]"))
    entity = (
        F.when((F.length(s) == 0) | (F.length(s) > 256) | s.isNull(), "none").when(F.rlike(s, F.lit(ENTITY_URL)), "url").when(F.rlike(s, F.lit(EMAIL)), "email")
        .when(is_math | F.rlike(s, F.lit(CONVERSION)), "math").when(F.rlike(s, F.lit(WORD)) & F.length(s).between(2, 40), "word").otherwise("none")
    )
    return snippets.withColumn("entity", entity)


def route_queries(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    """queries with route (conversion, date, calculator or plain), lhs, rhs, and eval_query: a bare conversion gets the
    quantity 1."""
    q = F.trim(F.coalesce(text_col, F.lit("")))
    lhs, rhs = (F.nullif(F.regexp_extract(q, SIDES, k), F.lit("")) for k in (1, 2))
    words = F.lower(F.element_at(F.split(q, r"\s+"), 1)).isin(CALC_WORDS)
    route = (
        F.when(F.lower(q).rlike(DATE_PROBE), "date").when(lhs.isNotNull(), "conversion")
        .when(q.rlike(CALC_CHARS) | words, "calculator").otherwise("plain")
    )
    bare = lhs.isNotNull() & ~lhs.rlike("^[0-9]")
    return queries.withColumns({"route": route, "lhs": lhs, "rhs": rhs, "eval_query": F.when(bare, F.concat(F.lit("1 "), q)).otherwise(F.col(text_col))})


def log_tail(logs: DataFrame, n: int = 200, max_bytes: int = 4096) -> DataFrame:
    """The last n of logs(source, ts, seq, message) of each source, oldest first, messages cut to max_bytes at a
    character's boundary."""
    order = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("seq"))
    last = logs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    return last.withColumn("place", F.col("n")).drop("n").withColumn("message", utf8_cut(F.col("message"), max_bytes))


def utf8_cut(text: Column, max_bytes: int) -> Column:
    """The longest beginning of a text of at most max_bytes bytes of UTF-8 that ends between characters."""
    data = text.cast("binary")
    # Bytes 10xxxxxx go on a character: step back at most 3 from the cut to where one begins.
    begins = [F.hex(F.substring(data, max_bytes + 1 - k, 1)) for k in range(4)]
    back = F.coalesce(*[F.when(~b.between("80", "BF"), F.lit(k)) for k, b in enumerate(begins)], F.lit(0))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.substring(data, F.lit(1), F.lit(max_bytes) - back).cast("string"))


def seen_actions(actions: DataFrame, limit: int = 64) -> DataFrame:
    """Of actions(source, action_id, label, hint, shortcut, ts), by source, the first limit distinct ids with their
    latest attributes and first time."""
    ids = actions.groupBy("source", "action_id").agg(F.min("ts").alias("first_seen"), F.max_by(F.struct("label", "hint", "shortcut"), "ts").alias("a"))
    order = Window.partitionBy("source").orderBy("first_seen", "action_id")
    return ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("source", "action_id", "a.label", "a.hint", "a.shortcut", "first_seen", "place")
