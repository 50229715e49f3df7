"""Page layout, images and folder listings as tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkseek.functions.storage import numbered, written
from sparkseek.operators.index import keyed, tokens


def ocr_reading_text(ocr_rows: DataFrame, min_conf: float = 50, max_boxes: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(text, boxes) of recognised words (path, seq, level, page, block, par, line, left, top, width, height, conf, text,
    page_width, page_height). text(path, text): words joined by blanks, lines by line ends. boxes(path, word, x, y, w,
    h, line), from 0 to 1, at most max_boxes of a path, none where the page has no size."""
    words = ocr_rows.where((F.col("level") == 5) & (F.col("conf") >= min_conf) & (F.trim("text") != ""))
    order = Window.partitionBy("path").orderBy("seq")
    place = F.struct("page", "block", "par", "line")
    change = F.coalesce((F.lag(place).over(order) != place).cast("int"), F.lit(0))
    lined = words.withColumn("change", change).withColumn("ordinal", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lined.groupBy("path", "ordinal").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("w"))))["w"], " ").alias("t"))
    text = lines.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "t")))["t"], "\n").alias("text"))
    sized = lined.where((F.col("page_width") > 0) & (F.col("page_height") > 0)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_boxes)
    boxes = sized.select(
        "path", F.trim("text").alias("word"), (F.col("left") / F.col("page_width")).alias("x"), (F.col("top") / F.col("page_height")).alias("y"),
        (F.col("width") / F.col("page_width")).alias("w"), (F.col("height") / F.col("page_height")).alias("h"), F.col("ordinal").alias("line"),
    )
    return text, boxes


#: Blanks besides the separators of Unicode.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85"
LINE_ENDS = ("\r", "\n", "\r\n")
#: What page_layout() takes of a page, unless told otherwise.
MAX_GLYPHS, MAX_WORDS = 20_000, 4_000
#: Glyphs that are laid out at a time, in whole pages.
_GLYPHS = 500_000
_SIDES = ["left", "right", "top", "bottom"]
#: So many terms are broadcast to the words.
_FEW = 200_000


def page_layout(glyphs: DataFrame, max_glyphs: int = MAX_GLYPHS, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, page, line, word, text, left, right, top, bottom, truncated): words and lines of glyphs(doc_id, page, seq,
    ch, left, right, top, bottom). A line ends at a line end, or where a glyph's middle is off the line's by 0.6 of its
    height; a word ends at a blank, or at a gap over 0.25 of it. Pages beyond a cap are marked truncated; glyphs without
    a character are none.

    One page is one group, which max_glyphs bounds. Whoever has pages whole gives pages(doc_id, page, glyphs), a row for
    each with an array of its glyphs (seq, ch, left, right, top, bottom), and no glyph is shuffled."""
    if "glyphs" not in glyphs.columns:
        order = Window.partitionBy("doc_id", "page").orderBy("seq")
        kept = glyphs.where(F.length("ch") > 0).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_glyphs + 1)
        each = F.struct(F.col("n").cast("long").alias("seq"), "ch", *(F.col(c).cast("double").alias(c) for c in _SIDES))
        glyphs = kept.groupBy("doc_id", "page").agg(F.collect_list(each).alias("glyphs"))
    pages = glyphs.select("doc_id", "page", F.col("glyphs").cast("array<struct<seq:bigint,ch:string,left:double,right:double,top:double,bottom:double>>"))
    ids = pages.schema.fields[:2]
    double = T.DoubleType()
    shape = T.StructType([*ids, T.StructField("line", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(c, double) for c in _SIDES), T.StructField("truncated", T.BooleanType())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("glyphs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):  # pages of about _GLYPHS glyphs
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _GLYPHS, "right")))
                if (found := _laid_out(batch.slice(at, to - at), max_glyphs, max_words)) is not None:
                    yield found
                at = to

    return pages.mapInArrow(lay, shape)


def _exceeds(a: float, b: float) -> bool:
    """a > b as Spark compares: NaN is above all other numbers."""
    return a > b or (a != a and b == b)


def _laid_out(pages: pa.RecordBatch, max_glyphs: int, max_words: int) -> pa.RecordBatch | None:
    """Words of whole pages, see page_layout(); None where they have none. Only glyphs at which a line or word may begin are
    looked at one by one, as what they are compared with depends on the lines and words before."""
    listed = pages.column("glyphs")
    page = np.repeat(np.arange(len(listed)), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    seq, ch, *sides = listed.flatten().flatten()
    seq = seq.to_numpy(zero_copy_only=False)
    there = pc.fill_null(pc.greater(pc.binary_length(ch), 0), False).to_numpy(zero_copy_only=False)
    chosen = np.flatnonzero(there)
    if np.any((seq[chosen][1:] < seq[chosen][:-1]) & (page[chosen][1:] == page[chosen][:-1])):
        chosen = chosen[np.lexsort((seq[chosen], page[chosen]))]
    size = np.bincount(page[chosen], minlength=len(listed))
    chosen = chosen[np.arange(len(chosen)) - (np.cumsum(size) - size)[page[chosen]] < max_glyphs]
    codes = ch.take(pa.array(chosen)).dictionary_encode()
    known = [2 if c in LINE_ENDS else int(all(x in BLANKS or unicodedata.category(x)[0] == "Z" for x in c)) for c in codes.dictionary.to_pylist()]
    kind = np.array(known, np.int8)[codes.indices.to_numpy()]
    shown = np.flatnonzero(kind == 0)
    if not len(shown):
        return None
    n = len(shown)
    chosen, ended = chosen[shown], np.cumsum(kind == 2)[shown]
    page = page[chosen]
    sides = [x.take(pa.array(chosen)) for x in sides]
    absent = [x.is_null().to_numpy(zero_copy_only=False) for x in sides]
    left, right, top, bottom = values = [x.to_numpy(zero_copy_only=False) for x in sides]
    after = lambda change, opening=True: np.append(opening, change)
    opening, broken, gap = after(page[1:] != page[:-1]), after(ended[1:] > ended[:-1]), after(np.diff(shown) > 1)

    # Lines: a glyph as high as the one before, and at its height, is on its line.
    flat = absent[2] | absent[3]
    with np.errstate(all="ignore"):
        middle, height = (top + bottom) / 2, np.where(flat, 1e-9, np.maximum(bottom - top, 1e-9))
        near = (middle[1:] == middle[:-1]) & (height[1:] == height[:-1]) & np.isfinite(middle[1:]) & ~flat[1:] & ~flat[:-1]
    at = np.flatnonzero(opening | broken | after(~near))
    first, lines = [], []
    begun, line, reference, used = False, 0, 0.0, 0.0
    for new, end, none, m, h in zip(*(x[at].tolist() for x in (opening, broken, flat, middle, height)), strict=True):
        if new:
            begun, line = False, 0
        moved = begun and (end or (not none and _exceeds(abs(m - reference), 0.6 * used)))
        first.append(moved or not begun)
        line += moved
        if first[-1]:
            begun, reference, used = not none, m, h
        lines.append(line)
    begins = np.zeros(n, bool)
    begins[at] = first
    lines = np.repeat(lines, np.diff(np.append(at, n)))
    quarter = 0.25 * height[np.maximum.accumulate(np.where(begins, np.arange(n), 0))]

    # Words: the right edge so far is that of the glyph before, or beyond it.
    forced = opening | begins | gap
    with np.errstate(all="ignore"):
        close = absent[0][1:] | (left[1:] - right[:-1] <= quarter[1:])
    sound = not np.any(np.isnan(right) & ~absent[1])  # what is no number stays the edge
    at = np.flatnonzero(forced | after(~close | absent[1][:-1])) if sound else np.arange(n)
    if not np.all(forced[at]):
        opens, edge = [], None
        furthest, none = np.fmax.reduceat(right, at), np.logical_and.reduceat(absent[1], at)
        for new, x, no_left, q, r, no_right in zip(*(x.tolist() for x in (forced[at], left[at], absent[0][at], quarter[at], furthest, none)), strict=True):
            opens.append(new or edge is None or (not no_left and _exceeds(x - edge, q)))
            if opens[-1]:
                edge = None if no_right else r
            elif not no_right and _exceeds(r, edge):
                edge = r
        at = at[opens]
    of = page[at]
    ordinal = np.arange(len(at)) - np.searchsorted(of, of)
    n_words = np.bincount(of, minlength=len(listed))
    kept = pa.array(ordinal < max_words)

    text = ch.take(pa.array(chosen))
    offsets = np.frombuffer(text.buffers()[1], np.int32, n + 1)[np.append(at, n)]
    whole = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), text.buffers()[2])
    least = lambda k: pa.array(np.fmin.reduceat(values[k], at), mask=np.logical_and.reduceat(absent[k], at))
    most = lambda k: pa.array(np.maximum.reduceat(np.where(absent[k], -np.inf, values[k]), at), mask=np.logical_and.reduceat(absent[k], at))
    cut = (size > max_glyphs) | (n_words > max_words)
    columns = [
        pages.column("doc_id").take(pa.array(of)), pages.column("page").take(pa.array(of)), pa.array(lines[at].astype(np.int32)), pa.array(ordinal.astype(np.int32)), whole,
        least(0), most(1), least(2), most(3), pa.array(cut[of]),
    ]
    return pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], names=["doc_id", "page", "line", "word", "text", *_SIDES, "truncated"])


def span_boxes(words: DataFrame, terms: DataFrame, jump: float = 2.0, max_boxes: int = 400, stem: bool = True) -> DataFrame:
    """(query_id, doc_id, page, span, left, right, top, bottom): boxes around neighbouring words of page_layout() that
    match a query, a new one where the top jumps; at most max_boxes of a page. Words are laid out and read once, with their
    boxes, and only those that match are moved where the terms are few."""
    asked = written(terms.select("query_id", "key").distinct())
    boxed = words.select(F.struct("doc_id", "page", "word", *_SIDES).alias("at"), "text")
    found = keyed(tokens(boxed, "at"), stem).join(F.broadcast(asked) if asked.limit(_FEW + 1).count() <= _FEW else asked, "key")
    hits = found.groupBy("query_id", *(F.col(f"doc_id.{c}").alias(c) for c in ("doc_id", "page", "word"))).agg(*(F.first(f"doc_id.{c}").alias(c) for c in _SIDES))
    order = Window.partitionBy("query_id", "doc_id", "page").orderBy("word")
    apart = (F.col("word") - F.lag("word").over(order) > 1) | (F.abs(F.col("top") - F.lag("top").over(order)) > jump)
    spans = hits.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    boxes = spans.where(F.col("span") <= max_boxes).groupBy("query_id", "doc_id", "page", "span")
    return boxes.agg(F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def dominant_hue(pixels: DataFrame) -> DataFrame:
    """(image, hue, saturation, lightness) of pixels(image, r, g, b, a), 0 to 255. Transparent, near-black, near-white
    and grey pixels don't count; the others weigh by saturation in 12 buckets of hue, and the heaviest bucket's mean is
    taken, its lightness held between 0.35 and 0.65. Pre-aggregated by image and bucket."""
    c = {k: F.col(k) / 255.0 for k in "rgb"}
    high, low = F.greatest(*c.values()), F.least(*c.values())
    spread, light = high - low, (high + low) / 2
    sat = F.when(spread == 0, 0.0).otherwise(spread / (1 - F.abs(2 * light - 1)))
    sector = F.when(high == c["r"], ((c["g"] - c["b"]) / spread + 6) % 6).when(high == c["g"], (c["b"] - c["r"]) / spread + 2).otherwise((c["r"] - c["g"]) / spread + 4)
    valid = pixels.where((F.col("a") >= 128) & (spread > 0)).select("image", (60 * sector).alias("hue"), sat.alias("sat"), light.alias("light"))
    valid = valid.where(F.col("light").between(0.08, 0.95) & (F.col("sat") >= 0.15))
    by = valid.groupBy("image", F.floor(F.col("hue") / 30).alias("bucket")).agg(
        F.sum("sat").alias("weight"), *[F.sum(F.col(x) * F.col("sat")).alias(x) for x in ("hue", "light")], F.sum(F.col("sat") * F.col("sat")).alias("sat2"))
    best = by.groupBy("image").agg(F.max(F.struct("weight", (-F.col("bucket")).alias("b"), "hue", "light", "sat2")).alias("x"))
    mean = lambda k: F.col(f"x.{k}") / F.col("x.weight")
    return best.select("image", mean("hue").alias("hue"), mean("sat2").alias("saturation"), F.greatest(F.lit(0.35), F.least(F.lit(0.65), mean("light"))).alias("lightness"))


def folder_listing(catalog: DataFrame, limit: int = 200) -> DataFrame:
    """(parent, place, name, is_dir): children of each folder, folders first, then by name in any case; at most limit."""
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return catalog.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("parent", "place", "name", "is_dir")


def folder_summary(catalog: DataFrame) -> DataFrame:
    """(parent, n_folders, n_files, summary) such as "1 folder, 2 files"."""
    counted = catalog.groupBy("parent").agg(F.count_if("is_dir").alias("n_folders"), F.count_if(~F.col("is_dir")).alias("n_files"))
    say = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) == 1, "").otherwise("s")))
    text = F.concat_ws(", ", say("n_folders", "folder"), say("n_files", "file"))
    return counted.withColumn("summary", F.when(text == "", "Empty folder").otherwise(text))


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers of up to width digits."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def natural_order(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(col)), col)


def natural_places(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """df with place, the row's number in natural order of col and then of ties, from 1. Rows are sorted over ranges and
    numbered within them; what comes before a range is one number for each."""
    return numbered(df, [natural_key(F.col(col)), F.col(col), *map(F.col, ties)], "place")
