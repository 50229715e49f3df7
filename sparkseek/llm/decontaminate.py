"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, units after numbers, and names (capitalised words within a sentence) become typed
placeholders. Windows of benchmark items and of documents are hashed in two forms, literal and template, and
hash-joined. Literal windows count as they are. Where only a template window matches, the values in its slots must fit:
along one alignment of an item with a document, in all such places equal values of the item stand for equal values of
the document. That finds items that were only given other numbers, names or units. A document is contaminated by an item when windows that fit cover enough of the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, scratch
from sparkseek.llm.kernels import ALNUM, FOLDED, buffers, mix64, ngrams, slices, tokens

# Units of measure, as words after a number.
UNITS = """m meter meters metre metres km kilometer kilometers kilometre kilometres cm mm mile miles foot feet ft inch
inches yard yards g gram grams kg kilogram kilograms mg ton tons pound pounds lb lbs ounce ounces oz l liter liters litre
litres ml gallon gallons second seconds s minute minutes min hour hours h day days week weeks month months year years
dollar dollars usd euro euros eur cent cents percent degree degrees celsius fahrenheit kelvin joule joules watt watts
volt volts amp amps newton newtons hertz hz mph kmh byte bytes kb mb gb""".split()
_NUMBER, _UNIT, _NAME, _LITERAL = (mix64(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104))
_BLOCK = 2_000_000
_LEAST = 2
#: Items of fewer tokens are found word for word only.
_TEMPLATED = 4
_HIT = "id {id}, mark long, width int, hash long, at int, kind int, slots array<string>"
#: Kinds of windows: literal ones, of a place that a template window covers too or that has no slots, or of another
#: place; template ones with literals enough, or with few.
_PLACED, _BARE, _TEMPLATE, _SPARSE = range(4)


def _unit_hashes() -> np.ndarray:
    return np.sort(tokens(*buffers(pa.array([" ".join(UNITS)])), classes=ALNUM, values=FOLDED)[0])


class Canonical:
    """Tokens of an Arrow text column, as they are and as a template."""

    def __init__(self, texts, units: np.ndarray):
        self.raw, offsets = buffers(texts)
        raw = self.raw
        hashed, row, start, end = tokens(raw, offsets, classes=ALNUM, values=FOLDED, places=True)
        digit = np.isin(raw[start] - 48, np.arange(10, dtype=np.uint8)) if len(start) else np.zeros(0, bool)
        # Digits with one . or , between are one number.
        joined = np.zeros(len(start), bool)
        if len(start) > 1:
            mark = raw[np.minimum(end[:-1], len(raw) - 1)]
            joined[1:] = digit[1:] & digit[:-1] & (row[1:] == row[:-1]) & (start[1:] - end[:-1] == 1) & ((mark == 46) | (mark == 44))
        first = np.flatnonzero(~joined)
        self.row, self.start = row[first], start[first]
        self.end = end[np.append(first[1:], len(start)) - 1] if len(first) else end
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        self.literal = np.add.reduceat(mix64(hashed + place.astype(np.uint64)), first) if len(first) else hashed
        number = digit[first]
        before = np.append(-1, self.row[:-1]) == self.row if len(first) else np.zeros(0, bool)
        follows = np.append(False, number[:-1]) & before if len(first) else number
        unit = follows & np.isin(hashed[first], units)
        one, two = raw[self.start], raw[np.minimum(self.start + 1, self.end - 1)] if len(first) else raw[:0]
        capital = ((one >= 65) & (one <= 90) & ~((two >= 65) & (two <= 90)) & (self.end - self.start > 1)) | ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E))
        stops = np.append(0, np.cumsum(np.isin(raw, np.frombuffer(b".!?:;\n\"", np.uint8))))
        within = before.copy()
        if len(first) > 1:
            within[1:] &= stops[self.start[1:]] == stops[self.end[:-1]]
        name = capital & within & ~number & ~unit
        self.kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        self.template = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], mix64(self.literal))
        counts = np.bincount(self.row, minlength=len(texts))
        self.row_first = np.cumsum(counts) - counts
        self.counts = counts

    def windows(self, width: int, min_literals: int, least_literals: int):
        """(hash, row, token, kind) of literal windows and of template windows with slots and least_literals literals;
        those with fewer than min_literals are _SPARSE. A least of width leaves literal windows only."""
        n = len(self.row) - width + 1
        if n <= 0:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty, empty
        token = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        literal, row = ngrams(self.literal, self.row, width)
        template, _ = ngrams(self.template, self.row, width)
        plain = np.append(0, np.cumsum(self.kind == 0))
        plain = plain[token + width] - plain[token]
        slotted = (plain < width) & (plain >= least_literals)
        return (
            np.concatenate([mix64(literal + _LITERAL), template[slotted]]), np.concatenate([row, row[slotted]]), np.concatenate([token, token[slotted]]),
            np.concatenate([np.where(plain < least_literals, _BARE, _PLACED), np.where(plain[slotted] < min_literals, _SPARSE, _TEMPLATE)]),
        )

    def slots(self, token: int, width: int) -> list[str]:
        """Values of a window's slots, folded as literal tokens are."""
        return [bytes(self.raw[self.start[t] : self.end[t]]).decode("utf-8", "replace").lower() for t in range(token, token + width) if self.kind[t]]


def _hits(texts: DataFrame, width: int, min_literals: int, widths: list[int], wanted, id_type: str) -> DataFrame:
    """Windows of texts(id, mark, text) whose hash is in the sorted array wanted (a broadcast), or all where it is None.
    For items, whose windows are all wanted, a text shorter than width is one window of all its tokens; half of them
    being literals is enough for its template, and one of fewer than _TEMPLATED tokens has none."""

    def needed(w: int) -> tuple[int, int]:
        if w == width:
            return min_literals, min(min_literals, _LEAST)
        return 2 * (min(min_literals, (w + 1) // 2) if w >= _TEMPLATED else w,)

    def find(batches):
        units = _unit_hashes()
        for batch in batches:
            for part in slices(batch):
                canonical = Canonical(part.column("text"), units)
                ids, marks = part.column("id"), part.column("mark")
                which, out = [], {"width": [], "hash": [], "at": [], "kind": [], "slots": []}
                for w in widths:
                    hashed, row, token, kind = canonical.windows(w, *needed(w))
                    if wanted is None:
                        keep = np.flatnonzero((canonical.counts[row] == w) | (w == width))
                    else:
                        spot = np.minimum(np.searchsorted(wanted.value, hashed), len(wanted.value) - 1)
                        keep = np.flatnonzero(wanted.value[spot] == hashed)
                        if w < _TEMPLATED:  # a whole item: one place of each in a text tells as much as all, and may be a common word's
                            keep = keep[np.unique(np.stack([row[keep].astype(np.uint64), hashed[keep]]), axis=1, return_index=True)[1]]
                    for k in keep.tolist():
                        which.append(int(row[k]))
                        out["width"].append(w)
                        out["hash"].append(int(hashed[k].view(np.int64)))
                        out["at"].append(int(token[k] - canonical.row_first[row[k]]))
                        out["kind"].append(int(kind[k]))
                        out["slots"].append(canonical.slots(int(token[k]), w) if kind[k] >= _TEMPLATE else [])
                if which:
                    which = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(which), marks.take(which), pa.array(out["width"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["slots"], pa.list_(pa.string()))],
                        names=["id", "mark", "width", "hash", "at", "kind", "slots"],
                    )

    return texts.mapInArrow(find, _HIT.format(id=id_type))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 8, min_literals: int = 5, min_coverage: float = 0.4, enough: int = 6, shortest: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, mark, item_col, n_matched, n_windows, coverage, reworded): documents and the items they contain.

    n_matched: of the item's window places those that a fitting window of the document covers; coverage is their share
    of n_windows. It is at least min_coverage, or as many places as enough fit: six windows of eight tokens are thirteen
    in a row. Both counts are of all the item's places, or, where the share is larger so, of those that a template can
    cover: places with two literals or more, and those without slots. Template windows with fewer literals than
    min_literals only count where one alignment covers all of the latter. reworded: whether values in slots differ
    anywhere. mark: xxhash64 of the text, to tell rows of the same id apart; repeated rows give one result. Items of
    fewer than width tokens are one window, half of which must be literals for a template; items of one to three tokens
    are found word for word only. Items of fewer than shortest tokens, and null and empty texts, match nothing. A null
    id is kept as an id. An item id with several texts is one item of all their windows.

    Window hashes of the items are broadcast in blocks of about two million (16 MB); documents are read once a block."""
    with scratch(docs.sparkSession) as keep:
        return keep(_contaminated(docs, items, width, min_literals, min_coverage, enough, shortest, id_col, text_col, item_col, item_text_col))


def _contaminated(docs, items, width, min_literals, min_coverage, enough, shortest, id_col, text_col, item_col, item_text_col) -> DataFrame:
    spark = docs.sparkSession
    typed = lambda df, c: df.schema[c].dataType.simpleString()
    widths = list(range(shortest, width + 1))
    asked = items.select(F.col(item_col).alias("id"), F.lit(0).cast("long").alias("mark"), F.col(item_text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    windows = cut(_hits(asked, width, min_literals, widths, None, typed(items, item_col)))
    usable = F.col("kind") != _BARE
    n_places = windows.groupBy(F.col("id").alias("item")).agg(F.count_distinct("at").alias("n_all"), F.count_distinct(F.when(usable, F.col("at"))).alias("n_usable"))
    used = sorted(r["width"] for r in windows.select("width").distinct().collect())  # of the few in widths
    blocks = -(-windows.count() // _BLOCK)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    found = []
    for b in range(blocks):
        rows = windows.where(F.pmod("hash", F.lit(blocks)) == b).select("hash").distinct().toPandas()  # _BLOCK numbers, or a little more
        if not len(rows):
            continue
        wanted = spark.sparkContext.broadcast(np.sort(rows["hash"].to_numpy(np.int64).view(np.uint64)))
        found.append(cut(_hits(texts, width, min_literals, used, wanted, typed(docs, id_col))))
    if not found:
        found = [cut(_hits(texts.limit(0), width, min_literals, widths, None, typed(docs, id_col)))]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    ours = windows.select("hash", F.col("kind").alias("form"), F.col("id").alias("item"), F.col("at").alias("place"), F.col("slots").alias("values"))
    pair = F.arrays_zip(F.col("values").alias("a"), F.col("slots").alias("b"))
    reworded = F.col("form") >= _TEMPLATE
    placed = (
        hits.select("id", "mark", "hash", "at", "slots").join(ours, "hash")
        .groupBy("id", "mark", "item", (F.col("at") - F.col("place")).alias("shift"), "place")
        .agg(
            F.bool_or(~reworded).alias("literal"), F.bool_or(F.col("form") == _SPARSE).alias("sparse"), F.bool_or(F.col("form") != _BARE).alias("usable"),
            F.flatten(F.collect_set(F.when(reworded, pair))).alias("pairs"),
        )
        .withColumn("place", F.struct("place", "usable"))
    )
    which = {"literal": F.col("literal"), "template": ~F.col("literal") & ~F.col("sparse"), "few": ~F.col("literal") & F.col("sparse")}
    aligned = (
        placed.groupBy("id", "mark", "item", "shift")
        .agg(
            *(F.collect_list(F.when(c, F.col("place"))).alias(k) for k, c in which.items()),
            *(F.array_distinct(F.flatten(F.collect_set(F.when(c, F.col("pairs"))))).alias(k) for k, c in (("pairs", which["template"]), ("all_pairs", ~which["literal"]))),
        )
        .join(n_places, "item")
    )  # at most as many places as the item has
    fits = lambda c: F.size(c) == F.size(F.array_distinct(F.col(c)["a"]))
    every = F.concat("literal", "template", "few")
    n_usable = lambda c: F.size(F.filter(c, lambda p: p["usable"]))
    whole = fits("all_pairs") & (n_usable(every) == F.col("n_usable"))
    share = lambda n, of: F.struct(F.coalesce(F.try_divide(n, of), F.lit(0.0)).alias("coverage"), F.col(n).alias("n_matched"), F.col(of).alias("n_windows"))
    return (
        aligned.withColumn("places", F.when(whole, every).when(fits("pairs"), F.concat("literal", "template")).otherwise(F.col("literal")))
        .where(F.size("places") > 0)
        .groupBy("id", "mark", "item")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max(F.exists("all_pairs", lambda p: p["a"] != p["b"])).alias("reworded"),
            F.first("n_all").alias("n_all"), F.first("n_usable").alias("n_usable"),
        )
        .select("id", "mark", "item", "reworded", "n_all", "n_usable", F.size("places").alias("matched"), n_usable("places").alias("matched_usable"))
        .withColumn("best", F.greatest(share("matched", "n_all"), share("matched_usable", "n_usable")))
        .select("id", "mark", "item", "reworded", "matched", "best.*")
        .where((F.col("coverage") >= min_coverage) | (F.col("matched") >= enough))
        .select(F.col("id").alias(id_col), "mark", F.col("item").alias(item_col), F.col("n_matched").cast("long").alias("n_matched"), "n_windows", "coverage", "reworded")
    )
