"""Text normalisation and word keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that are dropped (combining marks and spacing accents), and accented letters with their bases.
MARKS = r"̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯¨¯´¸ʰ-˿"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
_STEMS_KEPT = 200_000
TOKEN = r"[\p{IsAlphabetic}\p{N}" + MARKS + "]+"
# Words that a search drops while others are left.
STOPWORDS = """a an and are as at be but by for if in into is it its no not of on or such that the their then there these
they this to was will with""".split()


def normalized(text: Column) -> Column:
    """Without diacritic marks, lower-case, Latin-1 accents folded; letters of their own such as ø, æ and ß stay."""
    ascii_only = F.octet_length(text) == F.length(text)  # most words are, and need no more than this
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(F.lower(F.regexp_replace(text, f"[{MARKS}]", "")), ACCENTED, PLAIN))


def normalize_terms(df: DataFrame, col: str, into: str = "norm") -> DataFrame:
    return df.withColumn(into, normalized(F.col(col)))


def token_array(text: Column) -> Column:
    """Maximal runs of letters and digits; a diacritic mark continues a word, an apostrophe ends one."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


# The suffix rules of Porter's 1980 paper, steps 2 to 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(word: str) -> str:
    """Porter's stemmer for words of a-z with three letters or more; any other word comes back as it is."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha() and word.islower()):
        return word

    def shape(stem: str) -> str:
        out = ""
        for i, c in enumerate(stem):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def measure(stem: str) -> int:
        return shape(stem).count("vc")

    def short_end(stem: str) -> bool:
        return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def double(stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"

    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (end := next((s for s in ("ed", "ing") if w.endswith(s)), None)) and "v" in shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and short_end(w)):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                if measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + other
                break
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short_end(stem)):
            w = stem
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def with_stems(words: DataFrame, col: str, into: str = "key") -> DataFrame:
    """Adds the stem of each word, in Arrow batches; a task stems a word once, and again only when it has seen
    _STEMS_KEPT others. So no join deals the occurrences of a frequent word to one task."""
    @F.pandas_udf("string")
    def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for column in batches:
            places, distinct = pd.factorize(column)
            if len(known) > _STEMS_KEPT:
                known.clear()
            stems = np.array([known[w] if w in known else known.setdefault(w, porter_stem(w)) for w in distinct] + [None], dtype=object)
            yield pd.Series(stems[places])  # -1, of nulls, is the last

    return words.withColumn(into, stem(col))
