"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound to the product of its letters' vectors, each
permuted (rotated) by its place; a document is the bundle (sum) of its trigrams' vectors; a language prototype is the
bundle of its training documents. A document gets the language of the prototype with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut
from sparkseek.llm.kernels import mix64, slices

DIM = 512
#: Places for the test whether a text is in a learned language at all.
FINE = 4096
UNKNOWN = "und"
_PART = 1 << 20
_KEPT = 24_000


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder part; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def letter_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """A row of +1 and -1 for each 16-bit letter code, always the same for the same letter."""
    words = np.arange(dim // 64, dtype=np.uint64)
    bits = mix64(mix64(letters.astype(np.uint64)[:, None] * np.uint64(1_000_003) + words) + np.uint64(0x2545F4914F6CDD1D))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def trigram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of packed trigrams (16 bits a letter)."""
    letters, where = np.unique(np.stack([codes >> 32, codes >> 16 & 0xFFFF, codes & 0xFFFF]), return_inverse=True)
    own = letter_vectors(letters, dim)
    first, second, third = where.reshape(3, -1)
    return np.roll(own, 2, axis=1)[first] * np.roll(own, 1, axis=1)[second] * own[third]


class Bundler:
    """Bundles of documents; trigram vectors are kept between documents, up to a fixed number."""

    def __init__(self, dim: int):
        self.dim, self.kept = dim, max(2, _KEPT if dim <= DIM else _KEPT * DIM // (2 * dim))
        self.vectors = np.empty((self.kept, dim), np.float32)  # by slot, filled as trigrams come
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)

    def _index(self, codes: np.ndarray) -> np.ndarray:
        """Slots of the vectors of some codes, at most kept distinct ones."""
        distinct = np.unique(codes)
        new = distinct[~np.isin(distinct, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) + len(new) > self.kept:
                self.codes, self.slots, new = np.zeros(0, np.int64), np.zeros(0, np.int64), distinct
            begin = len(self.codes)
            for a in range(0, len(new), 1024):
                part = new[a : a + 1024]
                self.vectors[begin + a : begin + a + len(part)] = trigram_vectors(part, self.dim)
            both = np.concatenate([self.codes, new])
            order = np.argsort(both)
            self.codes, self.slots = both[order], np.concatenate([self.slots, np.arange(begin, begin + len(new))])[order]
        return self.slots[np.searchsorted(self.codes, codes)]

    def _keep(self, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which characters are kept: letters, and of others the one before a letter and the one that ends a text (last)."""
        letter = self.letter[points]
        keep = letter | last
        keep[:-1] |= letter[1:] & ~last[:-1]
        return keep

    def _short(self, texts: list[str], out: np.ndarray, rows: list[int]) -> None:
        """Adds the bundles of texts to out at rows."""
        texts = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
        keep = self._keep(points, np.append(of[1:] != of[:-1], True))
        self._bundle(of[keep], np.where(self.letter[points], points & 0xFFFF, 32)[keep].astype(np.int64), out, rows)

    def _long(self, text: str, out: np.ndarray, row: int) -> None:
        """The same for one text of any length, in parts that overlap by two kept characters, so all trigrams are in one."""
        text = f" {text.lower()} "
        held = np.zeros(0, np.int64)
        for at in range(0, len(text), _PART):
            points = np.frombuffer(text[at : at + _PART + 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            ended = at + _PART >= len(text)
            last = np.zeros(len(points), bool)
            last[-1] = ended
            keep = self._keep(points, last)
            if not ended:
                keep[-1] = False  # the next part's first
            held = np.concatenate([held[-2:], np.where(self.letter[points], points & 0xFFFF, 32)[keep].astype(np.int64)])
            self._bundle(np.zeros(len(held), np.int64), held, out, [row])

    def _bundle(self, of: np.ndarray, code: np.ndarray, out: np.ndarray, rows: list[int]) -> None:
        """Adds the bundles of trigrams of kept characters, each of the text given in of."""
        if len(code) < 3:
            return
        grams = (of[:-2] << 48 | code[:-2] << 32 | code[1:-1] << 16 | code[2:])[of[:-2] == of[2:]]
        grams.sort()
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(grams))).astype(np.float32)
        docs, codes = grams[first] >> 48, grams[first] & 0xFFFFFFFFFFFF
        for a in range(0, len(codes), self.kept // 2):
            b = a + self.kept // 2
            index, part = self._index(codes[a:b]), docs[a:b]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            begin = 0
            for end in ends:
                out[rows[part[begin]]] += counts[a + begin : a + end] @ self.vectors[index[begin:end]]
                begin = end

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        some, rows, chars = [], [], 0
        for row, text in enumerate(texts):
            text = text or ""
            if len(text) > _PART:
                self._long(text, out, row)
                continue
            if chars + len(text) > _PART or len(some) > 30_000:
                self._short(some, out, rows)
                some, rows, chars = [], [], 0
            some.append(text)
            rows.append(row)
            chars += len(text)
        if some:
            self._short(some, out, rows)
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros(vectors.shape), where=length > 0)


def first_ids(named: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """Of named(id, lang), the distinct ids that come first in each language by their hash, at most per_language. Hashes
    up to a bound by language, which lets some four times as many by, are sorted; where too few are by it, as when rows
    are repeated, it is widened. So no language's ids are all in one task."""
    share = {lang: min(1.0, 4 * per_language / n) for lang, n in counts.items()}
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    while True:
        bounds = named.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(-(2**63) + s * 2**64))) for lang, s in share.items()], "lang string, most long")
        chosen = cut(
            named.join(F.broadcast(bounds), "lang").where(F.xxhash64("id") <= F.col("most")).select("id", "lang").distinct()
            .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("id", "lang")
        )
        have = dict(map(tuple, chosen.groupBy("lang").count().collect()))  # a row for each language
        few = [lang for lang, s in share.items() if s < 1 and have.get(lang, 0) < per_language]
        if not few:
            return chosen
        share |= {lang: min(1.0, 8 * share[lang]) for lang in few}


def train_prototypes(docs: DataFrame, per_language: int = 3000, dim: int = DIM, max_languages: int = 2000, pooled: bool = False,
                     id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype by language from docs with a language: of each language at most per_language documents, the first in
    the order of a hash of their id. Each counts alike, or, pooled, by its length, which takes little time with a large
    dim. Raises ValueError beyond max_languages languages."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = dict(map(tuple, named.groupBy(lang_col).count().limit(max_languages + 1).collect()))
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    chosen = first_ids(named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), counts, per_language)
    if len(counts) * per_language <= 100_000:
        chosen = F.broadcast(chosen)  # so many short rows at most
    training = named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(chosen, ["id", "lang"])

    def bundle(batches):
        bundler, sums = Bundler(dim), {}
        for batch in (part for whole in batches for part in slices(whole)):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            if pooled:
                names = sorted(set(langs))
                vectors = bundler(["\n".join(t or "" for t, one in zip(texts, langs, strict=True) if one == name) for name in names])
                langs = np.array(names, dtype=object)
            else:
                vectors = unit(bundler(texts)) * 10_000
            vectors = np.rint(vectors).astype(np.int64)  # integers: sums in any order agree
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))})

    rows = (
        training.select("lang", "text").mapInArrow(bundle, "lang string, sums array<long>")
        .select("lang", F.posexplode("sums").alias("place", "v"))
        .groupBy("lang", "place").agg(F.sum("v").alias("v"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "v")))["v"].alias("v"))
        .orderBy("lang").collect()
    )  # a row of dim numbers for each language
    return {row["lang"]: np.array(row["v"], dtype=np.float64) for row in rows}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, keep: list | None = None, text_col: str = "text") -> DataFrame:
    """All rows of docs, its columns (or those in keep), and lang_pred and score (cosine with the prototype, 0 to 1).

    A long text is bundled in parts that overlap, with the same result. Letters go by
    the lower 16 bits of their code points. A text that is null or without a letter gets und and 0, as all texts do without prototypes. Equal cosines go to the
    language that sorts first. Columns of docs with these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    names = sorted(prototypes)
    matrix = unit(np.stack([prototypes[n] for n in names])) if names else np.zeros((0, dim))
    keep = [c for c in keep or docs.columns if c in docs.columns]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches):
        bundler = Bundler(dim)
        for batch in (part for whole in batches for part in slices(whole)):
            vectors = unit(bundler(batch.column(text_col).to_pylist()))
            cosine = np.round(vectors @ matrix.T, 9)
            best = cosine.argmax(axis=1) if names else np.zeros(len(vectors), int)
            known = vectors.any(axis=1) & bool(names)
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0) if names else np.zeros(len(vectors))
            langs = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def learned(found: DataFrame, fine: dict[str, np.ndarray], dim: int = FINE, text_col: str = "text") -> DataFrame:
    """Of rows that identify() gave, those in a learned language: the cosine with one of the prototypes fine, which have
    dim places, is more than chance gives. Rows whose score with DIM places leaves no doubt of that are not bundled again.

    Cosines of unrelated texts have a standard deviation of 1 / sqrt(dim), whatever the length of the text."""
    matrix = unit(np.stack([fine[n] for n in sorted(fine)]))
    least = (3.35 + np.sqrt(2 * np.log(len(matrix)))) / np.sqrt(dim)  # about 5 / sqrt(dim) for four languages
    sure = least + 5 / np.sqrt(DIM)

    def check(batches):
        bundler = Bundler(dim)
        for batch in (part for whole in batches for part in slices(whole)):
            score = batch.column("score").to_numpy(zero_copy_only=False)
            keep, low = score >= sure, np.flatnonzero((score < sure) & (np.array(batch.column("lang_pred").to_pylist(), dtype=object) != UNKNOWN))
            for a in range(0, len(low), 256):
                some = low[a : a + 256]
                keep[some] = (unit(bundler(batch.column(text_col).take(pa.array(some)).to_pylist())) @ matrix.T).max(axis=1) >= least
            yield batch.filter(pa.array(keep))

    return found.mapInArrow(check, found.schema)
