"""Incremental maintenance of an index by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_refresh(catalog: DataFrame, file_meta: DataFrame) -> DataFrame:
    """catalog(path, mtime, size) with status: new, changed, or same where time and size both agree."""
    known = file_meta.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("known"))
    same = F.col("mtime").eqNullSafe(F.col("m")) & F.col("size").eqNullSafe(F.col("s"))
    return catalog.join(known, "path", "left").withColumn("status", F.when(F.col("known").isNull(), "new").when(same, "same").otherwise("changed")).drop("m", "s", "known")


def apply_refresh(table: DataFrame, updates: DataFrame) -> DataFrame:
    """The table with the rows of all updated paths replaced by those in updates."""
    return table.join(updates.select("path").distinct(), "path", "left_anti").unionByName(updates.select(*table.columns))


def text_rows(updates: DataFrame) -> DataFrame:
    """Updates with text: the others are kept as metadata only, so that an empty file is not read again."""
    return updates.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def remove_stale(table: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of paths in live, one row with the number of other paths)."""
    paths = live.select("path").distinct()
    gone = table.select("path").distinct().join(paths, "path", "left_anti").agg(F.count("*").alias("removed"))
    return table.join(paths, "path", "left_semi"), gone


def ancestors(path: str = "path"):
    """A path and all folders above it, the root / of absolute ones among them, as an array."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.transform(above, lambda a: F.when(a == "", "/").otherwise(a)))


def remove_subtree(table: DataFrame, dirs: DataFrame) -> DataFrame:
    """The table without each of dirs(path) and all under it. Each row is looked up with all its ancestors, so it is an
    equi-join for any number of folders, and no part of a name is a wildcard."""
    gone = dirs.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("dir")).distinct()
    under = table.select("path").distinct().withColumn("dir", F.explode(ancestors())).join(gone, "dir").select("path").distinct()
    return table.join(under, "path", "left_anti")


def refresh_derived(cache: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache, pending): rows of cache(id, byte_size, text) whose id history(id, kind, byte_size) still has, and images
    without a fresh row. A row is fresh if sizes agree, or the size is unknown and the row's is 0; empty text counts."""
    live = cache.join(history.select("id").distinct(), "id", "left_semi")
    fresh = cache.select("id", F.col("byte_size").alias("cached"))
    agrees = F.col("cached").isNotNull() & (F.coalesce("byte_size", F.lit(0)) == F.col("cached"))
    pending = history.where(F.col("kind") == "image").join(fresh, "id", "left").where(~agrees).select("id", "byte_size")
    return live, pending


# Extensions by kind of work, and seconds of a file and of a MB, at least and at most.
IMAGE = "png jpg jpeg webp gif bmp tiff tif".split()
TEXT = """txt md rst log csv tsv json toml yaml yml ini conf cfg env xml html htm css scss less rs py js ts jsx tsx go c h
cpp cc hpp java kt rb php lua sh bash zsh sql swift vue tex docx pptx xlsx odt ods odp""".split()
COSTS = {"text": ((0.002, 0.01), (0.002, 0.01)), "pdf": ((0.04, 0.03), (0.20, 1.50)), "pdf_no_ocr": ((0.04, 0.03), (0.05, 0.0)), "image": ((0.20, 0.30), (0.40, 0.80)), "other": ((0.002, 0.0), (0.002, 0.0))}


def estimate_index_cost(catalog: DataFrame, threads: int = 1, ocr_images: bool = True, ocr_pdf: bool = True) -> DataFrame:
    """(root, n_files, n_pdf, n_image, min_seconds, max_seconds) of catalog(root, path, size): files x fixed + MB x rate
    by kind of file, over threads, rounded up."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin(IMAGE), "image").when(ext.isin(TEXT), "text").otherwise("other")
    by = catalog.groupBy("root", kind.alias("kind")).agg(F.count("*").alias("n"), (F.sum("size") / (1 << 20)).alias("mb"))

    def cost(k: int):
        out = F.lit(0.0)
        for name in ("text", "pdf", "image", "other"):
            fixed, rate = COSTS["pdf_no_ocr" if name == "pdf" and not ocr_pdf else name][k]
            if name == "image" and not ocr_images:
                fixed = rate = 0.0
            out = F.when(F.col("kind") == name, F.col("n") * fixed + F.col("mb") * rate).otherwise(out)
        return F.ceil(F.round(F.sum(out) / max(1, threads), 9))

    number = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return by.groupBy("root").agg(F.sum("n").alias("n_files"), number("pdf").alias("n_pdf"), number("image").alias("n_image"), cost(0).alias("min_seconds"), cost(1).alias("max_seconds"))
