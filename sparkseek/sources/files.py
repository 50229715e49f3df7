"""File catalogs: listings of file systems, and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.storage import shared_dir

CATALOG = "path string, name string, parent string, is_dir boolean, size long, created double, modified double"



def list_folder(folder: str) -> list[tuple]:
    """CATALOG rows right in a folder, none where it can't be read. A path with a scheme, such as s3:// or hdfs://, goes
    through Arrow's file systems; its rows have URIs, and created is modified. Symbolic links aren't followed."""
    import os
    from urllib.parse import quote

    rows = []
    try:
        if "://" in folder:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(folder)
            for info in system.get_file_info(fs.FileSelector(path)):
                modified = info.mtime.timestamp() if info.mtime else 0.0
                is_dir = info.type == fs.FileType.Directory
                rows.append((f"{folder.rstrip('/')}/{quote(info.base_name)}", info.base_name, folder, is_dir, 0 if is_dir else info.size or 0, modified, modified))
            return rows
        entries = list(os.scandir(folder))
    except OSError:
        return rows
    for e in entries:
        try:
            stat, is_dir = e.stat(follow_symlinks=False), e.is_dir(follow_symlinks=False)
        except OSError:
            continue
        rows.append((e.path, e.name, folder, is_dir, 0 if is_dir else stat.st_size, getattr(stat, "st_birthtime", stat.st_ctime), stat.st_mtime))
    return rows


_ROUND = f"{CATALOG}, level int, listed boolean"
#: Folders that a task lists in a round at most, besides those that it is given: one in the first, then four times more.
_MOST = 4096


def _walk(depth: int | None, endings: list[str] | None, most: int):
    import re

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, rows = most, []
        columns = [c.split()[0] for c in _ROUND.split(", ")]
        for batch in batches:
            for given in zip(batch["path"], batch["level"], strict=True):
                waiting = [given]
                while waiting:
                    folder, level = waiting.pop()
                    for row in list_folder(folder):
                        deeper = row[3] and (depth is None or level + 1 < depth)
                        if deeper and left > 0:
                            left -= 1
                            waiting.append((row[0], level + 1))
                            deeper = False
                        ending = re.search(r"[^/]\.([^./]+)$", row[1])
                        if row[3] or endings is None or (ending and ending[1].lower() in endings):
                            rows.append((*row, level + 1, not deeper))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return rows_of


def scan_catalog(spark: SparkSession, roots: list[str], depth: int | None = None, extensions: list[str] | None = None) -> DataFrame:
    """CATALOG of all that is below the roots, each path once even if roots overlap; with depth, of that many levels only,
    and with extensions, of folders and files with one of them. Executors must reach the folders.

    Folders are listed in rounds. A task lists what it is given and goes on below until it has listed enough; folders
    that are left are dealt to all tasks in the next round, so a deep or wide folder doesn't stay with one. Rounds are
    kept in the shared folder, so a lost executor costs the folders of a task. It lists when it is called."""
    tops = [r.rstrip("/") or "/" for r in dict.fromkeys(roots)]
    if depth is None:  # what is below another root is listed with that
        tops = [r for r in tops if not any(r != top and r.startswith(top.rstrip("/") + "/") for top in tops)]
    endings = None if extensions is None else [e.lower() for e in extensions]
    path, k, most = shared_dir(spark), 0, 1
    frontier = spark.createDataFrame([(r, 0) for r in dict.fromkeys(tops)], "path string, level int")
    while True:
        dealt = frontier.repartition(spark.sparkContext.defaultParallelism)
        dealt.mapInPandas(_walk(depth, endings, most - 1), _ROUND).write.parquet(f"{path}/round={k}")
        frontier = spark.read.parquet(f"{path}/round={k}").where("NOT listed").select("path", "level")
        if frontier.isEmpty():
            break
        k, most = k + 1, min(4 * most, _MOST)
    found = spark.read.schema(f"{_ROUND}, round int").parquet(path)
    return found.dropDuplicates(["path"]).select(*(c.split()[0] for c in CATALOG.split(", ")))


def extension(path: Column) -> Column:
    """Lower-cased extension, empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def eligible_documents(catalog: DataFrame, roots: DataFrame, extensions: list[str], max_bytes: int = 20 << 20) -> DataFrame:
    """Files of the catalog within a root of roots(root, depth, extensions), with an extension of the root's own list or
    else of the given one, and not above max_bytes. A file under several roots is listed once. A file is looked up with
    all its folders, so roots may be many."""
    from sparkseek.operators.refresh import ancestors

    given = F.array(*map(F.lit, extensions)).cast("array<string>")
    rules = roots.select(F.regexp_replace("root", "(?<=.)/+$", "").alias("root"), "depth", F.coalesce("extensions", given).alias("allowed"))
    files = catalog.where(~F.col("is_dir") & (F.col("size") <= max_bytes)).withColumn("root", F.explode(ancestors()))
    below = F.size(F.split("path", "/")) - F.when(F.col("root") == "/", 1).otherwise(F.size(F.split("root", "/")))
    hit = files.join(rules, "root").where((below >= 1) & (below <= F.col("depth")) & F.array_contains("allowed", extension(F.col("path"))))
    return hit.drop("root", "depth", "allowed").dropDuplicates(["path"])


def prune_ignored(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The catalog without paths that have an ignored name as a whole component."""
    return catalog.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, names)).cast("array<string>")))


# Categories by extension, categories of well-known names, what has a preview, and what kinds are called.
CATEGORY = {
    "code": ["ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "py", "go", "rb", "java", "kt", "kts", "swift", "php", "lua", "c", "h", "cpp", "cc", "cxx", "hh", "hpp", "sql", "sh", "bash", "zsh", "vue"],
    "web": ["html", "htm", "css", "scss", "less", "svg"],
    "data": ["json", "toml", "yaml", "yml", "xml", "ini", "conf", "cfg", "env", "lock", "db", "sqlite"],
    "docs": ["md", "txt", "rst", "log", "pdf", "doc", "docx", "odt", "csv", "tsv", "xlsx", "ods", "pptx", "odp"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "ico", "avif"],
    "media": ["mp4", "mkv", "mov", "avi", "webm", "mp3", "flac", "wav", "ogg", "m4a"],
    "archive": ["zip", "tar", "gz", "bz2", "xz", "7z", "rar", "zst"],
}
SPECIAL = {
    "code": ["dockerfile", "containerfile", "makefile", "justfile", "rakefile", "gemfile", "procfile"],
    "docs": ["license", "copying", "readme", "authors", "notice", "changelog"],
}
PREVIEW = """pdf png jpg jpeg webp gif bmp tiff tif svg csv tsv docx pptx odt odp xlsx ods rs ts tsx js jsx py go sh bash zsh
json toml ini conf cfg env yaml yml md css scss less html htm xml vue c h cpp cc cxx hh hpp java rb kt kts sql php lua
swift rst log txt""".split()
KINDS = {
    "PDF Document": ["pdf"],
    "PNG Image": ["png"],
    "JPEG Image": ["jpg", "jpeg"],
    "GIF Image": ["gif"],
    "WebP Image": ["webp"],
    "SVG Image": ["svg"],
    "TypeScript Source": ["ts", "tsx"],
    "JavaScript Source": ["js", "jsx"],
    "Rust Source": ["rs"],
    "Python Source": ["py"],
    "Go Source": ["go"],
    "Word Document": ["docx", "doc"],
    "Excel Spreadsheet": ["xlsx", "xls"],
    "PowerPoint Presentation": ["pptx", "ppt"],
    "Rich Text Document": ["rtf"],
    "OpenDocument Text": ["odt"],
    "OpenDocument Spreadsheet": ["ods"],
    "OpenDocument Presentation": ["odp"],
    "Java Source": ["java"],
    "Ruby Source": ["rb"],
    "Kotlin Source": ["kt"],
    "Kotlin Script": ["kts"],
    "Swift Source": ["swift"],
    "PHP Source": ["php"],
    "Lua Source": ["lua"],
    "C Source": ["c"],
    "C Header": ["h"],
    "C++ Source": ["cpp", "cc", "cxx"],
    "C++ Header": ["hh", "hpp"],
    "SQL Script": ["sql"],
    "Vue Component": ["vue"],
    "Markdown": ["md"],
    "Text File": ["txt"],
    "reStructuredText": ["rst"],
    "Log File": ["log"],
    "CSV Data": ["csv"],
    "TSV Data": ["tsv"],
    "Archive": ["zip", "tar", "gz", "bz2", "xz", "7z", "rar"],
    "Video": ["mp4", "mkv", "mov", "avi"],
    "Audio": ["mp3", "flac", "wav", "ogg"],
    "JSON Data": ["json"],
    "XML Document": ["xml"],
    "HTML Document": ["html"],
    "CSS Stylesheet": ["css"],
    "Sass Stylesheet": ["scss"],
    "Less Stylesheet": ["less"],
    "Shell Script": ["sh", "bash", "zsh"],
    "TOML Config": ["toml"],
    "INI Config": ["ini"],
    "Config File": ["conf", "cfg"],
    "Env File": ["env"],
    "YAML Config": ["yaml", "yml"],
}


def _lookup(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[F.lit(x) for value, keys in table.items() for k in keys for x in (k, value)])


def annotate_files(catalog: DataFrame, name_col: str = "name", path_col: str = "path", dir_col: str = "is_dir") -> DataFrame:
    """The catalog with hidden (any component begins with a dot), previewable, category and kind."""
    name = F.lower(name_col)
    ext = F.regexp_extract(name, r"[^.].*\.([a-z0-9]{1,4})$", 1)
    category = F.coalesce(F.try_element_at(_lookup(SPECIAL), name), F.try_element_at(_lookup(CATEGORY), ext), F.lit("other"))
    last = F.element_at(F.split(name, r"\."), -1)
    kind = F.when(F.col(dir_col), "Folder").otherwise(F.coalesce(F.try_element_at(_lookup(KINDS), last), F.lit("File")))
    return catalog.withColumns({
        "hidden": F.exists(F.split(path_col, "/"), lambda p: p.startswith(".") & ~p.isin(".", "..")),
        "previewable": last.isin([*PREVIEW, "dockerfile", "makefile"]), "category": category, "kind": kind,
    })
