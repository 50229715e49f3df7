"""Sources of text, tables, history, rates and package catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.sources.office import extract_office_text


def load_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


# Extensions of files whose bytes are their text.
PLAIN = """txt md rst log csv tsv json toml yaml yml ini conf cfg env xml html htm css scss less rs py js ts jsx tsx go c h cpp
cc hpp java kt rb php lua sh bash zsh sql swift vue tex""".split()

OFFICE = ["docx", "pptx", "xlsx", "odt", "ods", "odp"]


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of all files below path: plain text decoded as UTF-8, office files through their extractor.
    A file of another kind, such as a PDF without its text layer, and a damaged one has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    sound = F.is_valid_utf8(F.col("content").cast("string"))
    text = files.where(kind.isin(PLAIN)).select(
        "path", F.when(sound, F.col("content").cast("string")).alias("text"), F.when(~sound, "not UTF-8").alias("error"))
    other = files.where(~kind.isin(*PLAIN, *OFFICE)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no extractor for ."), kind).alias("error"))
    return text.unionByName(extract_office_text(files.where(kind.isin(OFFICE)))).unionByName(other)


def paginate(corpus: DataFrame) -> DataFrame:
    """(path, page, text) of PDF texts, split at form feeds, blank pages left out but counted."""
    pdf = corpus.where(F.lower("path").endswith(".pdf"))
    return pdf.select("path", F.posexplode(F.split("text", "\f")).alias("page", "text")).where(F.length(F.trim("text")) > 0)


def needs_ocr(corpus: DataFrame, least_bytes: int = 50) -> DataFrame:
    """Documents whose text is so short that it must be read from images."""
    return corpus.where(F.octet_length(F.trim(F.coalesce("text", F.lit("")))) < least_bytes)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, limit: int | None = 100) -> DataFrame:
    """Rows of a CSV or TSV file, doubled quotes and line ends in quotes as in RFC 4180; the first rows, as a preview shows."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    rows = spark.read.csv(path, sep=sep, quote='"', escape='"', multiLine=True)
    return rows if limit is None else rows.limit(limit)


def read_history_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) of lines "id TAB content"; lines without a numeric id are skipped."""
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("long").alias("id"), F.get(parts, F.lit(1)).alias("content"))
    return lines.where(F.col("id").isNotNull() & F.col("content").isNotNull())


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """(currency, rate, fetched_at) of JSON files {rates: {code: rate}, fetched_at}: codes in upper case, USD always 1.
    Files without rates give none."""
    raw = spark.read.schema("rates map<string,double>, fetched_at long").json(path, multiLine=True).where(F.size("rates") > 0)
    rows = raw.select(F.explode("rates").alias("currency", "rate"), "fetched_at").select(F.upper("currency").alias("currency"), "rate", "fetched_at").where("currency != 'USD'")
    return rows.unionByName(raw.select(F.lit("USD").alias("currency"), F.lit(1.0).alias("rate"), "fetched_at"))


PACKAGE = """name string, version string, api int, description string, author string, homepage string, keywords array<string>,
permissions struct<network array<string>, kv boolean, clipboard boolean, open_url boolean, paste boolean, spawn array<string>, bus boolean>,
download_url string, sha256 string, size_bytes long"""


def load_catalog(spark: SparkSession, path: str, schema_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) packages of JSON files {schema, packages}; rejected ones have a reason. Files of another schema
    version give none."""
    raw = spark.read.schema(f"schema int, packages array<struct<{', '.join(f'{c.strip()}' if ':' in c else c for c in _fields(PACKAGE))}>>").json(path, multiLine=True)
    entries = raw.where(F.col("schema") == schema_version).select(F.explode("packages").alias("p")).select("p.*")
    reason = (
        F.when(~F.coalesce(F.col("name").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)), "name")
        .when(F.coalesce(F.trim("version"), F.lit("")) == "", "version").when(F.col("api").isNull(), "api")
        .when(~F.coalesce(F.col("download_url").rlike("^https://"), F.lit(False)), "download_url")
        .when(~F.coalesce(F.trim("sha256"), F.lit("")).rlike("^([0-9a-fA-F]{64})?$"), "sha256")
    )
    judged = entries.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def _fields(ddl: str) -> list[str]:
    """name: type parts of a DDL string, split at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in ddl.replace("\n", " "):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [f"{n}: {t}" for n, _, t in (p.strip().partition(" ") for p in [*out, part])]
