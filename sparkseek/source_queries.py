"""Registered queries of sources, sinks and streams. What they read are files that Spark writes from the given tables to
the shared folder first; their DuckDB counterparts read the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.storage import shared_dir
from sparkseek.operators import fuzzy, ranking, refresh, search, spelling, usage
from sparkseek.operators.index import analysed, query_terms
from sparkseek.plans.root_search import Source, Sources, gate_sources
from sparkseek.queries import CANDIDATES, COMPOSED, DECAY, PAGE_CATALOG, PINS, composed, documents, launches, page_catalog, part_queries, pins_of, query, table
from sparkseek.sources import files as filesrc
from sparkseek.sources import index_store, office, readers
from sparkseek.streaming import state

# Readers


@query("read_delimited", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, text FROM conversations")
def read_delimited(spark, d):
    """Turns as CSV with quotes and line ends within fields, read back."""
    path = shared_dir(spark)
    table(spark, d, "conversations").select("conv_id", "turn", "text").write.csv(path, quote='"', escape='"', quoteAll=True)
    return readers.read_delimited(spark, path, limit=None).toDF("conv_id", "turn", "text")


@query("read_history_lines", "SELECT event_id AS id, props AS content FROM events WHERE event_type <> 'error'")
def read_history_lines(spark, d):
    """Events as lines of a history; those of errors have no numeric id."""
    path = shared_dir(spark)
    events = table(spark, d, "events")
    events.select(F.concat(F.when(F.col("event_type") == "error", "e").otherwise(""), F.col("event_id").cast("string"), F.lit("\t"), "props").alias("value")).write.text(path)
    return readers.read_history_lines(spark, path)


@query("load_rates", """WITH r AS (SELECT n_regionkey AS fetched_at, upper(n_name) AS currency, round(avg(c_acctbal), 2) AS rate FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT currency, rate, fetched_at::BIGINT AS fetched_at FROM r UNION ALL SELECT DISTINCT 'USD', 1.0::DOUBLE, fetched_at::BIGINT FROM r""")
def load_rates(spark, d):
    """Mean balances by nation as rates, a file for each region."""
    path = shared_dir(spark)
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rates = table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey").groupBy("n_regionkey", "n_name").agg(F.round(F.avg("c_acctbal"), 2).alias("rate"))
    files = rates.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "rate"))).alias("rates"))
    files.select(F.to_json(F.struct("rates", F.col("n_regionkey").alias("fetched_at"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.load_rates(spark, path)


PACKAGE_FILES = """pkg AS (SELECT CASE WHEN p_partkey % 7 = 3 THEN 'Pkg ' ELSE 'pkg-' END || p_partkey AS name, CASE WHEN p_partkey % 11 = 5 THEN ' ' ELSE '1.' || p_size END AS version,
  CASE WHEN p_partkey % 13 = 6 THEN NULL ELSE p_size % 3 END AS api, CASE WHEN p_partkey % 17 = 2 THEN 'http' ELSE 'https' END || '://x.org/' || p_partkey AS url, CASE WHEN p_partkey % 5 = 1 THEN 'abc' ELSE '' END AS sha FROM part)"""


@query("load_catalog", f"""WITH {PACKAGE_FILES}
SELECT name, CASE WHEN name LIKE 'Pkg%' THEN 'name' WHEN version = ' ' THEN 'version' WHEN api IS NULL THEN 'api' WHEN url LIKE 'http:%' THEN 'download_url' WHEN sha <> '' THEN 'sha256' END AS reason FROM pkg""")
def load_catalog(spark, d):
    """Parts as packages in catalog files, one for each brand; good ones and rejected ones with their reason."""
    path = shared_dir(spark)
    p, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    package = F.struct(
        F.concat(F.when(p % 7 == 3, "Pkg ").otherwise("pkg-"), key).alias("name"), F.when(p % 11 == 5, " ").otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"))).alias("version"),
        F.when(p % 13 != 6, F.col("p_size") % 3).alias("api"), F.concat(F.when(p % 17 == 2, "http").otherwise("https"), F.lit("://x.org/"), key).alias("download_url"), F.when(p % 5 == 1, "abc").otherwise("").alias("sha256"))
    files = table(spark, d, "part").groupBy("p_brand", F.floor(p / 1000)).agg(F.collect_list(package).alias("packages"))
    files.select(F.to_json(F.struct(F.lit(1).alias("schema"), "packages")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    good, rejected = readers.load_catalog(spark, path)
    return good.select("name", F.lit(None).cast("string").alias("reason")).union(rejected.select("name", "reason"))


def customer_files(spark, d, ending: str) -> str:
    """A file of names for each hundred customers, sorted; returns the folder."""
    path = shared_dir(spark)
    names = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 100).alias("batch"), "c_name")
    files = names.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("value"))
    files.write.option("maxRecordsPerFile", 1).partitionBy("batch").format("csv" if ending == "csv" else "text").save(path)
    return path


@query("load_text_corpus", "SELECT (c_custkey // 100)::VARCHAR AS batch, string_agg(c_name, chr(10) ORDER BY c_name) || chr(10) AS text FROM customer GROUP BY c_custkey // 100")
def load_text_corpus(spark, d):
    files = readers.load_text_corpus(spark, customer_files(spark, d, "txt"))
    return files.select(F.regexp_extract("path", "batch=([0-9]+)", 1).alias("batch"), "text")


@query("load_documents", "SELECT (c_custkey // 100)::VARCHAR AS batch, string_agg(c_name, chr(10) ORDER BY c_name) || chr(10) AS text, true AS sound FROM customer GROUP BY c_custkey // 100")
def load_documents(spark, d):
    files = readers.load_documents(spark, customer_files(spark, d, "txt"))
    return files.select(F.regexp_extract("path", "batch=([0-9]+)", 1).alias("batch"), "text", F.col("error").isNull().alias("sound"))


@query("scan_catalog", "SELECT (c_custkey // 100)::VARCHAR AS batch, sum(length(c_name) + 1)::BIGINT AS size, 1::BIGINT AS n_files FROM customer GROUP BY c_custkey // 100")
def scan_catalog(spark, d):
    """What a scan of two overlapping roots finds of written files."""
    path = customer_files(spark, d, "txt").removeprefix("file:").replace("///", "/")
    found = filesrc.scan_catalog(spark, [path, f"{path}/batch=0"]).where(~F.col("is_dir") & F.col("name").startswith("part-"))
    return found.groupBy(F.regexp_extract("parent", "batch=([0-9]+)", 1).alias("batch")).agg(F.sum("size").alias("size"), F.count("*").alias("n_files"))


@query("needs_ocr", "SELECT doc_id::VARCHAR AS path FROM documents WHERE strlen(trim(coalesce(text, ''), ' ')) < 50")
def needs_ocr(spark, d):
    return readers.needs_ocr(documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), "text")).select("path")


@query("index_upsert", r"""WITH now AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'changed text of ' || source ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'de'),
w AS (SELECT DISTINCT doc_id, strip_accents(lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')))) AS key FROM now) SELECT key, count(*) AS df FROM w WHERE key <> '' GROUP BY key""")
def index_upsert(spark, d):
    """The index of documents after those in English have changed and those in German are gone."""
    docs = table(spark, d, "documents")
    path = shared_dir(spark)
    index_store.write_index(analysed(docs, stem=False), path)
    changed = docs.where("lang = 'en'").withColumn("text", F.concat(F.lit("changed text of "), "source"))
    index_store.upsert_index(spark, path, analysed(changed, stem=False), docs.where("lang IN ('en', 'de')").select("doc_id"))
    return index_store.read_index(spark, path).term_stats


@query("index_tombstones", r"""WITH now AS (SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN 'changed text of ' || source || chr(10) || 'and more' WHEN lang = 'fr' THEN '  ' ELSE text END AS text
  FROM documents WHERE lang IS DISTINCT FROM 'de'),
w AS (SELECT doc_id, count(*) AS len FROM (SELECT doc_id, strip_accents(lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')))) AS key FROM now) WHERE key <> '' GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n_pages, sum(length(page)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page FROM now) WHERE trim(page, ' ') <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(len, 0)::BIGINT AS len, n_chars AS size, coalesce(n_pages, 0) AS n_pages, coalesce(chars, 0)::BIGINT AS chars FROM now LEFT JOIN w USING (doc_id) LEFT JOIN p USING (doc_id)""")
def index_tombstones(spark, d):
    """What the index knows of documents and their pages (lines) after one commit in which those in English have changed,
    those in French have become blank and those in German are gone: blank ones stay known, with no words and no pages."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").alias("size"))
    lines = lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    path = shared_dir(spark)
    index_store.write_index(analysed(docs, stem=False, pages=lines(docs)), path)
    other = F.when(F.col("lang") == "en", F.concat(F.lit("changed text of "), "source", F.lit("\nand more"))).otherwise("  ")
    changed = docs.where("lang IN ('en', 'fr')").withColumn("text", other)
    index_store.upsert_index(spark, path, analysed(changed, stem=False, pages=lines(changed)), docs.where("lang IN ('en', 'de', 'fr')").select("doc_id"))
    index = index_store.read_index(spark, path)
    pages = index.pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return index.documents.join(pages, "doc_id", "left").select("doc_id", zero("len"), "size", zero("n_pages"), zero("chars"))


# Office files

_SHEET = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="B1"><v>{size}</v></c><c r="C1" s="1"><v>{day}</v></c><c r="D1" t="b"><v>{flag}</v></c></row></sheetData></worksheet>'
_STYLES = '<styleSheet><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'


#: Workbooks of a task.
WORKBOOKS = 10_000


def workbooks(spark, d) -> DataFrame:
    """files(path, content): a workbook of one row for each part, as binaryFile reads them."""

    @F.pandas_udf("binary")
    def content(name: pd.Series, size: pd.Series, day: pd.Series) -> pd.Series:
        def one(n, s, k):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("xl/styles.xml", _STYLES)
                z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{n}</t></si></sst>")
                z.writestr("xl/worksheets/sheet1.xml", _SHEET.format(name=n, size=s, day=k, flag=s % 2))
            return out.getvalue()

        return pd.Series([one(*row) for row in zip(name, size, day, strict=True)])

    parts = table(spark, d, "part")
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts.count() // WORKBOOKS))  # rows are short, and one file has many
    return parts.repartition(tasks, "p_partkey").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xlsx")).alias("path"), content("p_name", "p_size", (F.col("p_partkey") % 40_000 + 1).cast("int")).alias("content"))


@query("spreadsheet_cells", """WITH p AS (SELECT p_partkey || '.xlsx' AS path, p_name, p_size, (p_partkey % 40000 + 1)::INTEGER AS n FROM part)
SELECT path, 0 AS col, 'text' AS type, p_name AS text FROM p UNION ALL SELECT path, 1, 'number', p_size::VARCHAR FROM p UNION ALL SELECT path, 3, 'boolean', CASE WHEN p_size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END FROM p
UNION ALL SELECT path, 2, CASE WHEN n = 60 THEN 'number' ELSE 'date' END, CASE WHEN n = 60 THEN '60' ELSE (DATE '1899-12-30' + n + CASE WHEN n < 60 THEN 1 ELSE 0 END)::VARCHAR END FROM p""")
def spreadsheet_cells(spark, d):
    return office.spreadsheet_cells(workbooks(spark, d)).select("path", "col", "type", "text")


@query("extract_office_text", "SELECT p_partkey || '.xlsx' AS path, p_name AS text, true AS sound FROM part")
def extract_office_text(spark, d):
    return office.extract_office_text(workbooks(spark, d)).select("path", "text", F.col("error").isNull().alias("sound"))


# Maintenance and titles


@query("refresh_derived", """WITH history AS (SELECT page_id AS id, octet_length(encode(html)) AS byte_size FROM pages), cache AS (SELECT id, byte_size + id % 2 AS cached FROM history WHERE id % 3 <> 0)
SELECT id, 'pending' AS state FROM history LEFT JOIN cache USING (id) WHERE cached IS NULL OR cached <> byte_size UNION ALL SELECT id, 'kept' FROM cache""")
def refresh_derived(spark, d):
    history = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("image").alias("kind"), F.octet_length("html").alias("byte_size"))
    cache = history.where("id % 3 <> 0").select("id", (F.col("byte_size") + F.col("id") % 2).alias("byte_size"), F.lit("").alias("text"))
    gone = cache.limit(0).unionByName(cache.select((-F.col("id") - 1).alias("id"), "byte_size", "text"))  # rows that history has no longer
    live, pending = refresh.refresh_derived(cache.unionByName(gone), history)
    return pending.select("id", F.lit("pending").alias("state")).union(live.select("id", F.lit("kept").alias("state")))


@query("file_penalties", f"""WITH {PAGE_CATALOG} SELECT mtime, (CASE WHEN is_dir THEN -700000 WHEN mtime % 3 = 0 THEN 0 ELSE -300000 END + CASE WHEN mtime % 4 = 0 THEN -200000 ELSE 0 END)::DOUBLE AS intra FROM catalog WHERE name NOT LIKE '.%'""")
def file_penalties(spark, d):
    files = page_catalog(spark, d).withColumn("previewable", F.col("mtime") % 3 == 0).withColumn("hidden", F.col("mtime") % 4 == 0)
    return fuzzy.file_penalties(files).select("mtime", "intra")


@query("title_categories", f"""WITH {CANDIDATES} SELECT query_id, id, CASE WHEN quality % 80 = 0 THEN 'file' ELSE 'app' END AS category FROM cand
UNION ALL SELECT query_id, id, 'command' FROM cand WHERE length(query_text) >= 2 AND quality >= 105""")
def title_categories(spark, d):
    rows = composed(spark, d).select("query_id", "id", "quality", F.lower("query_text").alias("norm_query"))
    apps = fuzzy.app_category(rows.withColumn("field", F.when(F.col("quality") % 80 == 0, "description").otherwise("name"))).select("query_id", "id", "category")
    return apps.unionByName(fuzzy.command_candidates(rows, min_quality=0.07).select("query_id", "id", "category"))


@query("explain_scores", f"""WITH {COMPOSED}, {PINS}, ranked AS (SELECT s.query_id, s.id, base, match_bonus, CASE WHEN p.id IS NULL THEN 0 ELSE 2e7 END::DOUBLE AS pin_bonus, penalty,
  row_number() OVER (PARTITION BY s.query_id ORDER BY score + CASE WHEN p.id IS NULL THEN 0 ELSE 2e7 END DESC, s.id)::INTEGER AS rank FROM score s LEFT JOIN pinned p USING (query_id, id))
SELECT query_id, id, rank, base, round(match_bonus, 3) AS match_bonus, 0::DOUBLE AS usage_bonus, pin_bonus, penalty FROM ranked WHERE rank <= 20""")
def explain_scores(spark, d):
    ranked = ranking.top_results(ranking.pin_bonus(composed(spark, d), part_queries(spark, d), pins_of(spark, d)))
    return ranking.explain_scores(ranked).select("query_id", "id", "rank", "breakdown.base", F.round("breakdown.match_bonus", 3).alias("match_bonus"), "breakdown.usage_bonus", "breakdown.pin_bonus", "breakdown.penalty")


@query("scoped_search", f"""WITH {COMPOSED}, ranked AS (SELECT query_id, id, 5e6 + match_bonus - penalty AS score FROM composed)
SELECT query_id, id, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ranked) WHERE rank <= 20""")
def scoped_search(spark, d):
    found = ranking.scoped_search(composed(spark, d).drop("base", "match_bonus", "penalty", "score", "usage_max"), ranking.resolve_weights(spark, weights={"file": 0}), "catalog")
    return found.select("query_id", "id", F.round("score", 3).alias("score"), "rank")


GATED = "asked AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ab ' WHEN 2 THEN 'x' ELSE c_name END AS t FROM customer)"


def gated_queries(spark, d):
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.when(k == 0, "").when(k == 1, " ab ").when(k == 2, "x").otherwise(F.col("c_name")).alias("query_text"))


@query("gate_sources", f"""WITH {GATED} SELECT query_id, 'root' AS gate FROM asked WHERE length(trim(t)) >= 2 UNION ALL SELECT query_id, 'scope' FROM asked WHERE length(trim(t)) = 0 OR length(trim(t)) >= 3""")
def gated(spark, d):
    asked = gated_queries(spark, d)
    source = Source("s", lambda q: q, min_length=2, scope_min_length=3)
    silent = gate_sources(asked, Source("quiet", lambda q: q, always_on=False))
    both = ranking.gather(gate_sources(asked, source).withColumn("gate", F.lit("root")), gate_sources(asked, source, "s").withColumn("gate", F.lit("scope")), silent.withColumn("gate", F.lit("never")))
    return both.select("query_id", "gate")


@query("registered_sources", f"""WITH {GATED}, r AS (SELECT query_id, 'ext:nations:' || n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey = 3 THEN 0 ELSE least(greatest(n_nationkey * 10.0 - 20, 0), 100) END AS relevance
  FROM asked CROSS JOIN nation WHERE length(trim(t)) >= 1) SELECT query_id, id, title, round(relevance * 3000, 3)::DOUBLE AS intra FROM r""")
def registered_sources(spark, d):
    """A source registered with the search: nations for every query that it is asked, relevance held between 0 and 100."""
    sources = Sources()
    nation = F.broadcast(table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("n_nationkey") * 10.0 - 20).alias("relevance")))
    sources.register_source(Source("nations", lambda q: q.select("query_id").join(nation)))
    return sources.candidates(gated_queries(spark, d)).select("query_id", "id", "title", F.round("intra", 3).alias("intra"))


@query("unpin", f"WITH queries AS (SELECT 1), {PINS.split('pinned AS')[0].rstrip().rstrip(',')} SELECT query, result_id FROM pins WHERE NOT (query = 'bolt' AND result_id IN (SELECT 'part:' || s_suppkey FROM supplier))")
def unpin(spark, d):
    commands = table(spark, d, "supplier").select(F.lit(" Bolt ").alias("query"), F.concat(F.lit("part:"), "s_suppkey").alias("result_id"))
    return usage.unpin(pins_of(spark, d), commands).select("query", "result_id")


@query("definition_table", """WITH e AS (SELECT p_partkey::VARCHAR AS word, p_name, p_type, p_brand FROM part)
SELECT word, 'n' AS part_of_speech, 1 AS num, p_name AS text, [p_type] AS quotes, [p_brand, 'x'] AS synonyms FROM e UNION ALL SELECT word, 'n', 2, 'second ' || p_name || ' goes on', []::VARCHAR[], []::VARCHAR[] FROM e UNION ALL SELECT word, 'v', 1, 'do it', []::VARCHAR[], []::VARCHAR[] FROM e""")
def definition_table(spark, d):
    entry = F.concat(F.lit("title line\n n 1: "), "p_name", F.lit('; "'), "p_type", F.lit('" [syn: {'), "p_brand", F.lit("}, {x}]\n   2: second "), "p_name", F.lit("\n      goes on\n v : do it"))
    return spelling.definition_table(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("word"), entry.alias("entry")))


@query("match_boxes", """WITH w AS (SELECT p_brand AS path, p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM part),
q AS (SELECT r_regionkey AS query_id, ['ring', 'bolt', 'small', 'blue', 'widget'][r_regionkey + 1] AS term FROM region)
SELECT query_id, path, 'indexed' AS status, count(DISTINCT (p_partkey, k))::INTEGER AS n, min(p_partkey)::INTEGER AS first_line FROM w JOIN q ON list_contains(regexp_extract_all(lower(word), '[a-z0-9]+'), term) GROUP BY query_id, path
UNION ALL SELECT NULL, 'nothing', 'empty', 0, NULL""")
def match_boxes(spark, d):
    """Parts as lines of an image for each brand, their words as what was recognised."""
    words = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("int").alias("line"), F.posexplode(F.split("p_name", " ")).alias("k", "word"))
    boxes = words.select("path", "word", "line", F.col("k").cast("double").alias("x"), *[F.lit(v).alias(c) for c, v in (("y", 0.0), ("w", 0.1), ("h", 0.1))])
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.get(F.array(*map(F.lit, ["ring", "bolt", "small", "blue", "widget"])), F.col("r_regionkey").cast("int")).alias("query_text"))
    indexed = boxes.select("path").distinct().union(boxes.select(F.lit("nothing").alias("path")).limit(1))
    found = search.match_boxes(query_terms(queries, stem=False), boxes, indexed, stem=False)
    first = F.array_min(F.transform("boxes", lambda b: b["line"]))
    return found.select("query_id", "path", "status", F.size("boxes").alias("n"), first.alias("first_line")).where("status = 'empty' OR query_id IS NOT NULL")


# Streams, run over what there is


def run_now(stream: DataFrame, mode: str, key_of: list | None = None) -> DataFrame:
    """What a stream gives for all that is there now, from a table in the shared folder; with key_of, of each key what the
    last micro-batch that has it gives."""
    spark = stream.sparkSession
    path, key = shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, state.ROCKSDB)
    try:
        running = (
            stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}"))
            .option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set(key, before)
    rows = spark.read.parquet(f"{path}/rows")
    if key_of is None:
        return rows.select(*stream.columns)
    last = rows.groupBy(*key_of).agg(F.max("epoch").alias("epoch"))  # an update takes the place of those before
    return rows.join(last, [*key_of, "epoch"], "left_semi").select(*stream.columns)


#: Micro-batches of a stream that a table is read as, and the files of each.
BATCHES, FILES = 3, 4


def part_of(by, low, high):
    """Which of BATCHES equal ranges of a whole number a value is in."""
    return F.floor((by - low) * BATCHES / (high - low + 1)).cast("int")


def event_stream(spark, d, df: DataFrame, by) -> DataFrame:
    """A table written as files, by ranges of a whole number one after another, and read as a stream of a micro-batch for each."""
    path, parts = shared_dir(spark), shared_dir(spark)
    low, high = df.agg(F.min(by), F.max(by)).first()
    staged = df.withColumn("part_", part_of(by, F.lit(low or 0), F.lit(high or 0)))
    shape = staged.schema
    staged.repartition("part_", F.xxhash64(*df.columns) % FILES).write.partitionBy("part_").parquet(parts)
    for k in range(BATCHES):
        spark.read.schema(shape).parquet(parts).where(F.col("part_") == k).drop("part_").repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("usage_scores_stream", f"WITH {DECAY} SELECT id, round(sum(power(2.0, -(last_launched - t) / (86400.0 * 14))), 6) AS usage_score, last_launched FROM launch JOIN last USING (id) GROUP BY ALL")
def usage_scores_stream(spark, d):
    stream = event_stream(spark, d, launches(spark, d), F.col("ts"))
    kinds = [r[0] for r in launches(spark, d).select("kind").distinct().limit(1000).collect()]  # a handful of types
    return run_now(state.stream_usage(stream, kinds=kinds), "update", ["id"]).select("id", F.round("usage_score", 6).alias("usage_score"), "last_launched")


MERGED = """WITH b AS (SELECT user_id % 10 AS query_id, event_type AS source, event_id AS seq, event_type = 'view' AS volatile, 'r' || (value * 100)::BIGINT % 50 AS id, value AS score FROM events),
last AS (SELECT query_id, source, max(seq) AS last FROM b WHERE volatile GROUP BY ALL),
alive AS (SELECT b.* FROM b LEFT JOIN last USING (query_id, source) WHERE last IS NULL OR seq = last),
newest AS (SELECT query_id, id, arg_max(source, seq) AS source, arg_max(score, seq) AS score FROM alive GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM newest"""


@query("merge_results_stream", MERGED)
def merge_results_stream(spark, d):
    ident = F.concat(F.lit("r"), (F.round(F.col("value") * 100).cast("long") % 50).cast("string"))
    batches = table(spark, d, "events").select((F.col("user_id") % 10).alias("query_id"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("volatile"), ident.alias("id"), F.col("value").alias("score"), F.lit("").alias("title"))
    return run_now(state.stream_merged(event_stream(spark, d, batches, F.col("seq")), keep_ms=None), "update", ["query_id"]).drop("title")


@query("merge_status_stream", """WITH e AS (SELECT user_id % 10 AS query_id, event_type AS source, event_id AS seq, 'r' || user_id AS id, value AS score FROM events),
ends AS (SELECT query_id, source, CASE WHEN source = 'error' THEN 'failed' ELSE 'done' END AS title FROM e WHERE source <> 'view' GROUP BY ALL),
newest AS (SELECT query_id, id, arg_max(source, seq) AS source, arg_max(score, seq) AS score FROM e GROUP BY ALL)
SELECT query_id, id, source, score, '' AS title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM newest
UNION ALL SELECT query_id, NULL, source, NULL, title, 0 FROM ends""")
def merge_status_stream(spark, d):
    """Results of sources that come to an end: all but one are done or have failed after their last row."""
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("query_id"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), "user_id").alias("id"), F.col("value").alias("score"))
    ends = e.where("source <> 'view'").groupBy("query_id", "source").agg(F.max("seq").alias("seq"))
    ends = ends.withColumn("status", F.when(F.col("source") == "error", "failed").otherwise("done"))
    batches = e.withColumn("title", F.lit("")).unionByName(ends, allowMissingColumns=True).withColumn("volatile", F.lit(False))
    return run_now(state.stream_merged(event_stream(spark, d, batches, F.col("seq")), keep_ms=None), "update", ["query_id"])


PART = "least(2, ({by} - min({by}) OVER ()) * 3 // (max({by}) OVER () - min({by}) OVER () + 1))"


@query("drop_superseded_stream", f"""WITH e AS (SELECT event_id, event_id // 100 AS q, user_id, {PART.format(by='event_id')} AS part FROM events)
SELECT event_id FROM (SELECT event_id, q, max(q) OVER (PARTITION BY user_id ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM e) WHERE q = newest""")
def drop_superseded_stream(spark, d):
    """Rows of the newest query of their session by the time that they come, in the micro-batches of the stream."""
    batches = table(spark, d, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 100).alias("query_id"), "event_id")
    return run_now(state.stream_drop_superseded(event_stream(spark, d, batches, F.col("event_id")), keep_ms=None), "append").select("event_id")


@query("file_changes_stream", """WITH e AS (SELECT '/u' || user_id || '/' || event_type AS path, epoch_us(ts) // 1000 AS seen FROM events),
b AS (SELECT *, coalesce(seen - lag(seen) OVER (PARTITION BY path ORDER BY seen) >= 21600000, true)::INT AS new FROM e),
n AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY seen RANGE UNBOUNDED PRECEDING) AS burst FROM b)
SELECT path, min(seen) AS first_seen, max(seen) AS seen_at, count(*) AS n FROM n GROUP BY path, burst HAVING max(seen) + 21600000 <= (SELECT max(seen) FROM e)""")
def file_changes_stream(spark, d):
    """Events as changes of files, each resolved when it was quiet for six hours."""
    changes = table(spark, d, "events").select(F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_type").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("seen_at"))
    quiet = run_now(state.quiet_paths(event_stream(spark, d, changes, F.col("seen_at")), "6 hours"), "append")
    return quiet.select("path", F.unix_millis("first_seen").alias("first_seen"), F.unix_millis("seen_at").alias("seen_at"), "n")


HEALTH_SQL = """WITH RECURSIVE calls AS (SELECT 'u' || user_id AS source, epoch_us(ts) // 1000 AS ts, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
run AS (
  SELECT source, 0::BIGINT AS k, 0::BIGINT AS ts, 0::BIGINT AS seq, true AS ok, true AS admitted, 0::BIGINT AS failures, 0::BIGINT AS shut, 0::BIGINT AS until FROM (SELECT DISTINCT source FROM calls)
  UNION ALL
  SELECT c.source, c.k, c.ts, c.seq, c.ok, c.ts >= until,
    CASE WHEN c.ts < until THEN failures WHEN c.ok OR failures + 1 >= 2 OR shut > 0 THEN 0 ELSE failures + 1 END,
    CASE WHEN c.ts < until THEN shut WHEN c.ok THEN 0 WHEN failures + 1 >= 2 OR shut > 0 THEN shut + 1 ELSE shut END,
    CASE WHEN c.ts < until THEN until WHEN c.ok THEN 0 WHEN failures + 1 >= 2 OR shut > 0 THEN c.ts + [30000, 120000, 600000][least(shut, 2) + 1] ELSE 0 END
  FROM run JOIN calls c ON c.source = run.source AND c.k = run.k + 1)
SELECT source, ts, seq, ok, admitted, until AS shut_until FROM run WHERE k > 0"""


def call_outcomes(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


@query("health_gate", HEALTH_SQL)
def health_gate(spark, d):
    return state.health_gate(call_outcomes(spark, d), limit=2)


@query("health_gate_stream", HEALTH_SQL)
def health_gate_stream(spark, d):
    return run_now(state.stream_health(event_stream(spark, d, call_outcomes(spark, d), F.col("ts")), limit=2), "update")
