"""Registered queries of the corpus-preparation operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.storage import read_texts
from sparkseek.llm.common import WORD, broadcast_if_small, table
from sparkseek.llm.decontaminate import contaminated
from sparkseek.llm.html_extraction import extract_main_text, train_labeller
from sparkseek.llm.language_id import held_out, identify, train_prototypes
from sparkseek.llm.licenses import RULES, SENTENCES, TAG, scan_licenses
from sparkseek.llm.line_dedup import dedup_lines
from sparkseek.llm.lm_scoring import cross_entropy_difference
from sparkseek.llm.mixing import mix
from sparkseek.llm.ngram_join import jaccard_groups
from sparkseek.llm.quality import score_quality, train_quality
from sparkseek.llm.runs import find_runs
from sparkseek.llm.topk import quantised, top_k
from sparkseek.llm.warc import archive_pages
from sparkseek.llm.whitening import whiten

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "op2_mix_sources",
    r"""
    WITH sized AS (
      SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
      FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (
      SELECT source, source_size, 2 * source_size AS most,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight
      FROM sources),
    levels AS (
      SELECT most / weight AS ratio,
             sum(most) OVER w AS full_before, sum(weight) OVER (ORDER BY most / weight DESC, source RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight_from
      FROM weighed WINDOW w AS (ORDER BY most / weight, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
      SELECT arg_min((1.5::DOUBLE * (SELECT sum(size) FROM sized) - coalesce(full_before, 0)) / weight_from, ratio) AS level FROM levels
      WHERE (1.5::DOUBLE * (SELECT sum(size) FROM sized) - coalesce(full_before, 0)) / weight_from < ratio),
    placed AS (
      SELECT doc_id, s.source, size, source_size, least(weight * level, most)::DOUBLE AS target,
             (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
      FROM sized s JOIN weighed w ON s.source IS NOT DISTINCT FROM w.source CROSS JOIN level),
    copies AS (SELECT *, unnest([start, start + source_size])::BIGINT AS first FROM placed WHERE size > 0),
    ends AS (
      SELECT *, unnest(CASE WHEN first < target AND first + size > target
        THEN list_distinct([floor(target)::BIGINT, floor(target)::BIGINT + 1, (first + size)::BIGINT]) ELSE [(first + size)::BIGINT] END) AS last
      FROM copies),
    pieces AS (SELECT *, last - coalesce(lag(last) OVER (PARTITION BY source, first ORDER BY last), first) AS words FROM ends WHERE last > first),
    stream AS (SELECT doc_id, words, sum(words) OVER (ORDER BY last::DOUBLE / target, source IS NULL, encode(source), last) AS upto FROM pieces),
    mixed AS (
      SELECT doc_id, sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(size)) FROM sized) - upto + words)))::BIGINT AS taken FROM stream GROUP BY doc_id)
    SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 3) AS target, coalesce(taken, 0) AS taken
    FROM placed LEFT JOIN mixed USING (doc_id)
    """,
)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source")
    mixed = mix(docs, weights=(5, 2, 1), share=1.5, max_repeats=2, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def _license_sql() -> str:
    """The same sentences and rules as a query: tags for every licence of an expression, pieces, their lines and ends,
    identifiers in order, rules as a pattern."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    number = {name: k for k, name in enumerate(SENTENCES)}
    known = ", ".join(f"({quoted(t)}, {number[name]})" for name, ts in SENTENCES.items() for t in ts)
    licenses = {"".join(f"<{number[n]}>" for n in names): license for license, names in reversed(RULES)}
    pattern = "|".join("".join(f"<{number[n]}@[0-9]+>" for n in names) for _, names in RULES)
    norm = lambda c: rf"trim(regexp_replace(replace(lower({c}), '+', ' plus '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
    WITH known AS (SELECT DISTINCT ON (norm) norm, k FROM (SELECT {norm('t')} AS norm, k FROM (VALUES {known}) v(t, k)) ORDER BY norm, k),
    rule AS (SELECT * FROM (VALUES {', '.join(f'({quoted(i)}, {quoted(x)})' for i, x in licenses.items())}) v(ids, license)),
    apart AS (SELECT doc_id, CASE WHEN contains(text, {quoted(TAG)}) THEN array_to_string(list_transform(string_split(text, chr(10)), lambda l:
        CASE WHEN contains(l, {quoted(TAG)}) THEN left(l, strpos(l, {quoted(TAG)}) - 1) || {quoted(TAG)} || regexp_replace(regexp_replace(
          substr(l, strpos(l, {quoted(TAG)}) + {len(TAG)}), '[ \t]+WITH[ \t]+', chr(10), 'g'), '[ \t]+(OR|AND)[ \t]+', chr(10) || {quoted(TAG + ' ')}, 'g') ELSE l END), chr(10)) ELSE text END AS text FROM documents),
    split AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?:])\s+|\n[ \t\r]*\n\s*', '\1' || chr(1), 'g'), chr(1)) AS parts FROM apart),
    pieces AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS piece FROM split),
    norms AS (SELECT doc_id, piece, list_transform(string_split(part, chr(10)), lambda l: {norm('l')}) AS ns FROM pieces WHERE part <> ''),
    lined AS (SELECT doc_id, piece, list_filter(ns, lambda n: n <> '') AS ns, list_filter(range(1, len(ns) + 1), lambda i: ns[i] <> '') AS nos FROM norms),
    limits AS (SELECT max(length(norm)) AS longest FROM known),
    starts AS (SELECT *, unnest(range(1, len(ns))) AS i FROM lined WHERE len(ns) > 1),
    spans AS (SELECT doc_id, piece, unnest(ns) AS norm, unnest(nos) AS first, unnest(nos) AS last FROM lined
      UNION ALL SELECT doc_id, piece, array_to_string(ns[i:], ' '), nos[i], nos[-1] FROM starts
        WHERE len(ns) - i < (SELECT longest FROM limits) AND list_sum(list_transform(ns[i:], lambda n: length(n) + 1)) - 1 <= (SELECT longest FROM limits)),
    hit AS (SELECT doc_id, piece, first, last, k FROM spans JOIN known USING (norm) WHERE length(norm) >= 2),
    over AS (SELECT doc_id, piece, min(first) AS first FROM hit WHERE first < last GROUP BY ALL),
    kept AS (SELECT h.* FROM hit h LEFT JOIN over o USING (doc_id, piece) WHERE o.first IS NULL OR h.first < o.first OR (h.first = o.first AND h.first < h.last)),
    far AS (SELECT *, piece - lag(piece) OVER (PARTITION BY doc_id ORDER BY piece, first, k) > 3 AS apart FROM kept),
    ids AS (SELECT doc_id, string_agg(CASE WHEN apart THEN '~' ELSE '' END || '<' || k || '@' || piece || '>', '' ORDER BY piece, first, k) AS ids FROM far GROUP BY doc_id),
    matches AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(ids, {quoted(pattern)})), '@[0-9]+', '', 'g') AS ids FROM ids)
    SELECT doc_id, license, count(*)::BIGINT AS n_matches FROM matches JOIN rule USING (ids) GROUP BY ALL
    """


@query("op8_license_scan", _license_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_licenses(docs).groupBy("doc_id", "license").agg(F.count("*").alias("n_matches"))


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    repeated AS (
      SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(keeper) FILTER (keeper <> doc_id)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = dedup_lines(docs, min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    apart = held_out("doc_id", 4, 2)
    weights = train_quality(docs.where(~apart), table(spark, sf_dir, "labels").where(~apart).select("doc_id", "quality"))
    scored = score_quality(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    apart = held_out("doc_id", 5, 0)
    prototypes = train_prototypes(docs.where(~apart))
    found = identify(docs.select("doc_id", "text"), prototypes, keep=["doc_id"])
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@query(
    "op7_jaccard_join",
    r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM split),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    both_hold AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM both_hold JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
    """,
)
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return jaccard_groups(docs, width=4, num=85, den=100)


@query(
    "op3_exact_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), factor=64)
    found = top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query(
    "op6_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    largest AS (SELECT d, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY d)
    SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
           CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN largest <> page_id THEN largest END AS refers_to
    FROM p LEFT JOIN largest USING (d)
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=1000)
    number = lambda c: F.col(c).cast("long").alias(c)
    return records.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return contaminated(docs, table(spark, sf_dir, "benchmark")).drop("mark")


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    return cross_entropy_difference(docs.join(broadcast_if_small(good), "doc_id", "left"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"], k=32)
    each = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "of"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


@query("op12_main_text")
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_texts(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract_main_text(pages, train_labeller(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id ends in 0 repeat some of their words from a place on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    g, n, words = F.floor(h / 10), F.col("n"), F.col("words")
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return docs.select("doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_made_periodic(documents(spark, sf_dir)), keep=["doc_id"], min_length=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = found.select("*", F.size("runs").cast("long").alias("n_runs"), best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
