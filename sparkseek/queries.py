"""Registered queries of the search engine over the given tables, and their DuckDB counterparts.

Roles of the tables: documents are the corpus and their lines, conversations paged documents, benchmark items queries,
parts, customers and suppliers titles and candidates, events a launch log, pages a file catalog, orders amounts and
dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.storage import read_texts, state_of, written
from sparkseek.functions.text import STEP2, STEP3, STEP4
from sparkseek.operators import catalog as cat
from sparkseek.operators import classify, convert, fuzzy, layout, ranking, refresh, search, spelling, usage
from sparkseek.operators.index import analysed, build_index, query_terms, rank_vocabulary, tokens, vocabulary_counts, vocabulary_keys
from sparkseek.sources import files as filesrc
from sparkseek.sources.index_store import stored_index
from sparkseek.sources.readers import paginate
from sparkseek.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs derived from the tables


def documents(spark, d):
    return read_texts(spark, f"{d}/documents.parquet").select("doc_id", "text")


def item_queries(spark, d, words: int | None = 3):
    """Every benchmark item as a query, or its first words, as one types them."""
    first = F.array_join(F.slice(F.split("text", r"\s+"), 1, words), " ") if words else F.col("text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), first.alias("query_text"))


_STORED: dict = {}


def stored(spark, name: str, d: str, make):
    """What make() writes to the shared folder, once for a session and the documents at d as they are: an index or
    vocabulary of several queries. Other files, sizes or times of files make it anew."""
    key = (spark.sparkContext.applicationId, name, d, state_of(spark, f"{d}/documents.parquet"))
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def document_index(spark, d, stem: bool = True):
    return stored(spark, f"index {stem}", d, lambda: stored_index(analysed(documents(spark, d), stem=stem)))


def document_lines(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")


def launches(spark, d):
    """Events as launches: an item for each user and type."""
    return table(spark, d, "events").select(
        F.concat(F.lit("item:"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("id"), F.col("event_type").alias("kind"), F.unix_seconds(F.date_trunc("second", "ts")).alias("ts"))


def page_catalog(spark, d):
    """Pages as files: the URL's host and path as the path."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/+$", ""))
    return table(spark, d, "pages").select(
        path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("parent"),
        F.octet_length("html").cast("long").alias("size"), F.col("page_id").alias("mtime"), (F.col("page_id") % 5 == 0).alias("is_dir"))


PAGE_CATALOG = r"""catalog AS (
  SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, size, mtime, is_dir
  FROM (SELECT '/' || regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') AS path,
               octet_length(encode(html))::BIGINT AS size, page_id AS mtime, page_id % 5 = 0 AS is_dir FROM pages))"""

# Text and index

ITEM_TERMS = r"""
item_words AS (SELECT item_id AS query_id, array_to_string(string_split_regex(text, '\s+')[1:{n}], ' ') AS q FROM benchmark),
qtok AS (SELECT query_id, unnest(regexp_extract_all(q, '[\p{{L}}\p{{N}}]+')) AS raw, generate_subscripts(regexp_extract_all(q, '[\p{{L}}\p{{N}}]+'), 1) AS pos FROM item_words),
qlow AS (SELECT query_id, strip_accents(lower(raw)) AS norm, pos FROM qtok),
qnorm AS (SELECT query_id, norm, min(pos) AS pos FROM qlow WHERE length(norm) >= 2 GROUP BY query_id, norm),
qstop AS (SELECT *, norm IN ('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','its','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with') AS stop FROM qnorm),
qkept AS (SELECT *, bool_or(NOT stop) OVER (PARTITION BY query_id) AS ranked FROM qstop),
terms AS (
  SELECT query_id, norm, ranked, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS ord, count(*) OVER (PARTITION BY query_id) AS n_terms
  FROM qkept WHERE NOT ranked OR NOT stop)"""
DOC_TOKENS = r"""
dtok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1) - 1 AS pos FROM documents),
words AS (SELECT doc_id, pos, raw, strip_accents(lower(raw)) AS norm FROM dtok),
postings AS (SELECT norm AS key, doc_id, count(*) AS tf FROM words GROUP BY ALL),
doc_stats AS (SELECT doc_id, sum(tf) AS len FROM postings GROUP BY ALL),
term_stats AS (SELECT key, count(*) AS df FROM postings GROUP BY ALL)"""
MATCHES = r"""
matched AS (
  SELECT query_id, ord, doc_id, sum(tf) AS tf, any_value(ranked) AS ranked, any_value(n_terms) AS n_terms
  FROM terms t JOIN postings p ON CASE WHEN t.ord = t.n_terms - 1 THEN starts_with(p.key, t.norm) ELSE p.key = t.norm END GROUP BY ALL),
withdf AS (SELECT *, count(*) OVER (PARTITION BY query_id, ord) AS df FROM matched),
scored AS (
  SELECT query_id, doc_id, sum(CASE WHEN ranked THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END) AS score
  FROM withdf JOIN doc_stats USING (doc_id), (SELECT count(*) AS n, avg(len) AS mean FROM doc_stats)
  GROUP BY query_id, doc_id, n_terms HAVING count(*) = n_terms)"""


def stems_sql(norms: str) -> str:
    """CTEs that end in stems(norm, key): Porter's steps as CASE expressions over the distinct words of a CTE, with letters
    told apart as vowels (v) and consonants (c) by a string of its own."""
    consonants = "bcdfghjklmnpqrstvwxz"

    def shape(x):
        out = f"regexp_replace(translate({x}, 'aeiou{consonants}', '{'v' * 5 + 'c' * len(consonants)}'), '^y', 'c')"
        for _ in range(2):
            out = f"replace(replace({out}, 'cy', 'cv'), 'vy', 'vc')"
        return out

    measure = lambda x: f"len(regexp_extract_all({shape(x)}, 'vc'))"
    vowel = lambda x: f"contains({shape(x)}, 'v')"
    short = lambda x: f"(right({shape(x)}, 3) = 'cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"
    cut = lambda n: f"left(w, -{n})"

    def longest(rules, least, more=lambda suffix: "true"):
        cases = [f"WHEN w LIKE '%{a}' THEN CASE WHEN {measure(cut(len(a)))} > {least} AND {more(a)} THEN {cut(len(a))} || '{b}' ELSE w END" for a, b in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(cases)} ELSE w END"

    ion = lambda suffix: f"right({cut(3)}, 1) IN ('s', 't')" if suffix == "ion" else "true"
    return f"""
stem0 AS (SELECT DISTINCT norm, norm AS w, length(norm) > 2 AND regexp_full_match(norm, '[a-z]+') AS plain FROM {norms}),
stem1 AS (SELECT norm, plain, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END AS w FROM stem0),
stem2 AS (SELECT norm, plain, w NOT LIKE '%eed' AND ((w LIKE '%ed' AND {vowel(cut(2))}) OR (w LIKE '%ing' AND {vowel(cut(3))})) AS c,
  CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(cut(3))} > 0 THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' AND {vowel(cut(2))} THEN {cut(2)} WHEN w LIKE '%ing' AND {vowel(cut(3))} THEN {cut(3)} ELSE w END AS w FROM stem1),
stem3 AS (SELECT norm, plain, CASE WHEN c AND (right(w, 2) IN ('at', 'bl', 'iz') OR ({measure('w')} = 1 AND {short('w')})) THEN w || 'e'
  WHEN c AND length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right({shape('w')}, 1) = 'c' AND right(w, 1) NOT IN ('l', 's', 'z') THEN {cut(1)} ELSE w END AS w FROM stem2),
stem4 AS (SELECT norm, plain, CASE WHEN w LIKE '%y' AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w FROM stem3),
stem5 AS (SELECT norm, plain, {longest(STEP2, 0)} AS w FROM stem4),
stem6 AS (SELECT norm, plain, {longest(STEP3, 0)} AS w FROM stem5),
stem7 AS (SELECT norm, plain, {longest([(s, '') for s in STEP4], 1, ion)} AS w FROM stem6),
stem8 AS (SELECT norm, plain, CASE WHEN w LIKE '%e' AND ({measure(cut(1))} > 1 OR ({measure(cut(1))} = 1 AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END AS w FROM stem7),
stems AS (SELECT norm, CASE WHEN NOT plain THEN norm WHEN w LIKE '%ll' AND {measure(cut(1))} > 1 THEN {cut(1)} ELSE w END AS key FROM stem8)"""


@query("term_stats", f"WITH {DOC_TOKENS} SELECT key, df FROM term_stats")
def term_stats(spark, d):
    return build_index(documents(spark, d), stem=False, positions=False).term_stats


@query("bm25_topk", f"""WITH {ITEM_TERMS.format(n=3)}, {DOC_TOKENS}, {MATCHES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10""")
def bm25_topk(spark, d):
    hits = search.search(query_terms(item_queries(spark, d), stem=False), document_index(spark, d, stem=False), limit=10)
    return hits.withColumn("score", F.round("score", 4))


@query("whole_items_topk", f"""WITH {ITEM_TERMS.format(n=100000)}, {DOC_TOKENS}, {MATCHES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10""")
def whole_items_topk(spark, d):
    """Whole items as queries: documents that have all their words."""
    hits = search.search(query_terms(item_queries(spark, d, None), stem=False), document_index(spark, d, stem=False), limit=10)
    return hits.withColumn("score", F.round("score", 4))


@query("unranked_topk", f"""WITH item_words AS (SELECT n_nationkey AS query_id, ['the', 'of', 'and', 'der', 'les'][n_nationkey % 5 + 1] || ' ' || ['to', 'in', 'is'][n_nationkey % 3 + 1] AS q FROM nation),
{ITEM_TERMS.format(n=3).split('FROM benchmark),')[1]}, {DOC_TOKENS}, {MATCHES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 20""")
def unranked_topk(spark, d):
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("n_nationkey") % n).cast("int"))
    queries = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", pick(["the", "of", "and", "der", "les"], 5), pick(["to", "in", "is"], 3)).alias("query_text"))
    return search.search(query_terms(queries, stem=False), document_index(spark, d, stem=False), limit=20).withColumn("score", F.round("score", 4))


@query("query_terms", f"WITH {ITEM_TERMS.format(n=8)} SELECT query_id, ord::INTEGER AS ord, norm, ord = n_terms - 1 AS is_last, ranked FROM terms")
def query_terms_of_items(spark, d):
    return query_terms(item_queries(spark, d, 8), stem=False).drop("key")


STEMMED = f"""WITH {ITEM_TERMS.format(n=3)},
dtok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS raw FROM documents), words AS (SELECT doc_id, strip_accents(lower(raw)) AS norm FROM dtok),
both_norms AS (SELECT norm FROM words UNION SELECT norm FROM terms), {stems_sql('both_norms')},
asked AS (SELECT query_id, ord, n_terms, ranked, key FROM terms JOIN stems USING (norm)),
postings AS (SELECT key, doc_id, count(*) AS tf FROM words JOIN stems USING (norm) GROUP BY ALL), doc_stats AS (SELECT doc_id, sum(tf) AS len FROM postings GROUP BY ALL),
matched AS (SELECT query_id, ord, doc_id, sum(tf) AS tf, any_value(ranked) AS ranked, any_value(n_terms) AS n_terms
  FROM asked t JOIN postings p ON CASE WHEN t.ord = t.n_terms - 1 THEN starts_with(p.key, t.key) ELSE p.key = t.key END GROUP BY ALL),
{MATCHES[MATCHES.index('withdf AS'):]},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored), hits AS (SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
lnorms AS (SELECT DISTINCT doc_id, line, strip_accents(lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))) AS norm FROM lines),
found AS (SELECT DISTINCT query_id, doc_id, line, key FROM lnorms JOIN stems USING (norm) JOIN asked USING (key)),
covered AS (SELECT a.query_id, a.doc_id, a.line, count(DISTINCT b.key)::INTEGER AS coverage
  FROM (SELECT DISTINCT query_id, doc_id, line FROM found) a JOIN found b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.line BETWEEN a.line - 9 AND a.line GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coverage DESC, line) AS n FROM covered)"""


@query("stemmed_search", f"""{STEMMED} SELECT query_id, doc_id, round(score, 4) AS score, rank, coalesce(greatest(line - 9, 0), 0)::INTEGER AS first_line, coverage
FROM hits LEFT JOIN (SELECT * FROM best WHERE n = 1) USING (query_id, doc_id)""")
def stemmed_search(spark, d):
    """Flagship: benchmark items as queries over documents, with the best passage of every hit."""
    terms = query_terms(item_queries(spark, d))
    index = document_index(spark, d)
    hits = search.search(terms, index, limit=10)
    passages = search.indexed_passage(terms, index, hits=hits)
    shown = hits.withColumn("score", F.round("score", 4)).join(passages, ["query_id", "doc_id"], "left")
    return shown.withColumn("first_line", F.coalesce("first_line", F.lit(0)))


@query("vocabulary_keys", f"WITH {DOC_TOKENS}, {stems_sql('words')} SELECT norm, key FROM stems WHERE norm <> ''")
def vocabulary(spark, d):
    return vocabulary_keys(tokens(documents(spark, d)))


@query("rank_vocabulary", f"""WITH {DOC_TOKENS}, lemmas AS (SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark)
SELECT row_number() OVER (ORDER BY df DESC, key) AS rank, key AS word, df FROM term_stats WHERE key IN (SELECT word FROM lemmas)""")
def ranked_vocabulary(spark, d):
    return rank_vocabulary(*_vocabulary_and_lemmas(spark, d))


@query("vocabulary_counts", f"""WITH {DOC_TOKENS}, lemmas AS (SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark)
SELECT count(*) FILTER (key IN (SELECT word FROM lemmas)) AS kept, count(*) FILTER (key NOT IN (SELECT word FROM lemmas)) AS dropped FROM term_stats""")
def counted_vocabulary(spark, d):
    return vocabulary_counts(*_vocabulary_and_lemmas(spark, d))


def _vocabulary_and_lemmas(spark, d):
    vocab = document_index(spark, d, stem=False).term_stats.withColumnRenamed("key", "word")
    lemmas = tokens(table(spark, d, "benchmark"), "item_id").select(F.col("norm").alias("word")).distinct()
    return vocab, lemmas


# Retrieval

@query("best_passage_lines", f"""WITH {ITEM_TERMS.format(n=6)},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
lwords AS (SELECT DISTINCT doc_id, line, strip_accents(lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))) AS key FROM lines),
found AS (SELECT DISTINCT query_id, doc_id, line, key FROM lwords JOIN terms ON norm = key),
covered AS (SELECT a.query_id, a.doc_id, a.line, count(DISTINCT b.key)::INTEGER AS coverage
  FROM (SELECT DISTINCT query_id, doc_id, line FROM found) a JOIN found b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.line BETWEEN a.line - 9 AND a.line GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coverage DESC, line) AS n FROM covered)
SELECT query_id, doc_id, greatest(line - 9, 0)::INTEGER AS first_line, coverage FROM best WHERE n = 1""")
def best_passage_lines(spark, d):
    return search.indexed_passage(query_terms(item_queries(spark, d, 6), stem=False), document_index(spark, d, stem=False))


@query("best_page_turn", f"""WITH {ITEM_TERMS.format(n=6)},
pwords AS (SELECT DISTINCT conv_id AS doc_id, turn AS page, strip_accents(lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))) AS key FROM conversations),
covered AS (SELECT query_id, doc_id, page, count(*) AS coverage FROM pwords JOIN terms ON norm = key GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coverage DESC, page) AS n FROM covered)
SELECT query_id, doc_id, page, coverage FROM best WHERE n = 1""")
def best_page_turn(spark, d):
    return search.best_page(query_terms(item_queries(spark, d, 6), stem=False), turns(spark, d), stem=False)


SPANS = f"""WITH {ITEM_TERMS.format(n=3)}, {DOC_TOKENS}, {MATCHES},
hits AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10),
marks AS (SELECT query_id, doc_id, pos, raw, w.norm AS key, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS n
  FROM hits JOIN words w USING (doc_id) JOIN terms t USING (query_id) WHERE t.norm = w.norm),
spans AS (SELECT query_id, doc_id, pos::INTEGER AS pos, raw, key FROM marks WHERE n <= 2000)"""


def _hits(spark, d):
    terms, index = query_terms(item_queries(spark, d), stem=False), document_index(spark, d, stem=False)
    return terms, index, search.search(terms, index, limit=10)


def _spans(spark, d):
    terms, index, hits = _hits(spark, d)
    return search.indexed_spans(hits, terms, index)


@query("match_spans", f"{SPANS} SELECT * FROM spans")
def match_spans(spark, d):
    return _spans(spark, d)


@query("best_cluster", f"""{SPANS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS n FROM spans),
ahead AS (SELECT a.query_id, a.doc_id, a.pos, count(DISTINCT b.key)::INTEGER AS distinct_keys FROM numbered a JOIN numbered b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 7 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY distinct_keys DESC, pos) AS k FROM ahead)
SELECT query_id, doc_id, pos, distinct_keys FROM best WHERE k = 1""")
def best_cluster(spark, d):
    return search.best_cluster(_spans(spark, d))


@query("snippets", f"""{SPANS},
mt AS (SELECT h.query_id, h.doc_id, w.pos, w.raw, w.norm AS key, bool_or(coalesce(CASE WHEN t.ord = t.n_terms - 1 THEN starts_with(w.norm, t.norm) ELSE w.norm = t.norm END, false)) AS matched
  FROM hits h JOIN words w USING (doc_id) JOIN terms t ON t.query_id = h.query_id GROUP BY ALL),
covers AS (SELECT query_id, doc_id, pos, count(DISTINCT key) OVER (PARTITION BY query_id, doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS cover FROM mt WHERE matched),
chosen AS (SELECT query_id, doc_id, greatest(pos - 5, 0) AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY cover DESC, pos) AS n FROM covers) WHERE n = 1),
ends AS (SELECT query_id, doc_id, max(pos) AS last FROM mt GROUP BY ALL)
SELECT query_id, doc_id, CASE WHEN first > 0 THEN '…' ELSE '' END || string_agg(CASE WHEN matched THEN '[' || raw || ']' ELSE raw END, ' ' ORDER BY pos) || CASE WHEN first + 19 < last THEN '…' ELSE '' END AS snippet
FROM mt JOIN chosen USING (query_id, doc_id) JOIN ends USING (query_id, doc_id) WHERE pos BETWEEN first AND first + 19 GROUP BY query_id, doc_id, first, last""")
def snippets(spark, d):
    terms, index, hits = _hits(spark, d)
    return search.indexed_snippets(hits, terms, index)


@query("preview_lines", f"""{SPANS},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
lwords AS (SELECT DISTINCT doc_id, line, strip_accents(lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))) AS key FROM lines),
found AS (SELECT DISTINCT query_id, doc_id, line, key FROM lwords JOIN terms ON norm = key),
covered AS (SELECT a.query_id, a.doc_id, a.line, count(DISTINCT b.key)::INTEGER AS coverage
  FROM (SELECT DISTINCT query_id, doc_id, line FROM found) a JOIN found b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.line BETWEEN a.line - 9 AND a.line GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coverage DESC, line) AS n FROM covered),
near AS (SELECT query_id, doc_id, l.line, text, sum(strlen(text) + 1) OVER (PARTITION BY query_id, doc_id ORDER BY l.line) AS bytes
  FROM best JOIN hits USING (query_id, doc_id) JOIN lines l USING (doc_id) WHERE n = 1 AND l.line BETWEEN greatest(greatest(best.line - 9, 0) + 5 - 150, 0) AND greatest(greatest(best.line - 9, 0) + 5 - 150, 0) + 299)
SELECT query_id, doc_id, line, text FROM near WHERE bytes <= 65536""")
def preview_lines(spark, d):
    terms, index, hits = _hits(spark, d)
    lines = document_lines(spark, d).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    passages = search.indexed_passage(terms, index, hits=hits)
    return search.preview_lines(passages, lines)


@query("matching_cells", """WITH cells AS (SELECT p_brand AS table_id, p_partkey AS row, unnest([0, 1]) AS col, unnest([p_name, p_type]) AS text FROM part),
found AS (SELECT DISTINCT r_regionkey AS query_id, table_id, row, col FROM cells JOIN (SELECT r_regionkey, ['ring', 'bolt', 'small', 'economy', 'red'][r_regionkey + 1] AS term FROM region) ON list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), term))
SELECT *, row_number() OVER (PARTITION BY query_id, table_id ORDER BY row, col) = 1 AS first FROM found""")
def matching_cells(spark, d):
    part = table(spark, d, "part")
    cells = part.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row"), F.posexplode(F.array("p_name", "p_type")).alias("col", "text"))
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.get(F.array(*map(F.lit, ["ring", "bolt", "small", "economy", "red"])), F.col("r_regionkey").cast("int")).alias("query_text"))
    return search.matching_cells(query_terms(queries, stem=False), cells, stem=False)


# Candidates and ranking

PART_QUERIES = "queries AS (SELECT r_regionkey AS query_id, ['ring', 'small r', 'Bolt', 'blue widget', 'wid'][r_regionkey + 1] AS query_text FROM region)"
CANDIDATES = f"""{PART_QUERIES},
cand AS (
  SELECT query_id, query_text, 'part:' || p_partkey AS id, p_name AS title, ['file', 'app', 'command'][p_size % 3 + 1] AS category, p_size * 40 AS quality,
         CASE WHEN p_partkey % 7 = 0 THEN -200000 ELSE 0 END AS intra, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand || ' ' || p_name END AS exec
  FROM part CROSS JOIN queries
  UNION ALL
  SELECT query_id, query_text, 'supplier:' || s_suppkey, s_name, 'dict', (s_suppkey % 40 * 30)::INTEGER, 0, s_name FROM supplier CROSS JOIN queries),
tiered AS (
  SELECT *, CASE WHEN lower(title) = lower(query_text) THEN 'exact' WHEN starts_with(lower(title), lower(query_text)) THEN 'prefix'
                 WHEN regexp_matches(lower(title), '[^a-z0-9]' || lower(query_text)) THEN 'word_start' ELSE 'fuzzy' END AS tier FROM cand)"""
COMPOSED = f"""{CANDIDATES},
composed AS (
  SELECT *, CASE category WHEN 'app' THEN 5e6 WHEN 'command' THEN 4e6 WHEN 'file' THEN 2e6 ELSE 1e6 END::DOUBLE AS base,
         (CASE tier WHEN 'exact' THEN 7e6 WHEN 'prefix' THEN 25e5 WHEN 'word_start' THEN 4e5 ELSE 0 END + least(quality / 1500.0::DOUBLE, 1) * 300000)::DOUBLE AS match_bonus,
         (-intra)::DOUBLE AS penalty FROM tiered),
score AS (SELECT *, base + match_bonus - penalty AS score FROM composed)"""


def part_queries(spark, d):
    text = F.get(F.array(*map(F.lit, ["ring", "small r", "Bolt", "blue widget", "wid"])), F.col("r_regionkey").cast("int"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), text.alias("query_text"))


def candidates(spark, d):
    """Parts and suppliers, each a candidate of every query, with quality as a column. The queries, a row of region each,
    are broadcast."""
    queries = F.broadcast(part_queries(spark, d))
    parts = table(spark, d, "part").select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.get(F.array(*map(F.lit, ["file", "app", "command"])), F.col("p_size") % 3).alias("category"), (F.col("p_size") * 40).alias("quality"),
        F.when(F.col("p_partkey") % 7 == 0, -200_000).otherwise(0).alias("intra"), F.when(F.col("p_partkey") % 11 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("exec"))
    suppliers = table(spark, d, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("dict").alias("category"),
        (F.col("s_suppkey") % 40 * 30).cast("int").alias("quality"), F.lit(0).alias("intra"), F.col("s_name").alias("exec"))
    both = ranking.gather(parts, suppliers).join(queries)
    return both.withColumn("tier", fuzzy.match_tier(F.col("title"), F.col("query_text")))


def composed(spark, d, **how):
    return ranking.compose_score(candidates(spark, d), ranking.resolve_weights(spark, **how))


@query("match_tier", f"WITH {CANDIDATES} SELECT query_id, id, tier FROM tiered")
def match_tier(spark, d):
    return candidates(spark, d).select("query_id", "id", "tier")


@query("compose_rank", f"""WITH {COMPOSED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM score)
SELECT query_id, id, round(score, 3) AS score, rank FROM ranked WHERE rank <= 20""")
def compose_rank(spark, d):
    return ranking.top_results(composed(spark, d)).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@query("fill_when_sparse", f"""WITH {COMPOSED}, kept AS (SELECT * FROM score WHERE tier <> 'fuzzy' OR category = 'dict'),
numbered AS (SELECT *, count(*) FILTER (category <> 'dict') OVER (PARTITION BY query_id) AS others, row_number() OVER (PARTITION BY query_id, category = 'dict' ORDER BY score DESC, id) AS place FROM kept)
SELECT query_id, id, category FROM numbered WHERE category <> 'dict' OR (others < 3 AND place <= 5)""")
def fill_when_sparse(spark, d):
    few = composed(spark, d).where("tier <> 'fuzzy' OR category = 'dict'")
    return ranking.fill_when_sparse(few).select("query_id", "id", "category")


@query("dedup_topn", f"""WITH {COMPOSED}, keyed AS (SELECT *, CASE WHEN category = 'app' THEN 't:' || title ELSE 'e:' || exec END AS key FROM score),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, id) AS n FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM first WHERE n = 1 OR key IS NULL)
SELECT query_id, id, rank FROM ranked WHERE rank <= 20""")
def dedup_topn(spark, d):
    return ranking.top_results(ranking.dedup_results(composed(spark, d))).select("query_id", "id", "rank")


PINS = """pins AS (SELECT ['ring', 'small ring', 'bolt', 'blue', 'widget'][(p_partkey % 5 + 1)::INT] AS query, 'part:' || p_partkey AS result_id FROM part WHERE p_partkey % 10 < 3),
pinned AS (SELECT DISTINCT query_id, result_id AS id FROM queries JOIN pins ON starts_with(query, lower(trim(query_text))))"""


def pins_of(spark, d):
    words = F.get(F.array(*map(F.lit, ["ring", "small ring", "bolt", "blue", "widget"])), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").where("p_partkey % 10 < 3").select(words.alias("query"), F.concat(F.lit("part:"), "p_partkey").alias("result_id"), F.lit("app").alias("kind"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), (F.col("p_partkey") * 1000).alias("created_ms"))


@query("pin_bonus", f"""WITH {COMPOSED}, {PINS}, boosted AS (SELECT s.query_id, s.id, score + CASE WHEN p.id IS NULL THEN 0 ELSE 2e7 END AS score FROM score s LEFT JOIN pinned p USING (query_id, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM boosted)
SELECT query_id, id, round(score, 3) AS score, rank FROM ranked WHERE rank <= 20""")
def pin_bonus(spark, d):
    return ranking.top_results(ranking.pin_bonus(composed(spark, d), part_queries(spark, d), pins_of(spark, d))).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@query("rank_delta", f"""WITH {COMPOSED},
before AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM score),
after AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE category WHEN 'file' THEN 6e6 WHEN 'app' THEN 4e6 WHEN 'command' THEN 3e6 ELSE 1e6 END + match_bonus / 1 - penalty - least(quality / 1500.0::DOUBLE, 1) * 300000 + least(quality / 1500.0::DOUBLE, 1) * 120000 DESC, id) AS r FROM score)
SELECT query_id, id, (b.r - a.r)::INTEGER AS moved FROM before b JOIN after a USING (query_id, id)""")
def rank_delta(spark, d):
    everything = ranking.top_results(composed(spark, d), None)
    return ranking.rank_delta(everything, ranking.top_results(composed(spark, d, order=["file", "calc", "bogus", "file"], balance=80), None))


@query("usage_bonus", f"""WITH {COMPOSED}, used AS (SELECT 'part:' || l_partkey AS id, count(*) / 2.0 AS usage FROM lineitem GROUP BY l_partkey)
SELECT query_id, s.id, round(score + CASE WHEN category = 'dict' THEN 0 ELSE least(coalesce(usage, 0) / 40, 1) * 750000 END, 3) AS score FROM score s LEFT JOIN used u ON s.id = u.id""")
def usage_bonus(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("id")).agg((F.count("*") / 2.0).alias("usage_score"))
    return ranking.usage_bonus(composed(spark, d), scores).select("query_id", "id", F.round("score", 3).alias("score"))


@query("quality_gate", f"""WITH {CANDIDATES}, g AS (SELECT query_id, id, category, quality, lower(trim(query_text)) AS q FROM cand),
third AS (SELECT query_id, category, max(quality) FILTER (n = 3) AS third FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY quality DESC) AS n FROM g) GROUP BY ALL),
t AS (SELECT g.*, third, CASE WHEN length(q) <= 1 THEN 0 WHEN length(q) <= 3 THEN 900 * (length(q) - 1) / 3.0 ELSE 900 * (2 / 3.0::DOUBLE + least(length(q) - 3, 3) / 9.0::DOUBLE) END AS least_quality FROM g JOIN third USING (query_id, category))
SELECT query_id, id FROM t WHERE quality >= least(least_quality, coalesce(third, least_quality))""")
def quality_gate(spark, d):
    rows = candidates(spark, d).withColumn("norm_query", F.lower(F.trim("query_text")))
    return fuzzy.quality_gate(rows, min_quality=0.6, by=("query_id", "category")).select("query_id", "id")


@query("candidate_cut", f"""WITH {CANDIDATES}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_position(['exact', 'prefix', 'word_start', 'fuzzy'], tier), quality DESC, id) AS n FROM tiered)
SELECT query_id, id, tier FROM n WHERE n <= 128""")
def candidate_cut(spark, d):
    return fuzzy.candidate_cut(candidates(spark, d), 128).select("query_id", "id", "tier")


@query("best_field", """SELECT p_partkey AS id, CASE WHEN p_size >= 0.8 * length(p_name) AND p_size >= (p_partkey % 50) THEN 'name' WHEN 0.8 * length(p_name) >= (p_partkey % 50) THEN 'description' ELSE 'keywords' END AS field,
  greatest(p_size, 0.8::DOUBLE * length(p_name), p_partkey % 50)::DOUBLE AS score FROM part""")
def best_field(spark, d):
    fields = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("name"), F.length("p_name").cast("double").alias("description"), (F.col("p_partkey") % 50).cast("double").alias("keywords"))
    return fuzzy.best_field(fields, ["id"], {"name": 1.0, "description": 0.8, "keywords": 1.0})


# Alignment row by row: what ends at each place of the title after one more character of the query.
FUZZY = f"""{PART_QUERIES},
asked AS (SELECT query_id, lower(trim(query_text)) AS norm_query, replace(lower(trim(query_text)), ' ', '') AS q FROM queries),
full_score AS (SELECT query_id, 24 + 20 * (length(q) - 1) AS whole FROM asked),
pairs AS (SELECT query_id, norm_query, q, p_partkey AS id, p_name AS title, p_brand, lower(p_name) AS t FROM part CROSS JOIN asked WHERE lower(p_name) LIKE '%' || array_to_string(string_split(q, ''), '%') || '%'),
points AS (SELECT *, list_transform(range(1, length(t) + 1), lambda i: 16 + CASE WHEN i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[a-z0-9]') THEN 8 ELSE 0 END) AS worth FROM pairs),
aligned AS (
  SELECT query_id, id, q, t, worth, 1 AS k, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN substr(t, i, 1) = left(q, 1) THEN worth[i] END) AS here FROM points
  UNION ALL
  SELECT query_id, id, q, t, worth, k + 1, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i > 1 AND substr(t, i, 1) = substr(q, k + 1, 1)
    THEN greatest(here[i - 1] + 4, list_max(list_transform(range(1, i - 1), lambda j: here[j] - 3 - (i - 2 - j)))) + worth[i] END) FROM aligned WHERE k < length(q)),
quality AS (SELECT query_id, id, greatest(1, least(1500, round_even(1500.0::DOUBLE * list_max(here) / whole, 0)))::INTEGER AS quality FROM aligned JOIN full_score USING (query_id) WHERE k = length(q) AND list_max(here) IS NOT NULL),
fuzzy_rows AS (SELECT query_id, id, title, p_brand, norm_query, quality, CASE WHEN lower(title) = norm_query THEN 'exact' WHEN starts_with(lower(title), norm_query) THEN 'prefix'
  WHEN regexp_matches(lower(title), '[^a-z0-9]' || norm_query) THEN 'word_start' ELSE 'fuzzy' END AS tier FROM pairs JOIN quality USING (query_id, id)),
third AS (SELECT query_id, max(quality) FILTER (n = 3) AS third FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC) AS n FROM fuzzy_rows) GROUP BY query_id),
gated AS (SELECT * FROM (SELECT f.*, third, CASE WHEN length(norm_query) <= 1 THEN 0 WHEN length(norm_query) <= 3 THEN 90 * (length(norm_query) - 1) / 3.0 ELSE 90 * (2 / 3.0::DOUBLE + least(length(norm_query) - 3, 3) / 9.0::DOUBLE) END AS least_quality
  FROM fuzzy_rows f JOIN third USING (query_id)) WHERE quality >= least(least_quality, coalesce(third, least_quality)))"""
TIER_ORDER = "list_position(['exact', 'prefix', 'word_start', 'fuzzy'], tier), quality DESC"


@query("fuzzy_titles", f"""WITH RECURSIVE {FUZZY}
SELECT query_id, id, title, tier, quality FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {TIER_ORDER}, id) AS n FROM gated) WHERE n <= 128""")
def fuzzy_titles(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    found = fuzzy.fuzzy_candidates(part_queries(spark, d), titles).withColumn("tier", fuzzy.match_tier(F.col("title"), F.col("norm_query"))).withColumn("source", F.lit("part"))
    return fuzzy.candidate_cut(fuzzy.quality_gate(found), 128).select("query_id", "id", "title", "tier", "quality")


@query("merge_entries", """WITH e AS (SELECT p_name AS key, p_partkey AS priority, p_size % 9 = 0 AS hidden, CASE WHEN p_size % 7 = 0 THEN 'Link' ELSE 'Application' END AS kind, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT key, priority FROM e WHERE n = 1 AND NOT hidden AND kind = 'Application' AND priority % 4 <> 1""")
def merge_entries(spark, d):
    entries = table(spark, d, "part").select(
        F.col("p_name").alias("key"), F.col("p_partkey").alias("priority"), (F.col("p_size") % 9 == 0).alias("hidden"), F.when(F.col("p_size") % 7 == 0, "Link").otherwise("Application").alias("kind"),
        F.when(F.col("p_partkey") % 4 == 0, "GNOME;KDE;").alias("only_show_in"), F.when(F.col("p_partkey") % 4 == 1, "KDE;").alias("not_show_in"))
    return ranking.merge_entries(entries, ["KDE"]).select("key", "priority")


# Usage and stores

DECAY = """launch AS (SELECT 'item:' || user_id || ':' || event_type AS id, event_type AS kind, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
last AS (SELECT id, max(t) AS last_launched FROM launch GROUP BY id)"""


@query("usage_scores", f"WITH {DECAY} SELECT id, round(sum(power(2.0, -(last_launched - t) / (86400.0 * 14))), 6) AS usage_score, last_launched FROM launch JOIN last USING (id) GROUP BY ALL")
def usage_scores(spark, d):
    return usage.usage_scores(launches(spark, d), kinds=None).select("id", F.round("usage_score", 6).alias("usage_score"), "last_launched")


@query("usage_as_of", f"WITH {DECAY} SELECT id, round(sum(power(2.0, -(1709251200 - t) / (86400.0 * 7))), 6) AS usage_score FROM launch JOIN last USING (id) WHERE kind IN ('click', 'view') GROUP BY id")
def usage_as_of(spark, d):
    return usage.usage_scores(launches(spark, d), half_life_days=7.0, as_of=F.lit(1_709_251_200), kinds=["click", "view"]).select("id", F.round("usage_score", 6).alias("usage_score"))


@query("forget_prefix", f"WITH {DECAY} SELECT id, last_launched FROM last WHERE NOT starts_with(id, 'item:1')")
def forget_prefix(spark, d):
    return usage.forget_prefix(usage.usage_scores(launches(spark, d), kinds=None), "item:1").select("id", "last_launched")


@query("list_pins", f"WITH {PART_QUERIES}, {PINS.split('pinned AS')[0].rstrip().rstrip(',')} SELECT query, result_id, p_partkey IS NULL AS stale FROM pins LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON result_id = 'part:' || p_partkey")
def list_pins(spark, d):
    live = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return usage.list_pins(pins_of(spark, d), live).select("query", "result_id", "stale")


@query("pin_commands", """WITH old AS (SELECT ['ring', 'small ring', 'bolt', 'blue', 'widget'][(p_partkey % 5 + 1)::INT] AS query, 'part:' || p_partkey AS result_id, p_name AS title, p_partkey * 1000 AS created_ms FROM part WHERE p_partkey % 10 < 3),
cmd AS (SELECT lower(trim(CASE WHEN c_custkey % 6 = 5 THEN ' ' ELSE ' Ring ' END)) AS query, 'part:' || c_custkey % 40 AS result_id, c_name AS title, c_custkey AS created_ms, c_custkey AS seq FROM customer),
new AS (SELECT query, result_id, arg_max(title, seq) AS title, min(created_ms) AS created_ms FROM cmd WHERE query <> '' GROUP BY ALL)
SELECT n.query, n.result_id, n.title, coalesce(o.created_ms, n.created_ms) AS created_ms FROM new n LEFT JOIN old o USING (query, result_id)
UNION ALL SELECT * FROM old WHERE (query, result_id) NOT IN (SELECT (query, result_id) FROM new)""")
def pin_commands(spark, d):
    commands = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 6 == 5, " ").otherwise(" Ring ").alias("query"), F.concat(F.lit("part:"), F.col("c_custkey") % 40).alias("result_id"), F.lit("app").alias("kind"),
        F.col("c_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("c_custkey").alias("created_ms"), F.col("c_custkey").alias("seq"))
    return usage.pin(pins_of(spark, d), commands).select("query", "result_id", "title", "created_ms")


@query("unpin_matching", f"WITH {PART_QUERIES}, {PINS.split('pinned AS')[0].rstrip().rstrip(',')} SELECT query, result_id FROM pins WHERE NOT (starts_with(query, 'bl') AND result_id IN (SELECT 'part:' || s_suppkey FROM supplier))")
def unpin_matching(spark, d):
    commands = table(spark, d, "supplier").select(F.lit(" BL").alias("typed"), F.concat(F.lit("part:"), "s_suppkey").alias("result_id"))
    return usage.unpin_matching(pins_of(spark, d), commands).select("query", "result_id")


@query("namespaces", "SELECT DISTINCT 'user' || user_id % 20 AS name FROM events WHERE event_type <> 'error'")
def namespaces(spark, d):
    scheme = F.when(F.col("event_type") == "error", "app").otherwise("ext")
    return usage.namespaces(table(spark, d, "events").select(F.concat(scheme, F.lit(":user"), F.col("user_id") % 20, F.lit(":"), "event_id").alias("id")))


@query("purge_orphans", "SELECT 'kv' AS store, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def purge_orphans(spark, d):
    customer = table(spark, d, "customer")
    orders = table(spark, d, "orders").join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    installed = customer.select(F.col("c_mktsegment").alias("name")).where(F.col("name").isin("BUILDING", "MACHINERY")).distinct()
    left = usage.purge_orphans({"kv": (customer, F.col("c_mktsegment")), "orders": (orders, F.col("c_mktsegment"))}, installed)
    return ranking.gather(*[t.agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "n") for s, t in left.items()])


@query("kv_usage", """WITH kv AS (SELECT c_mktsegment AS extension, c_name AS key, c_mktsegment || c_acctbal::VARCHAR AS value FROM customer WHERE c_custkey % 2 = 0),
used AS (SELECT extension, sum(strlen(key) + strlen(c_mktsegment_value)) AS used FROM (SELECT extension, key, c_name AS c_mktsegment_value FROM (SELECT c_mktsegment AS extension, c_name AS key, c_name FROM customer WHERE c_custkey % 2 = 0)) GROUP BY extension)
SELECT c_mktsegment AS extension, c_name AS key, (used - CASE WHEN c_custkey % 2 = 0 THEN 2 * strlen(c_name) ELSE 0 END + strlen(c_name) + 5)::BIGINT AS bytes, used - CASE WHEN c_custkey % 2 = 0 THEN 2 * strlen(c_name) ELSE 0 END + strlen(c_name) + 5 > 5000 AS refused
FROM customer JOIN used ON extension = c_mktsegment""")
def kv_usage(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_mktsegment").alias("extension"), F.col("c_name").alias("key"), F.col("c_name").alias("value"), "c_custkey")
    return usage.kv_usage(customer.where("c_custkey % 2 = 0").drop("c_custkey"), customer.select("extension", "key", F.lit("vålu").alias("value")), limit=5000)


@query("kv_keys", """SELECT extension, prefix, key FROM (SELECT c_mktsegment AS extension, 'Customer#0000000' || r_regionkey AS prefix, c_name AS key, row_number() OVER (PARTITION BY c_mktsegment, r_regionkey ORDER BY c_name) AS n
  FROM customer JOIN region ON starts_with(c_name, 'Customer#0000000' || r_regionkey)) WHERE n <= 10""")
def kv_keys(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_mktsegment").alias("extension"), F.col("c_name").alias("key"))
    prefixes = customer.select("extension").distinct().join(F.broadcast(table(spark, d, "region").select(F.concat(F.lit("Customer#0000000"), "r_regionkey").alias("prefix"))))
    return usage.kv_keys(customer, prefixes, limit=10)


# Spelling

VOCAB = f"WITH {DOC_TOKENS}, vocab AS (SELECT key AS word, row_number() OVER (ORDER BY df DESC, key) AS rank FROM term_stats)"


def vocabulary_ranks(spark, d):
    counts = document_index(spark, d, stem=False).term_stats.withColumnRenamed("key", "word")
    return stored(spark, "vocabulary", d, lambda: written(rank_vocabulary(counts, None).select("word", "rank")))


def typed_prefixes(spark, d, n: int = 4):
    """The beginnings of benchmark items' longest words."""
    words = tokens(table(spark, d, "benchmark"), "item_id").where(F.length("norm") >= 8)
    return words.select(F.left("norm", F.lit(n)).alias("prefix")).distinct()


@query("completions", f"""{VOCAB}, p AS (SELECT DISTINCT left(w, 4) AS prefix FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark) WHERE length(w) >= 8)
SELECT prefix, word, rank, place FROM (SELECT prefix, word, rank, row_number() OVER (PARTITION BY prefix ORDER BY rank)::INTEGER AS place FROM p JOIN vocab ON starts_with(word, prefix)) WHERE place <= 8""")
def completions(spark, d):
    return spelling.completions(typed_prefixes(spark, d), vocabulary_ranks(spark, d))


def misspelt(spark, d):
    """Long words of benchmark items with their second and third letters swapped."""
    words = tokens(table(spark, d, "benchmark"), "item_id").where(F.length("norm") >= 7).select("norm").distinct()
    return words.select(F.concat(F.left("norm", F.lit(1)), F.substring("norm", 3, 1), F.substring("norm", 2, 1), F.substring("norm", 4, 100)).alias("word")).distinct()


MISSPELT = f"""{VOCAB}, typed AS (SELECT DISTINCT substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) AS word
  FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark) WHERE length(w) >= 7)"""
# The words that are typed have seven letters or more, so two edits are allowed. DuckDB's distance lets a swapped pair be
# edited again; here two edits are two of Levenshtein's, or a swap and one edit outside it.
# DuckDB compares bytes, so letters of more than one byte go by a mark of one.
CORRECTED = """ours AS (SELECT word, translate(word, 'ßøæœđłþð', '!#$%&()*') AS bytes FROM typed), theirs AS (SELECT word, rank, translate(word, 'ßøæœđłþð', '!#$%&()*') AS bytes FROM vocab),
near AS (SELECT t.word, v.word AS correction, damerau_levenshtein(t.bytes, v.bytes)::INTEGER AS distance, rank FROM ours t JOIN theirs v ON abs(length(t.word) - length(v.word)) <= 2 AND damerau_levenshtein(t.bytes, v.bytes) <= 2
  WHERE levenshtein(t.bytes, v.bytes) <= 2 OR len(list_filter(range(1, length(t.bytes)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND substr(t.bytes, i, 1) = substr(v.bytes, j + 1, 1) AND substr(t.bytes, i + 1, 1) = substr(v.bytes, j, 1)
    AND damerau_levenshtein(left(t.bytes, i - 1), left(v.bytes, j - 1)) + damerau_levenshtein(substr(t.bytes, i + 2), substr(v.bytes, j + 2)) <= 1)) > 0)) > 0),
corrected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, rank, correction)::INTEGER AS place FROM near) WHERE place <= 8)"""


@query("corrections", f"{MISSPELT}, {CORRECTED} SELECT word, correction, distance, rank, place FROM corrected")
def corrections(spark, d):
    return spelling.corrections(misspelt(spark, d), vocabulary_ranks(spark, d))


@query("suggest", f"""{MISSPELT}, {CORRECTED},
done AS (SELECT * FROM (SELECT t.word, v.word AS suggestion, row_number() OVER (PARTITION BY t.word ORDER BY rank)::INTEGER AS nth FROM typed t JOIN vocab v ON starts_with(v.word, t.word)) WHERE nth <= 8),
every AS (SELECT word, word AS suggestion, 0 AS stage, 1 AS nth FROM typed UNION ALL SELECT word, suggestion, 1, nth FROM done
  UNION ALL SELECT word, correction, 2, place FROM corrected WHERE word NOT IN (SELECT word FROM done GROUP BY word HAVING count(*) >= 3)),
once AS (SELECT word, suggestion, min((stage, nth)) AS s FROM every GROUP BY ALL)
SELECT word, suggestion, s[1] AS stage, place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s, suggestion)::INTEGER AS place FROM once) WHERE place <= 9""")
def suggest(spark, d):
    return spelling.suggest(misspelt(spark, d), vocabulary_ranks(spark, d))


@query("fill_words", f"""{VOCAB}, w AS (SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark)
SELECT word, word AS suggestion FROM w WHERE regexp_full_match(word, '\\p{{L}}{{3,}}') AND word IN (SELECT word FROM vocab)""")
def fill_words(spark, d):
    words = tokens(table(spark, d, "benchmark"), "item_id").select(F.col("norm").alias("word"))
    return spelling.fill_words(words, vocabulary_ranks(spark, d), typos=False)


@query("fill_corrections", f"""{MISSPELT}, {CORRECTED} SELECT word, correction AS suggestion FROM corrected WHERE regexp_full_match(word, '\\p{{L}}{{3,}}')""")
def fill_corrections(spark, d):
    return spelling.fill_words(misspelt(spark, d), vocabulary_ranks(spark, d))


# Classification

SNIPPETS = """snip AS (SELECT page_id AS id, url AS content FROM pages UNION ALL SELECT 1000000 + event_id, props FROM events
  UNION ALL SELECT 10000000 + conv_id * 100 + turn, text FROM conversations UNION ALL SELECT 100000000 + p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#ff88' || lpad((p_partkey % 100)::VARCHAR, 2, '0') WHEN 1 THEN 'rgb(12, 34, ' || p_size || ')' WHEN 2 THEN '#ggg' WHEN 3 THEN '  ' ELSE p_name END FROM part)"""


def history(spark, d):
    """URLs, JSON of events, texts of turns, and colors made from parts, as clipboard history."""
    p = F.col("p_partkey")
    color = (
        F.when(p % 5 == 0, F.concat(F.lit("#ff88"), F.lpad((p % 100).cast("string"), 2, "0"))).when(p % 5 == 1, F.concat(F.lit("rgb(12, 34, "), "p_size", F.lit(")")))
        .when(p % 5 == 2, "#ggg").when(p % 5 == 3, "  ").otherwise(F.col("p_name")))
    return ranking.gather(
        table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("content")), table(spark, d, "events").select((F.col("event_id") + 1_000_000).alias("id"), F.col("props").alias("content")),
        table(spark, d, "conversations").select((F.lit(10_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content")), table(spark, d, "part").select((p + 100_000_000).alias("id"), color.alias("content")))


TYPED = SNIPPETS + r""", typed AS (SELECT id, content, CASE WHEN regexp_full_match(trim(content), '#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})|(?i:rgba?)\([0-9,. %]+\)') THEN 'color'
  WHEN regexp_full_match(trim(content), 'https?://\S+') AND length(trim(content)) > 8 THEN 'url' WHEN regexp_matches(trim(content), '^(\{\s*"|\[\{|\[\[)') THEN 'json' ELSE 'text' END AS content_type FROM snip)"""


@query("classify_snippets", f"WITH {TYPED} SELECT id, content_type, CASE WHEN trim(string_split(trim(content), chr(10))[1]) = '' THEN '(blank)' ELSE trim(string_split(trim(content), chr(10))[1]) END AS preview FROM typed")
def classify_snippets(spark, d):
    return classify.classify_history(history(spark, d)).select("id", "content_type", "preview")


@query("facet_counts", f"WITH {TYPED} SELECT count(*) AS \"all\", count(*) FILTER (content_type = 'text') AS text, count(*) FILTER (content_type = 'image') AS image, count(*) FILTER (content_type = 'url') AS url, count(*) FILTER (content_type = 'color') AS color FROM typed")
def facet_counts(spark, d):
    return classify.facet_counts(classify.classify_history(history(spark, d)))


@query("filter_history", f"WITH {TYPED}, q AS (SELECT r_regionkey AS query_id, ['example', 'THE ', 'ring', '12', 'zz'][r_regionkey + 1] AS t FROM region) SELECT query_id, id FROM typed JOIN q ON contains(lower(CASE WHEN trim(string_split(trim(content), chr(10))[1]) = '' THEN '(blank)' ELSE trim(string_split(trim(content), chr(10))[1]) END), lower(trim(t)))")
def filter_history(spark, d):
    text = F.get(F.array(*map(F.lit, ["example", "THE ", "ring", "12", "zz"])), F.col("r_regionkey").cast("int"))
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), text.alias("query_text"))
    return search.filter_history(classify.classify_history(history(spark, d)), queries)


@query("text_stats", r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents")
def text_stats(spark, d):
    return classify.text_statistics(documents(spark, d)).select("doc_id", "chars", "words", "lines")


@query("entity_types", f"""WITH {SNIPPETS}, e AS (SELECT CASE WHEN length(trim(content)) = 0 OR length(trim(content)) > 256 THEN 'none' WHEN regexp_matches(trim(content), '(?i)^(https?://|www\\.)\\S+$') THEN 'url'
  WHEN regexp_matches(trim(content), '^[0-9\\s+\\-*/^%().,]+$') AND regexp_matches(trim(content), '[0-9]') AND regexp_matches(trim(content), '[+\\-*/^%]') THEN 'math' WHEN regexp_matches(trim(content), '^\\p{{L}}[\\p{{L}}''\\-]*$') AND length(trim(content)) BETWEEN 2 AND 40 THEN 'word' ELSE 'none' END AS entity FROM snip)
SELECT entity, count(*) AS n FROM e GROUP BY entity""")
def entity_types(spark, d):
    return classify.detect_entities(history(spark, d), "content").groupBy("entity").agg(F.count("*").alias("n"))


@query("route_queries", r"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN floor(o_totalprice)::BIGINT::VARCHAR || ' usd to eur' WHEN 1 THEN 'km to m' WHEN 2 THEN 'today' WHEN 3 THEN o_orderpriority WHEN 4 THEN 'days until christmas' ELSE lower(o_orderstatus) || ' report' END AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(lower(t), '^(now|today|tomorrow|time in )|until') THEN 'date' WHEN regexp_matches(t, '(?i)^\s*[A-Za-z0-9/^*]{1,16}\s+(to|in)\s+[A-Za-z0-9/^*]{1,16}\s*$') THEN 'conversion'
  WHEN regexp_matches(t, '[0-9+\-*/^%().!]') THEN 'calculator' ELSE 'plain' END AS route, CASE WHEN t = 'km to m' THEN '1 km to m' ELSE t END AS eval_query FROM q""")
def route_queries(spark, d):
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.floor("o_totalprice").cast("string"), F.lit(" usd to eur"))).when(k == 1, "km to m").when(k == 2, "today").when(k == 3, F.col("o_orderpriority"))
        .when(k == 4, "days until christmas").otherwise(F.concat(F.lower("o_orderstatus"), F.lit(" report"))))
    return classify.route_queries(table(spark, d, "orders").select("o_orderkey", text.alias("query_text"))).select("o_orderkey", "route", "eval_query")


@query("log_tail", "SELECT source, seq, message FROM (SELECT event_type AS source, event_id AS seq, props AS message, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200")
def log_tail(spark, d):
    return classify.log_tail(table(spark, d, "events").select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("message"))).select("source", "seq", "message")


@query("seen_actions", """WITH a AS (SELECT event_type AS source, 'act' || user_id AS action_id, min(ts) AS first_seen, arg_max(props, ts) AS label FROM events GROUP BY ALL)
SELECT source, action_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seen, action_id)::INTEGER AS place FROM a) WHERE place <= 64""")
def seen_actions(spark, d):
    actions = table(spark, d, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("act"), "user_id").alias("action_id"), F.col("props").alias("label"), F.lit("").alias("hint"), F.lit("").alias("shortcut"), "ts")
    return classify.seen_actions(actions).select("source", "action_id", "label", "place")


# Conversion

RATE_VALUES = [("USD", 1.0), ("EUR", 0.5), ("HUF", 350.0), ("JPY", 150.25), ("GBP", 0.8)]
RATES = "rates AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {r}::DOUBLE)" for c, r in RATE_VALUES) + ") t(currency, rate))"


@query("fx_totals", f"""WITH {RATES}, o AS (SELECT o_custkey, o_totalprice, ['usd', 'eur', 'huf', 'jpy', 'gbp', 'xxx'][(o_orderkey % 6 + 1)::INT] AS f, ['EUR', 'USD', 'GBP', 'HUF'][(o_orderkey % 4 + 1)::INT] AS t FROM orders)
SELECT t AS "to", count(b.rate / a.rate) AS n, round(sum(o_totalprice * b.rate / a.rate), 2) AS total FROM o LEFT JOIN rates a ON upper(f) = a.currency LEFT JOIN rates b ON t = b.currency GROUP BY t""")
def fx_totals(spark, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n).cast("int"))
    amounts = table(spark, d, "orders").select(F.col("o_totalprice").alias("amount"), pick(["usd", "eur", "huf", "jpy", "gbp", "xxx"], 6).alias("from"), pick(["EUR", "USD", "GBP", "HUF"], 4).alias("to"))
    rates = spark.createDataFrame([(c, r, 0) for c, r in RATE_VALUES], "currency string, rate double, fetched_at long")
    return convert.convert_currency(amounts, rates).groupBy("to").agg(F.count("converted").alias("n"), F.round(F.sum("converted"), 2).alias("total"))


@query("date_shift", """SELECT o_orderkey, CASE (o_orderkey % 4) WHEN 0 THEN o_orderdate + to_days((o_orderkey % 40)::INT) WHEN 1 THEN o_orderdate + to_months((o_orderkey % 40)::INT) WHEN 2 THEN o_orderdate + to_hours((o_orderkey % 40)) ELSE o_orderdate - to_days((o_orderkey % 40 * 7)::INT) END AS shifted FROM orders""")
def date_shift(spark, d):
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.when(k == 3, -(F.col("o_orderkey") % 40)).otherwise(F.col("o_orderkey") % 40).alias("n"), F.get(F.array(*map(F.lit, ["days", "months", "hours", "weeks"])), k.cast("int")).alias("unit"))
    return convert.shift_dates(rows).select("o_orderkey", F.col("shifted").cast("timestamp_ntz").alias("shifted"))


@query("days_until", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS today, o_orderkey % 12 + 1 AS m, o_orderkey % 31 + 1 AS dd FROM orders),
c AS (SELECT *, try_cast(year(today) || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE) AS this, try_cast((year(today) + 1) || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE) AS following FROM o)
SELECT o_orderkey, CASE WHEN this >= today THEN this - today ELSE following - today END::INTEGER AS days FROM c""")
def days_until(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("today"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("month"), (F.col("o_orderkey") % 31 + 1).cast("int").alias("day"))
    return convert.days_until(rows).select("o_orderkey", "days")


@query("tz_convert", """WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS wall, ['America/New_York', 'Asia/Tokyo', 'UTC', 'Asia/Kolkata'][(o_orderkey % 4 + 1)::INT] AS a, ['Europe/Paris', 'Australia/Sydney', 'America/Los_Angeles'][(o_orderkey % 3 + 1)::INT] AS b FROM orders)
SELECT o_orderkey, CASE WHEN timezone(a, timezone(a, wall)) = wall THEN timezone(b, timezone(a, wall)) END AS converted FROM o""")
def tz_convert(spark, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n).cast("int"))
    wall = (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).cast("timestamp_ntz")
    rows = table(spark, d, "orders").select("o_orderkey", wall.alias("wall"), pick(["est", "tokyo", "utc", "mumbai"], 4).alias("src"), pick(["paris", "Australia/Sydney", "LA"], 3).alias("dst"))
    return convert.convert_zones(rows, convert.zone_table(spark)).select("o_orderkey", "converted")


@query("date_phrases", """WITH o AS (SELECT o_orderkey, o_orderkey % 29 + 1 AS k, o_orderkey % 12 + 1 AS m, o_orderdate + to_hours(o_orderkey % 24) AS t FROM orders),
c AS (SELECT *, make_date(year(t), m, 1 + k % 28) AS this, make_date(year(t) + 1, m, 1 + k % 28) AS following FROM o),
u AS (SELECT *, CASE WHEN this >= t::DATE THEN this - t::DATE ELSE following - t::DATE END AS days, date_trunc('day', timezone('America/New_York', timezone('UTC', t))) + to_hours(k % 11 + 13) AS wall FROM c)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'shift' WHEN 1 THEN 'shift' WHEN 2 THEN 'shift' WHEN 3 THEN 'until' WHEN 4 THEN 'until' WHEN 5 THEN 'zone' WHEN 6 THEN 'zone' END AS kind,
  CASE o_orderkey % 7 WHEN 0 THEN strftime(t + to_weeks(k::INT), '%a, %b %-d %Y') WHEN 1 THEN strftime(t + to_days(1) - to_months(k::INT), '%a, %b %-d %Y') WHEN 2 THEN strftime(t + to_minutes(k), '%a, %b %-d %Y %H:%M')
    WHEN 5 THEN strftime(timezone('Asia/Tokyo', timezone('UTC', t)), '%H:%M') WHEN 6 THEN strftime(timezone('Asia/Kolkata', timezone('America/New_York', wall)), '%H:%M')
    ELSE CASE days WHEN 0 THEN 'today' WHEN 1 THEN '1 day' ELSE days || ' days' END END AS title FROM u""")
def date_phrases(spark, d):
    """Phrases made of the numbers of orders, asked when they were placed."""
    k, month, n = F.col("o_orderkey") % 29 + 1, F.col("o_orderkey") % 12 + 1, (F.col("o_orderkey") % 7).cast("int")
    day = (k % 28 + 1).cast("string")
    said = F.array(
        F.format_string("now + %d weeks", k), F.format_string("Tomorrow -%d months", k), F.format_string("now+ %d min", k), F.format_string("days until %d/%s", month, day),
        F.concat(F.lit("days until "), F.get(F.array(*map(F.lit, convert.MONTHS)), (month - 1).cast("int")), F.lit(" "), day), F.lit("time in tokyo"), F.format_string("%dpm est in mumbai", k % 11 + 1))
    placed = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", placed.alias("now"), F.get(said, n).alias("phrase"))
    return convert.date_phrases(rows, convert.zone_table(spark)).select("o_orderkey", "kind", "title")


# Catalogs

PACKAGES = """cat AS (SELECT p_name || ' ' || p_partkey AS name, p_size % 4 || '.' || p_partkey % 12 || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '.' || p_size END AS version, (p_size % 3)::INTEGER AS api, p_partkey FROM part),
inst AS (SELECT name, p_partkey, '1.' || p_partkey % 10 || '.7' AS installed_version, CASE WHEN p_partkey % 2 = 0 THEN 'catalog' ELSE 'file' END AS origin FROM cat WHERE p_partkey % 3 <> 0),
num AS (SELECT cat.*, installed_version, origin, list_transform(string_split(version, '.'), lambda x: x::BIGINT) || CASE WHEN len(string_split(version, '.')) = 2 THEN [0::BIGINT] ELSE []::BIGINT[] END AS v,
  list_transform(string_split(installed_version, '.'), lambda x: x::BIGINT) AS w FROM cat LEFT JOIN inst USING (name))"""


def packages(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    version = F.concat((s % 4).cast("string"), F.lit("."), (p % 12).cast("string"), F.when(p % 9 == 0, "").otherwise(F.concat(F.lit("."), s.cast("string"))))
    catalog = table(spark, d, "part").select(F.concat_ws(" ", "p_name", p.cast("string")).alias("name"), version.alias("version"), (s % 3).alias("api"), "p_partkey", F.array("p_brand").alias("keywords"), F.col("p_type").alias("description"))
    installed = catalog.where("p_partkey % 3 <> 0").select("name", F.concat(F.lit("1."), (p % 10).cast("string"), F.lit(".7")).alias("version"), F.when(p % 2 == 0, "catalog").otherwise("file").alias("origin"))
    return catalog, installed


@query("version_updates", f"WITH {PACKAGES} SELECT name, installed_version, version FROM num WHERE api = 1 AND origin = 'catalog' AND v > w")
def version_updates(spark, d):
    catalog, installed = packages(spark, d)
    return cat.available_updates(catalog, installed, api=1)


@query("catalog_state", f"WITH {PACKAGES} SELECT name, CASE WHEN api <> 1 THEN 'incompatible' WHEN w IS NULL THEN 'not_installed' WHEN v > w THEN 'update' ELSE 'installed' END AS state FROM num")
def catalog_state(spark, d):
    return cat.catalog_state(*packages(spark, d), api=1).select("name", "state")


@query("search_catalog", f"""WITH {PACKAGES}, q AS (SELECT r_regionkey AS query_id, ['ring 1', 'brand#1', '', 'economy', 'none'][r_regionkey + 1] AS t FROM region),
s AS (SELECT n.name, lower(n.name || chr(10) || p_brand || chr(10) || p_type) AS text, CASE WHEN api = 1 AND v > w THEN 0 ELSE 1 END AS o FROM num n JOIN part USING (p_partkey))
SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY o, name)::INTEGER AS place FROM s JOIN q ON contains(text, t)""")
def search_catalog(spark, d):
    text = F.get(F.array(*map(F.lit, ["ring 1", "brand#1", "", "economy", "none"])), F.col("r_regionkey").cast("int"))
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), text.alias("query_text"))
    return cat.search_catalog(cat.catalog_state(*packages(spark, d), api=1), queries)


@query("permission_growth", """SELECT p_partkey AS name, p_size % 4 = 0 AND p_size % 8 <> 0 OR p_size > 40 OR p_partkey % 6 = 0 AS grows, p_partkey % 6 = 0 AS relaxes_sandbox FROM part""")
def permission_growth(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    no = F.lit(False)
    struct = lambda kv, network, spawn: F.struct(kv.alias("kv"), no.alias("clipboard"), no.alias("open_url"), no.alias("paste"), no.alias("bus"), network.alias("network"), spawn.alias("spawn"))
    hosts = F.when(s > 40, F.array(F.lit("a.org"), F.lit("b.org"))).otherwise(F.array(F.lit("a.org")))
    programs = F.when(p % 6 == 0, F.array(F.lit("git"))).otherwise(F.array().cast("array<string>"))
    pairs = table(spark, d, "part").select(p.alias("name"), struct(s % 8 == 0, F.array(F.lit("a.org")), F.array().cast("array<string>")).alias("old"), struct(s % 4 == 0, hosts, programs).alias("new"))
    return cat.permission_growth(pairs).select("name", "grows", "relaxes_sandbox")


@query("verify_packages", """SELECT url AS name, CASE WHEN page_id % 4 = 0 THEN 'unknown' WHEN page_id % 4 = 1 THEN 'checksum' WHEN page_id % 4 = 2 AND page_id % 3 = 0 THEN 'version' END AS reason FROM pages""")
def verify_packages(spark, d):
    """Pages as packages: each has an entry of its own, as many pages may have one URL."""
    pages = table(spark, d, "pages")
    k, name = F.col("page_id") % 4, F.struct("page_id", "url").alias("name")
    catalog = pages.where(k != 0).select(name, F.lit("1.0").alias("version"), F.when(k == 1, F.sha2(F.coalesce("url", F.lit("")), 256)).when(k == 2, F.upper(F.sha2("html", 256))).otherwise(" ").alias("sha256"))
    files = pages.select(name, F.when((k == 2) & (F.col("page_id") % 3 == 0), "2.0").otherwise("1.0").alias("version"), F.col("html").cast("binary").alias("content"))
    return cat.verify_packages(files, catalog).select("name.url", "reason").withColumnRenamed("url", "name")


# Files, maintenance, layout


@query("refresh_plan", f"""WITH {PAGE_CATALOG}, old AS (SELECT path, mtime - mtime % 3 AS m, size AS s FROM catalog WHERE mtime % 4 <> 0)
SELECT c.path, CASE WHEN o.path IS NULL THEN 'new' WHEN mtime = m AND size = s THEN 'same' ELSE 'changed' END AS status FROM catalog c LEFT JOIN old o USING (path)""")
def refresh_plan(spark, d):
    pages = page_catalog(spark, d)
    old = pages.where("mtime % 4 <> 0").select("path", (F.col("mtime") - F.col("mtime") % 3).alias("mtime"), "size")
    return refresh.plan_refresh(pages, old).select("path", "status")


@query("apply_refresh", f"WITH {PAGE_CATALOG}, up AS (SELECT path, size * 2 AS size FROM catalog WHERE mtime % 3 = 0) SELECT path, size FROM up UNION ALL SELECT path, size FROM catalog WHERE path NOT IN (SELECT path FROM up)")
def apply_refresh(spark, d):
    pages = page_catalog(spark, d)
    return refresh.apply_refresh(pages.select("path", "size"), pages.where("mtime % 3 = 0").select("path", (F.col("size") * 2).alias("size")))


@query("remove_stale", f"WITH {PAGE_CATALOG}, live AS (SELECT path FROM catalog WHERE mtime % 3 <> 0) SELECT count(DISTINCT path) AS removed FROM catalog WHERE path NOT IN (SELECT path FROM live)")
def remove_stale(spark, d):
    pages = page_catalog(spark, d)
    return refresh.remove_stale(pages, pages.where("mtime % 3 <> 0"))[1]


@query("remove_subtree", f"WITH {PAGE_CATALOG}, dirs AS (SELECT DISTINCT parent AS dir FROM catalog WHERE mtime % 4 = 1) SELECT path FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM dirs WHERE c.path = dir OR starts_with(c.path, dir || '/'))")
def remove_subtree(spark, d):
    pages = page_catalog(spark, d)
    return refresh.remove_subtree(pages, pages.where("mtime % 4 = 1").select(F.col("parent").alias("path"))).select("path")


@query("index_cost", f"""WITH {PAGE_CATALOG}, f AS (SELECT ['pdf', 'png', 'txt', 'bin'][(mtime % 4 + 1)::INT] AS kind, mtime % 3 AS root, size / 1048576.0::DOUBLE AS mb FROM catalog),
b AS (SELECT root, kind, count(*) AS n, sum(mb) AS mb FROM f GROUP BY ALL)
SELECT root::VARCHAR AS root, sum(n)::BIGINT AS n_files, coalesce(sum(n) FILTER (kind = 'pdf'), 0)::BIGINT AS n_pdf, coalesce(sum(n) FILTER (kind = 'png'), 0)::BIGINT AS n_image,
  ceil(round(sum(CASE kind WHEN 'pdf' THEN n * 0.04::DOUBLE + mb * 0.03::DOUBLE WHEN 'png' THEN n * 0.2::DOUBLE + mb * 0.3::DOUBLE WHEN 'txt' THEN n * 0.002::DOUBLE + mb * 0.01::DOUBLE ELSE n * 0.002::DOUBLE END) / 2, 9))::BIGINT AS min_seconds,
  ceil(round(sum(CASE kind WHEN 'pdf' THEN n * 0.2::DOUBLE + mb * 1.5::DOUBLE WHEN 'png' THEN n * 0.4::DOUBLE + mb * 0.8::DOUBLE WHEN 'txt' THEN n * 0.002::DOUBLE + mb * 0.01::DOUBLE ELSE n * 0.002::DOUBLE END) / 2, 9))::BIGINT AS max_seconds FROM b GROUP BY root""")
def index_cost(spark, d):
    ext = F.get(F.array(*map(F.lit, ["pdf", "png", "txt", "bin"])), (F.col("mtime") % 4).cast("int"))
    files = page_catalog(spark, d).select((F.col("mtime") % 3).cast("string").alias("root"), F.concat_ws(".", "path", ext).alias("path"), "size")
    return refresh.estimate_index_cost(files, threads=2)


@query("eligible_documents", f"""WITH {PAGE_CATALOG}, f AS (SELECT path || ['.md', '.bin', '.TXT'][(mtime % 3 + 1)::INT] AS path, size, is_dir FROM catalog)
SELECT DISTINCT path FROM f WHERE NOT is_dir AND size <= 9000 AND ((regexp_matches(path, '^/[^/]*\\.com/') OR regexp_matches(path, '^/blog')) AND len(string_split(path, '/')) - len(string_split(regexp_extract(path, '^/[^/]*'), '/')) <= 3 AND (path LIKE '%.md' OR path LIKE '%.TXT'))""")
def eligible_documents(spark, d):
    ext = F.get(F.array(*map(F.lit, [".md", ".bin", ".TXT"])), (F.col("mtime") % 3).cast("int"))
    files = page_catalog(spark, d).withColumn("path", F.concat("path", ext))
    hosts = files.select(F.regexp_extract("path", "^/[^/]*", 0).alias("root")).distinct().where(F.col("root").rlike(r"\.com$|^/blog"))
    roots = hosts.select("root", F.lit(3).alias("depth"), F.lit(None).cast("array<string>").alias("extensions"))
    return filesrc.eligible_documents(files, roots, ["md", "txt"], max_bytes=9000).select("path")


@query("prune_ignored", f"WITH {PAGE_CATALOG} SELECT path, mtime FROM catalog WHERE NOT list_has_any(string_split(path, '/'), ['de', 'fr', 'blog'])")
def prune_ignored(spark, d):
    return filesrc.prune_ignored(page_catalog(spark, d), ["de", "fr", "blog"]).select("path", "mtime")


@query("annotate_files", f"""WITH {PAGE_CATALOG}, f AS (SELECT mtime, CASE mtime % 5 WHEN 1 THEN '.hid' WHEN 2 THEN 'a.PDF' WHEN 3 THEN 'Makefile' WHEN 4 THEN 'x.rs' ELSE 'noext' END AS name, is_dir FROM catalog)
SELECT mtime, name = '.hid' AS hidden, CASE name WHEN 'a.PDF' THEN 'docs' WHEN 'Makefile' THEN 'code' WHEN 'x.rs' THEN 'code' ELSE 'other' END AS category,
  CASE WHEN is_dir THEN 'Folder' WHEN name = 'a.PDF' THEN 'PDF Document' WHEN name = 'x.rs' THEN 'Rust Source' ELSE 'File' END AS kind, name IN ('a.PDF', 'Makefile', 'x.rs') AS previewable FROM f""")
def annotate_files(spark, d):
    name = F.get(F.array(*map(F.lit, ["noext", ".hid", "a.PDF", "Makefile", "x.rs"])), (F.col("mtime") % 5).cast("int"))
    files = page_catalog(spark, d).select("mtime", name.alias("name"), F.concat(F.lit("/d/"), name).alias("path"), "is_dir")
    return filesrc.annotate_files(files).select("mtime", "hidden", "category", "kind", "previewable")


@query("folder_summary", f"""WITH {PAGE_CATALOG}, c AS (SELECT parent, count(*) FILTER (is_dir) AS f, count(*) FILTER (NOT is_dir) AS n FROM catalog GROUP BY parent)
SELECT parent, concat_ws(', ', CASE WHEN f > 0 THEN f || ' folder' || CASE WHEN f = 1 THEN '' ELSE 's' END END, CASE WHEN n > 0 THEN n || ' file' || CASE WHEN n = 1 THEN '' ELSE 's' END END) AS summary FROM c""")
def folder_summary(spark, d):
    return layout.folder_summary(page_catalog(spark, d)).select("parent", "summary")


@query("folder_listing", f"WITH {PAGE_CATALOG}, l AS (SELECT parent, name, is_dir, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name)::INTEGER AS place FROM catalog) SELECT * FROM l WHERE place <= 3")
def folder_listing(spark, d):
    return layout.folder_listing(page_catalog(spark, d), limit=3)


@query("natural_order", """SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 97, p_partkey) AS place FROM part""")
def natural_order(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("slide"), (F.col("p_partkey") % 97).cast("string"), F.lit(".xml")).alias("name"))
    return layout.natural_places(names, "name", "p_partkey").select("p_partkey", "place")


@query("paginate", "SELECT path, page, text FROM (SELECT conv_id || '.pdf' AS path, unnest(string_split(t, chr(12))) AS text, (generate_subscripts(string_split(t, chr(12)), 1) - 1)::INTEGER AS page FROM (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)) WHERE trim(text) <> ''")
def paginated(spark, d):
    talk = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\f").alias("text"))
    return paginate(talk.select(F.concat("conv_id", F.lit(".pdf")).alias("path"), "text"))


@query("ocr_reading_text", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS k FROM documents),
l AS (SELECT doc_id, k // 9 AS line, string_agg(word, ' ' ORDER BY k) AS t FROM w WHERE k % 5 <> 3 GROUP BY ALL)
SELECT doc_id::VARCHAR AS path, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY doc_id""")
def ocr_reading_text(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("seq", "text"))
    one = F.lit(1)
    rows = words.select(
        F.col("doc_id").cast("string").alias("path"), "seq", F.lit(5).alias("level"), one.alias("page"), one.alias("block"), one.alias("par"), F.floor(F.col("seq") / 9).alias("line"),
        (F.col("seq") % 9 * 10).alias("left"), (F.floor(F.col("seq") / 9) * 10).alias("top"), F.lit(8).alias("width"), F.lit(9).alias("height"), F.when(F.col("seq") % 5 == 3, 10.0).otherwise(90.0).alias("conf"), "text",
        F.lit(100).alias("page_width"), F.lit(1000).alias("page_height"))
    return layout.ocr_reading_text(rows)[0]


GLYPHS = r"""seqs AS (SELECT conv_id AS doc_id, turn::INTEGER AS page, text, unnest(range(length(text))) AS seq FROM conversations),
glyphs AS (SELECT doc_id, page, seq, substr(text, seq::INTEGER + 1, 1) AS ch, seq // 40 AS y, seq % 40 * 10.0 AS x FROM seqs),
marked AS (SELECT *, regexp_matches(ch, '[\s\x0b\x1c-\x1f\x85\p{Z}]') AS blank, count(*) FILTER (ch IN (chr(10), chr(13))) OVER (PARTITION BY doc_id, page ORDER BY seq) AS breaks FROM glyphs),
lined AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y, breaks) - 1 AS line, lag(seq) OVER (PARTITION BY doc_id, page, y, breaks ORDER BY seq) IS DISTINCT FROM seq - 1 AS new FROM marked WHERE NOT blank),
worded AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY seq) - 1 AS word FROM lined),
layout AS (SELECT doc_id, page, line::INTEGER AS line, word::INTEGER AS word, string_agg(ch, '' ORDER BY seq) AS text, min(x)::DOUBLE AS "left", (max(x) + 9.5)::DOUBLE AS "right", min(y * 12.0)::DOUBLE AS top, max(y * 12.0 + 10)::DOUBLE AS bottom FROM worded GROUP BY ALL)"""


@query("page_layout", f'WITH {GLYPHS} SELECT doc_id, page, line, word, text, "left", "right", top, bottom, false AS truncated FROM layout')
def page_layout(spark, d):
    """Turns as pages of glyphs, forty characters to a line."""
    turn = table(spark, d, "conversations").where(F.length("text") > 0).groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page")).agg(F.collect_list("text").alias("texts"))

    def glyph(ch, seq):
        x, y = seq % 40 * 10.0, F.floor(seq / 40) * 12.0
        return F.struct(seq.cast("long").alias("seq"), ch.alias("ch"), x.alias("left"), (x + 9.5).alias("right"), y.alias("top"), (y + 10.0).alias("bottom"))

    # as page_layout() says, a page's glyphs beyond its cap are looked at no further than that there is one
    each = F.transform("texts", lambda text: F.transform(F.slice(F.split(text, ""), 1, layout.MAX_GLYPHS + 1), glyph))
    return layout.page_layout(turn.select("doc_id", "page", F.flatten(each).alias("glyphs")))


@query("span_boxes", f"""WITH {GLYPHS}, q AS (SELECT r_regionkey AS query_id, unnest(string_split(['the house', 'what is', 'a list of', 'please help', 'can you'][r_regionkey + 1], ' ')) AS term FROM region),
hit AS (SELECT DISTINCT query_id, doc_id, page, word, "left", "right", top, bottom FROM layout JOIN q ON list_contains(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), term) WHERE length(term) >= 2 AND term NOT IN ('the', 'is', 'of')),
cut AS (SELECT *, coalesce(word - lag(word) OVER w > 1 OR abs(top - lag(top) OVER w) > 2, true)::INTEGER AS new FROM hit WINDOW w AS (PARTITION BY query_id, doc_id, page ORDER BY word)),
spans AS (SELECT *, sum(new) OVER (PARTITION BY query_id, doc_id, page ORDER BY word) AS span FROM cut)
SELECT query_id, doc_id, page, span::BIGINT AS span, min("left") AS "left", max("right") AS "right", min(top) AS top, max(bottom) AS bottom FROM spans WHERE span <= 400 GROUP BY ALL""")
def span_boxes(spark, d):
    text = F.get(F.array(*map(F.lit, ["the house", "what is", "a list of", "please help", "can you"])), F.col("r_regionkey").cast("int"))
    queries = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), text.alias("query_text"))
    return layout.span_boxes(page_layout(spark, d), query_terms(queries, stem=False), stem=False)


@query("dominant_hue", """WITH p AS (SELECT l_suppkey AS image, (floor(l_extendedprice)::BIGINT % 256) / 255.0::DOUBLE AS r, (l_partkey % 256) / 255.0::DOUBLE AS g, (l_orderkey % 256) / 255.0::DOUBLE AS b FROM lineitem),
x AS (SELECT image, r, g, b, greatest(r, g, b) AS high, greatest(r, g, b) - least(r, g, b) AS spread, (greatest(r, g, b) + least(r, g, b)) / 2 AS light FROM p),
h AS (SELECT image, light, spread / (1 - abs(2 * light - 1)) AS sat, 60 * CASE WHEN high = r THEN ((g - b) / spread + 6) % 6 WHEN high = g THEN (b - r) / spread + 2 ELSE (r - g) / spread + 4 END AS hue FROM x WHERE spread > 0),
sums AS (SELECT image, floor(hue / 30) AS bucket, sum(sat) AS weight, sum(hue * sat) AS hue, sum(light * sat) AS light, sum(sat * sat) AS sat2 FROM h WHERE light BETWEEN 0.08 AND 0.95 AND sat >= 0.15 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY weight DESC, bucket) AS n FROM sums)
SELECT image, round(hue / weight, 6) AS hue, round(sat2 / weight, 6) AS saturation, round(greatest(0.35::DOUBLE, least(0.65::DOUBLE, light / weight)), 6) AS lightness FROM best WHERE n = 1""")
def dominant_hue(spark, d):
    """Line items as pixels of an image for each supplier."""
    channel = lambda c, m: (F.floor(F.col(c)) % m).cast("int")
    pixels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), channel("l_extendedprice", 256).alias("r"), channel("l_partkey", 256).alias("g"), channel("l_orderkey", 256).alias("b"), F.lit(255).alias("a"))
    return layout.dominant_hue(pixels).select("image", *[F.round(c, 6).alias(c) for c in ("hue", "saturation", "lightness")])


# State


@query("merge_results", """WITH b AS (SELECT user_id % 10 AS query_id, event_type AS source, event_id AS seq, event_type = 'view' AS volatile, 'r' || (value * 100)::BIGINT % 50 AS id, value AS score FROM events),
last AS (SELECT query_id, source, max(seq) AS last FROM b WHERE volatile GROUP BY ALL),
alive AS (SELECT b.* FROM b LEFT JOIN last USING (query_id, source) WHERE last IS NULL OR seq = last),
newest AS (SELECT query_id, id, arg_max(source, seq) AS source, arg_max(score, seq) AS score FROM alive GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM newest""")
def merge_results(spark, d):
    ident = F.concat(F.lit("r"), (F.round(F.col("value") * 100).cast("long") % 50).cast("string"))
    batches = table(spark, d, "events").select((F.col("user_id") % 10).alias("query_id"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("volatile"), ident.alias("id"), F.col("value").alias("score"), F.lit("").alias("title"))
    return state.merge_results(batches).drop("title")


@query("drop_superseded", "SELECT event_id FROM (SELECT event_id, event_id // 100 AS q, max(event_id // 100) OVER (PARTITION BY user_id) AS newest FROM events) WHERE q = newest")
def drop_superseded(spark, d):
    batches = table(spark, d, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 100).alias("query_id"), "event_id")
    return state.drop_superseded(batches).select("event_id")


@query("stale_sources", """WITH l AS (SELECT user_id AS source, epoch(date_trunc('second', ts))::BIGINT AS t, event_type <> 'error' AS ok FROM events),
a AS (SELECT source, max(t) FILTER (ok) AS good, max(t) FILTER (NOT ok) AS bad FROM l GROUP BY source)
SELECT source, (good IS NULL OR 1706400000 - good > 86400) AND NOT (bad IS NOT NULL AND 1706400000 - bad < 300 AND (good IS NULL OR bad > good)) AS stale FROM a""")
def stale_sources(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("source"), F.unix_seconds(F.date_trunc("second", "ts")).alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return state.stale_sources(log, now=1_706_400_000, interval_s=86_400)


@query("file_changes", f"""WITH {PAGE_CATALOG}, touched AS (SELECT DISTINCT parent AS dir FROM catalog WHERE mtime % 6 = 1), cur AS (SELECT path, size + 1 AS size FROM catalog WHERE mtime % 2 = 0),
hit AS (SELECT path FROM catalog c WHERE EXISTS (SELECT 1 FROM touched WHERE c.path = dir OR starts_with(c.path, dir || '/')))
SELECT path, size FROM catalog WHERE path NOT IN (SELECT path FROM hit) UNION ALL SELECT path, size FROM cur WHERE path IN (SELECT path FROM hit)""")
def file_changes(spark, d):
    pages = page_catalog(spark, d)
    touched = pages.where("mtime % 6 = 1").select(F.col("parent").alias("path"), F.col("mtime").alias("seen_at"))
    return state.apply_file_changes(pages.select("path", "size"), touched, pages.where("mtime % 2 = 0").select("path", (F.col("size") + 1).alias("size")))


@query("root_search", f"""WITH RECURSIVE {FUZZY}, {PINS},
apps AS (SELECT query_id, 'part:' || id AS id, title, tier, 'app' AS category, 5e6 + CASE tier WHEN 'exact' THEN 7e6 WHEN 'prefix' THEN 25e5 WHEN 'word_start' THEN 4e5 ELSE 0 END + least(quality / 1500.0::DOUBLE, 1) * 300000 AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {TIER_ORDER}, 'part:' || id) AS n FROM gated) WHERE n <= 128),
people AS (SELECT query_id, 'ext:customers:' || c_custkey AS id, c_name AS title, 'fuzzy' AS tier, 'extension' AS category, 3e6 + relevance / 100 * 300000 AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, c_custkey::VARCHAR) AS n FROM (SELECT query_id, c_custkey, c_name, least(greatest(c_acctbal / 100, 0), 100) AS relevance FROM customer CROSS JOIN queries)) WHERE n <= 200),
shipped AS (SELECT 'part:' || l_partkey AS id, epoch(date_trunc('second', l_shipdate))::BIGINT AS t FROM lineitem), last AS (SELECT id, max(t) AS last FROM shipped GROUP BY id),
used AS (SELECT id, sum(power(2.0, -(last - t) / (86400.0 * 365))) AS usage FROM shipped JOIN last USING (id) GROUP BY id),
boosted AS (SELECT e.query_id, e.id, title, category, tier, score + least(coalesce(usage, 0) / 40, 1) * 750000 + CASE WHEN p.id IS NULL THEN 0 ELSE 2e7 END AS score
  FROM (SELECT * FROM apps UNION ALL SELECT * FROM people) e LEFT JOIN used u ON u.id = e.id LEFT JOIN pinned p ON p.query_id = e.query_id AND p.id = e.id),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN category = 'app' THEN title ELSE id END ORDER BY score DESC, id) AS n FROM boosted)
SELECT query_id, id, category, tier, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM first WHERE n = 1) WHERE rank <= 20""")
def root_search(spark, d):
    """All sources to ranked rows: fuzzy parts as apps, suppliers as dictionary rows, and a registered source of customers."""
    from sparkseek.plans.root_search import Source, Sources, search_all

    queries = part_queries(spark, d)
    titles = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_name").alias("exec"))
    apps = fuzzy.fuzzy_candidates(queries, titles).withColumn("source", F.lit("app"))
    apps = fuzzy.quality_gate(apps).withColumn("tier", fuzzy.match_tier(F.col("title"), F.col("norm_query"))).withColumn("category", F.lit("app"))
    sources = Sources()
    customers = table(spark, d, "customer")
    sources.register_source(Source("customers", lambda q: customers.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), (F.col("c_acctbal") / 100).alias("relevance")).join(F.broadcast(q.select("query_id")))))
    everything = ranking.gather(fuzzy.candidate_cut(apps).drop("source", "norm_query"), sources.candidates(queries))
    scores = usage.usage_scores(table(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("id"), F.lit("app").alias("kind"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts")), half_life_days=365.0)
    found = search_all(queries, everything, ranking.resolve_weights(spark), scores, pins_of(spark, d))
    return found.select("query_id", "id", "category", "tier", F.round("score", 3).alias("score"), "rank")
