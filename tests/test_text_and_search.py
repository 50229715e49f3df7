"""Words, stems, index and retrieval."""

import math

import pytest
from pyspark.sql import functions as F

from sparkseek.functions.text import porter_stem
from sparkseek.operators import search
from sparkseek.operators.index import build_index, query_terms, rank_vocabulary, tokens, vocabulary_counts, vocabulary_keys

STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_words_that_have_no_stem():
    assert [porter_stem(w) for w in ["is", "søker", "a1s", "Running", ""]] == ["is", "søker", "a1s", "Running", ""]


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def test_tokens_and_keys(spark):
    words = tokens(corpus(spark, "don't stop", "café naïve", "Café", None, "", "søk"))
    rows = [(r.doc_id, r.pos, r.norm) for r in words.orderBy("doc_id", "pos").collect()]
    assert rows == [(0, 0, "don"), (0, 1, "t"), (0, 2, "stop"), (1, 0, "cafe"), (1, 1, "naive"), (2, 0, "cafe"), (5, 0, "søk")]
    keys = {r.norm: r.key for r in vocabulary_keys(tokens(corpus(spark, "university universities study studies cat category sok søk"))).collect()}
    assert keys["university"] == keys["universities"] and keys["study"] == keys["studies"] and keys["cat"] != keys["category"] and keys["søk"] != keys["sok"]


def test_query_terms(spark):
    rows = query_terms(asked(spark, "Running, ran, RUNS running", "the report's of the", "the of", "a ?", "")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.ord)):
        by.setdefault(r.query_id, []).append((r.norm, r.key, r.is_last, r.ranked))
    assert [t[1] for t in by[0]] == ["run", "ran", "run"]
    assert by[1] == [("report", "report", True, True)]
    assert by[2] == [("the", "the", False, False), ("of", "of", True, False)]
    assert 3 not in by and 4 not in by


def found(spark, docs, *queries, **how):
    terms = query_terms(asked(spark, *queries))
    return sorted((r.query_id, r["rank"], r.doc_id) for r in search.search(terms, build_index(docs), **how).collect())


def test_search_needs_all_terms_and_takes_the_last_as_a_prefix(spark):
    docs = corpus(spark, "red apples", "red car red", "green apple pie", "applied science", "the of the of", "nothing")
    assert [x[2] for x in found(spark, docs, "red app")] == [0]
    assert {x[2] for x in found(spark, docs, "appl")} == {0, 2, 3}
    assert [x[2] for x in found(spark, docs, "pie apples")] == [2]
    assert found(spark, docs, "the of") == [(0, 1, 4)]
    assert found(spark, docs, "red zebra") == []


def test_bm25_by_hand(spark):
    docs = corpus(spark, "x x y", "x z", "y z z z")
    row = search.search(query_terms(asked(spark, "xx y"), stem=False), build_index(docs, stem=False)).collect()
    assert row == []
    hits = search.search(query_terms(asked(spark, "zz"), stem=False), build_index(corpus(spark, "zz a", "b b b b"), stem=False)).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    assert hits[0].score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 3)))


def test_search_joins_metadata_and_keeps_rank_at_any_partitioning(spark):
    docs = corpus(spark, *[f"common word{k % 7} tail" for k in range(60)])
    terms = query_terms(asked(spark, "common word3", "tail"))
    meta = spark.createDataFrame([(3, 10, 20)], "doc_id long, size long, mtime long")
    one = search.search(terms, build_index(docs.coalesce(1)), 20, meta).collect()
    many = search.search(terms, build_index(docs.repartition(13)), 20, meta).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert {(r.doc_id, r.size, r.mtime) for r in one if r.doc_id in (3, 10)} == {(3, 10, 20), (10, 0, 0)}


def test_passages_pages_spans_clusters_and_snippets(spark):
    lines = spark.createDataFrame([(1, k, "alpha" if k in (5, 40) else "beta" if k == 44 else "filler") for k in range(60)], "doc_id long, line int, text string")
    terms = query_terms(asked(spark, "alpha beta"))
    assert [(r.first_line, r.coverage) for r in search.best_passage(terms, lines).collect()] == [(35, 2)]
    shown = search.preview_lines(search.best_passage(terms, lines), lines, before=2, max_lines=5).orderBy("line").collect()
    assert [r.line for r in shown] == [38, 39, 40, 41, 42]
    pages = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta alpha"), (1, 2, "alpha beta")], "doc_id long, page int, text string")
    assert [(r.page, r.coverage) for r in search.best_page(terms, pages).collect()] == [(1, 2)]
    docs = corpus(spark, "alpha x x x x x x x x x beta alpha art cart " + "z " * 30)
    hits = search.search(terms, build_index(docs))
    words = tokens(docs)
    spans = search.match_spans(hits, terms, words)
    assert sorted(r.pos for r in spans.collect()) == [0, 10, 11]
    assert search.match_spans(hits, terms, words, max_marks=2).count() == 2
    assert search.best_cluster(spans, 2).first().pos == 0
    text = search.snippets(hits, terms, words, size=8).first().snippet
    assert "[beta] [alpha]" in text and text.startswith("…") and text.endswith("…")


def test_cells_boxes_and_history(spark):
    cells = spark.createDataFrame([("t", 0, 0, "Running shoes"), ("t", 2, 1, "run"), ("u", 0, 0, "walk")], "table_id string, row int, col int, text string")
    assert sorted((r.row, r.first) for r in search.matching_cells(query_terms(asked(spark, "runs")), cells).collect()) == [(0, True), (2, False)]
    ocr = spark.createDataFrame([("a.png", "Bridges", 0.1, 0.1, 0.2, 0.1, 0)], "path string, word string, x double, y double, w double, h double, line int")
    got = search.match_boxes(query_terms(asked(spark, "bridge")), ocr, spark.createDataFrame([("a.png",), ("b.png",)], "path string")).collect()
    assert {(r.path, r.status, len(r.boxes)) for r in got} == {("a.png", "indexed", 1), ("b.png", "empty", 0)}
    history = spark.createDataFrame([(1, "text", "Hello World", None), (2, "image", "png 1x1", "hello there"), (3, "url", "http://x", None)], "id long, content_type string, preview string, ocr_text string")
    queries = asked(spark, " HELLO ")
    assert sorted(r.id for r in search.filter_history(history, queries).collect()) == [1, 2]
    assert [r.id for r in search.filter_history(history, queries, "image").collect()] == [2]


def test_rank_vocabulary(spark):
    vocab = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "word string, df long")
    lemmas = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "word string")
    assert [(r["rank"], r.word) for r in rank_vocabulary(vocab, lemmas).orderBy("rank").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    assert tuple(vocabulary_counts(vocab, lemmas).first()) == (3, 1)


def test_prefix_of_a_key_counts_documents_once(spark):
    docs = corpus(spark, "apple apply apples", "apply", "pear")
    from sparkseek.operators.search import term_matches

    rows = term_matches(query_terms(asked(spark, "app"), stem=False), build_index(docs, stem=False)).collect()
    assert sorted((r.doc_id, r.tf, r.df) for r in rows) == [(0, 3, 2), (1, 1, 2)]
    assert F is not None
