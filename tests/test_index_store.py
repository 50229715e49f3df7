"""The stored index: commits, conflicts, crashes, tombstones, merging, cleaning up, bounds of blocks, positions."""

import os
import random

import pytest

from sparkseek.operators import search
from sparkseek.operators.index import analysed, build_index, query_terms, tokens
from sparkseek.sources import index_store
from sparkseek.sources.index_store import compact, read_index, upsert_index, vacuum, versions, write_index

WORDS = ["red", "apple", "apples", "car", "the", "running", "run", "søk", "café", "applied", "app", "of", "a"]


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string" + extra)


def some_docs(seed, n, most=40):
    rng = random.Random(seed)
    return {k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(0, most))) for k in range(n)}


def rows(df):
    return sorted(map(str, df.collect()))


def same(index, docs, spark):
    want = build_index(docs_of(spark, docs.items()).coalesce(1))
    assert rows(index.postings.select("key", "doc_id", "tf", "positions")) == rows(want.postings.select("key", "doc_id", "tf", "positions"))
    assert rows(index.term_stats) == rows(want.term_stats)
    assert rows(index.doc_stats) == rows(want.doc_stats.selectExpr("doc_id", "int(len) as len"))
    assert index.scope == tuple(want.doc_stats.selectExpr("count(*)", "coalesce(sum(len), 0)").first())
    assert {r.doc_id for r in index.documents.collect()} == set(docs)


def test_commits_equal_a_new_index(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "i")
    docs = some_docs(1, 40, 12)
    write_index(analysed(docs_of(spark, docs.items())), path)
    same(read_index(spark, path), docs, spark)
    for _ in range(2):
        changed = {rng.randint(0, 50): rng.choice(["", " . ", "red car", "apples\nrunning the run"]) for _ in range(6)}
        removed = {rng.randint(0, 50) for _ in range(4)} - set(changed)
        docs = {k: t for k, t in docs.items() if k not in removed} | changed
        touched = spark.createDataFrame([(k,) for k in removed], "doc_id long")
        version = upsert_index(spark, path, analysed(docs_of(spark, changed.items())), touched, compact_after=2)
        assert read_index(spark, path, version).scope == read_index(spark, path).scope
    same(read_index(spark, path), docs, spark)
    assert len(index_store._state(spark, path)["segments"]) == 1 and versions(spark, path) == [1, 2, 3, 4]  # merged at last


def test_blank_documents_stay_known_and_pages_and_boxes_go_with_their_document(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = docs_of(spark, [(1, "one two", 7, 70), (2, "three", 5, 50), (3, None, 0, 30), (None, "lost", 1, 1)], ", size long, mtime long")
    pages = spark.createDataFrame([(1, 0, "one"), (1, 1, " "), (1, 2, "two"), (2, 0, "three")], "doc_id long, page int, text string")
    boxes = spark.createDataFrame([(1, "one", 0, 1.0, 2.0, 3.0, 4.0), (2, "three", 0, 1.0, 2.0, 3.0, 4.0)], "doc_id long, word string, line int, x double, y double, w double, h double")
    write_index(analysed(docs, pages=pages, boxes=boxes), path)
    index = read_index(spark, path)
    assert {tuple(r) for r in index.documents.collect()} == {(1, 2, 7, 70), (2, 1, 5, 50), (3, 0, 0, 30)}
    assert {(r.doc_id, r.page) for r in index.pages.collect()} == {(1, 0), (1, 2), (2, 0)}
    upsert_index(spark, path, analysed(docs_of(spark, [(1, "", 9, 71)], ", size long, mtime long")), docs.where("doc_id = 2").select("doc_id"))
    index = read_index(spark, path)
    assert {tuple(r) for r in index.documents.collect()} == {(1, 0, 9, 71), (3, 0, 0, 30)}
    assert not index.pages.count() and not index.boxes.count() and not index.term_stats.count() and index.scope == (0, 0)
    hits = search.search(query_terms(spark.createDataFrame([(1, "one")], "query_id long, query_text string")), index, metadata=index.documents)
    assert hits.collect() == []


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), some_docs(2, 12)
    write_index(analysed(docs_of(spark, docs.items())), path)

    def crash(*a):
        raise KeyboardInterrupt

    for step in ("_counted", "create_once"):
        with monkeypatch.context() as m:
            m.setattr(index_store, step, crash)
            with pytest.raises(KeyboardInterrupt):
                upsert_index(spark, path, analysed(docs_of(spark, [(1, "new words")])), docs_of(spark, [(2, "")]).select("doc_id"))
        assert versions(spark, path) == [1]
    same(read_index(spark, path), docs, spark)
    used = {s["name"] for s in index_store._state(spark, path)["segments"]}
    assert len(os.listdir(f"{path}/segments")) == 3
    assert vacuum(spark, path) == []  # too young
    assert len(vacuum(spark, path, older_than=-60)) == 2 and set(os.listdir(f"{path}/segments")) == used
    same(read_index(spark, path), docs, spark)
    assert not [n for n in os.listdir(f"{path}/log") if n.startswith("_")]


def test_two_writers_at_once_both_take_effect(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "i"), some_docs(3, 12)
    write_index(analysed(docs_of(spark, docs.items())), path)
    none = docs_of(spark, []).select("doc_id")
    real, first = index_store._commit, []

    def commit(*a):
        if not first:  # another one commits just before
            first.append(1)
            upsert_index(spark, path, analysed(docs_of(spark, [(1, "theirs theirs"), (2, "theirs")])), none)
        return real(*a)

    monkeypatch.setattr(index_store, "_commit", commit)
    upsert_index(spark, path, analysed(docs_of(spark, [(2, "ours"), (3, "ours red")])), none)
    same(read_index(spark, path), docs | {1: "theirs theirs", 2: "ours", 3: "ours red"}, spark)
    first.clear()
    compact(spark, path)  # the same while segments are merged
    same(read_index(spark, path), docs | {1: "theirs theirs", 2: "theirs", 3: "ours red"}, spark)
    assert len(index_store._state(spark, path)["segments"]) == 2
    assert versions(spark, path) == [1, 2, 3, 4, 5] and not index_store._commit(spark, path, 5, [], 0, 0)
    monkeypatch.setattr(index_store, "_commit", lambda *a: False)
    with pytest.raises(index_store.Conflict):
        upsert_index(spark, path, analysed(docs_of(spark, [(9, "x")])), none, attempts=2)


def test_old_versions_and_schemas(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)
    for text in ("one", "two", "three"):
        write_index(analysed(docs_of(spark, [(1, text)]), stem=False), path)
    keys = lambda v=None: [r.key for r in read_index(spark, path, v).term_stats.collect()]
    assert keys(1) == ["one"] and keys(2) == ["two"] and keys() == ["three"]
    assert len(vacuum(spark, path, keep=1, older_than=-60)) == 2 and versions(spark, path) == [3] and keys() == ["three"]
    monkeypatch.setattr(index_store, "SCHEMA_VERSION", 99)
    assert read_index(spark, path) is None


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """An index as tables of a query, and the same one stored, in two segments."""
    docs = some_docs(7, 300, 60)
    path = str(tmp_path_factory.mktemp("index"))
    write_index(analysed(docs_of(spark, [(k, t if k % 7 else "old " + t) for k, t in docs.items()]), stem=False), path)
    upsert_index(spark, path, analysed(docs_of(spark, [(k, t) for k, t in docs.items() if k % 7 == 0]), stem=False), docs_of(spark, []).select("doc_id"))
    frame = docs_of(spark, docs.items())
    return frame, build_index(frame, stem=False), read_index(spark, path)


QUERIES = [(0, "red"), (1, "app"), (2, "the of"), (3, "car apples"), (4, "the"), (5, "red app"), (6, "nothing"), (7, "old"), (8, "running car red the"), (9, "a"), (10, "sok cafe"), (11, None)]


def asked(spark):
    return query_terms(spark.createDataFrame(QUERIES, "query_id long, query_text string"), stem=False)


@pytest.mark.parametrize(("limit", "prune_from"), [(1, 0), (5, 0), (1000, 0), (5, 10**9)])
def test_stored_search_equals_the_plain_one(spark, both, limit, prune_from):
    _, plain, stored = both
    want = search.search(asked(spark), plain, limit=limit).collect()
    got = search.search(asked(spark), stored, limit=limit, prune_from=prune_from).collect()
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 6


def test_few_postings_of_common_words_are_scored(spark, tmp_path):
    rng = random.Random(11)
    common = [f"w{k}" for k in range(60)]
    docs = docs_of(spark, [(k, " ".join(rng.choices(["the", "and", *common], [30, 20, *range(60, 0, -1)], k=rng.randint(5, 300)))) for k in range(3000)])
    write_index(analysed(docs, stem=False), str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"))
    terms = query_terms(spark.createDataFrame([(1, "w1 zz"), (2, "the and"), (3, "w2 w3 zz")], "query_id long, query_text string").selectExpr("query_id", "replace(query_text, ' zz', '') as query_text"), stem=False)
    terms = terms.selectExpr("query_id", "ord", "norm", "key", "false as is_last", "ranked")
    hits, report = search.scored_blocks(terms, index, limit=5)
    want = search.search(terms, build_index(docs, stem=False), limit=5)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in hits.collect()) == sorted((r.query_id, r["rank"], r.doc_id) for r in want.collect())
    seen = {r.query_id: r.rows_scored / r.rows for r in report.collect()}
    assert seen[1] < 0.25 and seen[2] < 0.25


def test_long_queries_gather_only_blocks_with_their_rarest_terms(spark, tmp_path, monkeypatch):
    """Words of nearly all documents aren't grouped for documents that lack a query's rare ones; the hits are those of a
    search that scores all, with prefixes, queries of few terms and terms that no document has."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('one two three four five ', if(id % 100 = 7, 'rare ', ''), if(id % 50 = 7, 'seldom ', ''), if(id % 3 = 0, 'sixth', 'sixty'), repeat(' pad', int(id % 4))) AS text")
    write_index(build_index(docs, stem=False), str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"))
    asked = [(1, "one two three four five rare seldom six"), (2, "one two three four five none"), (3, "rare"), (4, "one two sixty"), (5, "seldom one two three sixth"), (6, "there and the of it")]
    terms = query_terms(spark.createDataFrame(asked, "query_id long, query_text string"), stem=False)
    gathered, write = [], search.written

    def watched(df):
        out = write(df)
        if out.columns == ["query_id", "seg", "block"]:
            gathered.append({r.query_id: r["count"] for r in out.groupBy("query_id").count().collect()})
        return out

    monkeypatch.setattr(search, "written", watched)
    want = sorted(map(tuple, search.search(terms, build_index(docs, stem=False), limit=5).selectExpr("query_id", "rank", "doc_id", "round(score, 9)").collect()))
    for prune_from in (0, 1 << 40):
        hits = search.scored_blocks(terms, index, limit=5, prune_from=prune_from)[0]
        assert sorted(map(tuple, hits.selectExpr("query_id", "rank", "doc_id", "round(score, 9)").collect())) == want
    assert {q for q, *_ in want} == {1, 3, 4, 5} and [g[1] for g in gathered] == [4, 4] and all(2 not in g and g[5] == 8 for g in gathered)


def test_readers_of_positions_equal_those_of_texts(spark, both):
    frame, plain, stored = both
    terms = asked(spark)
    hits = search.search(terms, plain, limit=8)
    hits = spark.createDataFrame(hits.collect(), hits.schema)
    terms = spark.createDataFrame(terms.collect(), terms.schema)
    words = tokens(frame)
    assert rows(search.indexed_spans(hits, terms, stored)) == rows(search.match_spans(hits, terms, words, stem=False).select("query_id", "doc_id", "pos", "raw", "key"))
    assert rows(search.indexed_spans(hits, terms, stored, max_marks=2)) == rows(search.match_spans(hits, terms, words, max_marks=2, stem=False))
    for size in (3, 20):
        assert rows(search.indexed_snippets(hits, terms, stored, size=size)) == rows(search.snippets(hits, terms, words, size=size, stem=False))
    lines = frame.selectExpr("doc_id", "posexplode(split(text, '\n')) as (line, text)")
    for window, most in ((3, 4),):
        assert rows(search.indexed_passage(terms, stored, window, most)) == rows(search.best_passage(terms, lines, window, most, stem=False))
    some = search.best_passage(terms, lines, stem=False).join(hits, ["query_id", "doc_id"], "left_semi")
    assert rows(search.indexed_passage(terms, stored, hits=hits)) == rows(some)


def test_a_search_leaves_only_its_result(spark, both):
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top))
    hits = search.search(asked(spark), both[2], limit=5, prune_from=0)
    assert len(set(os.listdir(top)) - before) == 1 and hits.count()
