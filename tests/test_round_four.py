"""Searches whose last words are prefixes of much of the vocabulary."""

import random

import pytest

from sparkseek.operators import search
from sparkseek.operators.index import analysed, build_index, query_terms
from sparkseek.sources.index_store import read_index, write_index

N = 1100


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of words with one beginning and of others; a batch of them has several packs of blocks."""
    rng = random.Random(5)
    text = lambda: " ".join([*(f"ab{rng.randrange(500)}" for _ in range(12)), *(f"z{rng.randrange(500)}" for _ in range(24)), *(["here"] if rng.random() < 0.3 else [])])
    docs = spark.createDataFrame([(k * 3, text()) for k in range(N)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path_factory.mktemp("index"))
    write_index(analysed(docs, stem=False), path)
    asked = [(1, "here ab"), (2, "ab1"), (3, "z1 here ab"), (4, "here"), (5, "none ab")]
    terms = query_terms(spark.createDataFrame(asked, "query_id long, query_text string"), stem=False)
    return docs, read_index(spark, path), spark.createDataFrame(terms.collect(), terms.schema)


def shuffled(spark, after: int) -> tuple[int, int]:
    """The last stage, and rows that stages after one have shuffled."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    seen = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(k) for k in range(stages.size()))]
    return max((k for k, _ in seen), default=-1), sum(n for k, n in seen if k > after)


def ranked(hits):
    return sorted(map(tuple, hits.selectExpr("query_id", "rank", "doc_id", "round(score, 9)").collect()))


def test_postings_stay_where_they_are_when_a_prefix_has_many_words(spark, corpus, monkeypatch):
    """Words that prefixes stand for may be too many to broadcast; postings still aren't shuffled to meet them."""
    docs, index, terms = corpus
    monkeypatch.setattr(search, "_BROADCAST", 200)
    monkeypatch.setattr(search._small, "__defaults__", (200,))
    monkeypatch.setattr(search, "_HEAD", 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last, _ = shuffled(spark, -1)
        got = ranked(search.scored_blocks(terms, index, limit=5, prune_from=1 << 40)[0])
        moved = shuffled(spark, last)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ranked(search.search(terms, build_index(docs, stem=False), limit=5)) and len(got) > 10
    assert moved < index.postings.count()


@pytest.mark.parametrize(("broadcast", "heads"), [(8, 2000), (200_000, 0), (1, 2000)])
def test_hits_do_not_depend_on_what_is_broadcast(spark, corpus, broadcast, heads, monkeypatch):
    docs, index, terms = corpus
    want = ranked(search.search(terms, build_index(docs, stem=False), limit=5))
    monkeypatch.setattr(search, "_BROADCAST", broadcast)
    monkeypatch.setattr(search._small, "__defaults__", (broadcast,))
    monkeypatch.setattr(search, "_HEADS", heads)
    assert ranked(search.scored_blocks(terms, index, limit=5, first=4)[0]) == want


def test_packs_of_a_batch_in_parts(spark, corpus):
    docs, index, _ = corpus
    columns = ["key", "doc_id", "tf", "positions"]
    want = build_index(docs, stem=False).postings
    assert sorted(map(str, index.postings.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
