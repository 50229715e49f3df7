"""What the third review found."""

import os
import sys

import pandas as pd
from pyspark.sql import functions as F

from sparkseek import queries, source_queries
from sparkseek.operators import search, usage
from sparkseek.operators.index import analysed, build_index, packed_postings, query_terms
from sparkseek.plans import root_search
from sparkseek.plans.root_search import Source, Sources
from sparkseek.sources.index_store import read_index, write_index
from sparkseek.streaming import state

sys.path.insert(0, os.path.dirname(__file__))
from test_sources_and_streams import run_stream  # noqa: E402


def test_packages_of_one_url_are_verified_each_by_its_own_entry(spark, tmp_path):
    pages = [(k, "https://a.org/x" if k < 8 else None, None if k == 5 else f"<p>{k}") for k in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = [{0: "unknown", 1: "checksum"}.get(k % 4, "version" if k % 4 == 2 and k % 3 == 0 else None) for k in range(12)]
    got = queries.QUERIES["verify_packages"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(f"Row(name={url!r}, reason={reason!r})" for (_, url, _), reason in zip(pages, want, strict=True))


def test_an_index_moves_postings_once_and_has_bounds_with_them(spark, tmp_path):
    docs = {k: " ".join(f"w{(k * j) % 7}" for j in range(k % 40)) for k in range(300)} | {1000: "long " * 40_000 + "end", 1001: "", 1002: "\n\nthe end"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    words = analysed(frame, stem=False).words
    plan = packed_postings(spark.createDataFrame([], words.schema), False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    write_index(analysed(frame, stem=False), str(tmp_path / "i"))
    (segment,) = os.listdir(tmp_path / "i" / "segments")
    assert "blocks" not in os.listdir(tmp_path / "i" / "segments" / segment)
    index, plain = read_index(spark, str(tmp_path / "i")), build_index(frame, stem=False)
    rows = lambda df: sorted(map(str, df.select("key", "doc_id", "tf", "positions").collect()))
    assert rows(index.postings) == rows(plain.postings)
    assert index.postings.where("doc_id = 1002").select("key", "lines").orderBy("key").collect() == [("end", [2]), ("the", [2])]
    best = index.postings.groupBy("key", "block").agg(F.count("*").alias("n"), F.max("tf").alias("t"), F.max(F.col("tf") / F.col("len")).alias("s"), F.min("doc_id").alias("d"))
    whole = index.blocks.groupBy("key", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("t"), F.max("max_share").alias("s"), F.min("first_doc").alias("d"))
    assert sorted(map(str, best.collect())) == sorted(map(str, whole.collect()))


def test_a_word_is_moved_to_its_documents_once_for_all_queries(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"red car {k}\nblue") for k in range(50)], "doc_id long, text string")
    write_index(analysed(frame, stem=False), str(tmp_path / "i"))
    index = read_index(spark, str(tmp_path / "i"))
    asked = query_terms(spark.createDataFrame([(q, "red blue") for q in range(20)], "query_id long, query_text string"), stem=False)
    found = search.indexed_passage(asked, index)
    assert {(r.first_line, r.coverage) for r in found.collect()} == {(0, 2)} and found.count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and "LeftSemi" in plan.split("RepartitionByExpression")[1]


def test_rows_of_many_queries_are_sorted_in_many_tasks(spark, monkeypatch):
    asked = spark.createDataFrame([(q, "text") for q in range(50)], "query_id long, query_text string").coalesce(1)
    sources = Sources()
    sources.register_source(Source("s", lambda q: q.select("query_id", F.lit("a").alias("id"), F.lit("t").alias("title"), F.lit(1.0).alias("relevance"))))
    monkeypatch.setattr(root_search, "_QUERIES", 10)
    assert sources.candidates(asked).rdd.getNumPartitions() == 5 and sources.candidates(asked).count() == 50
    monkeypatch.setattr(root_search, "_QUERIES", 50)
    assert sources.candidates(asked).count() == 50


def test_workbooks_of_one_file_are_made_and_read_in_many_tasks(spark, tmp_path, monkeypatch):
    parts = spark.createDataFrame([(k, f"part {k}", k % 9) for k in range(40)], "p_partkey long, p_name string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(source_queries, "WORKBOOKS", 5)
    books = source_queries.workbooks(spark, str(tmp_path))
    assert books.rdd.getNumPartitions() == 8 and books.select("path").distinct().count() == 40


def test_postings_of_a_range_of_documents_are_written_where_they_are_read(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"red car {k % 5}") for k in range(400)], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_index(analysed(frame, stem=False), str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    index = read_index(spark, str(tmp_path / "i"))
    name = F.input_file_name()
    files = index.postings.groupBy(name.alias("file")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("low").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:], strict=False))
    assert {r.df for r in index.term_stats.where("key IN ('red', 'car')").collect()} == {400}


class _Calls:
    """A state of a stream that counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = [], 0

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "appendList":
                self.kept += given[0]
            if name == "put":
                self.kept = list(given[0])
            return {"get": iter(self.kept), "iterator": iter([]), "exists": False}.get(name)

        return call


def test_results_of_a_query_are_kept_by_few_calls():
    merged = state._Merged(0, None)
    merged.handle, merged.rows, merged.sources, merged.due = None, _Calls(), _Calls(), _Calls()
    for seq in range(4):
        batch = pd.DataFrame({"source": "a", "seq": seq, "volatile": False, "id": [f"r{k}" for k in range(2000)], "score": float(seq), "title": "", "status": None})
        (shown,) = merged.handleInputRows((1,), iter([batch]), None)
        assert len(shown) == 2000 and set(shown["score"]) == {float(seq)}
    assert merged.rows.calls + merged.sources.calls + merged.due.calls < 40 and len(merged.rows.kept) < 8000


def test_many_ids_of_a_stream_go_through_one_call(spark, tmp_path):
    launches = [(f"i{k % 30}" if k % 7 else None, "app", 1000 * ((k * 37) % 90)) for k in range(90)]
    schema = "id string, kind string, ts long"
    rows = run_stream(spark, tmp_path, [launches[:40], launches[40:]], lambda s: state.stream_usage(s, buckets=1), schema)
    last = {r.id: (round(r.usage_score, 9), r.last_launched) for r in rows}
    assert last == {r.id: (round(r.usage_score, 9), r.last_launched) for r in usage.usage_scores(spark.createDataFrame(launches, schema)).collect()}


def test_calls_of_many_sources_go_through_one_call(spark, tmp_path):
    calls = [(f"s{k % 4}", 400 * k, k, k % 3 == 0) for k in range(120)]
    schema = "source string, ts long, seq long, ok boolean"
    rows = run_stream(spark, tmp_path, [calls[:50], calls[50:90], calls[90:]], lambda s: state.stream_health(s, buckets=1), schema)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, state.health_gate(spark.createDataFrame(calls, schema)).collect()))
