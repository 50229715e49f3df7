"""Sources, sinks, extractors and streams."""

import io
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import usage
from sparkseek.operators.index import build_index, query_terms
from sparkseek.operators.search import search
from sparkseek.sources import files, index_store, office, readers
from sparkseek.streaming import state


@pytest.fixture
def tree(tmp_path):
    for name in (".hid/a.txt", ".d.txt", "_c.txt", "docs/deep/er/x.md", "docs/y.MD", "node_modules/z.md", "big.md"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("hello " * (1000 if name == "big.md" else 1))
    (tmp_path / "root" / "link").symlink_to(tmp_path / "root" / "docs")
    return str(tmp_path / "root")


def test_catalog(spark, tree):
    catalog = files.scan_catalog(spark, [tree, f"{tree}/docs"])
    rows = {r.path[len(tree) :]: r for r in catalog.collect()}
    assert set(rows) == {"/.hid", "/.hid/a.txt", "/.d.txt", "/_c.txt", "/docs", "/docs/deep", "/docs/deep/er", "/docs/deep/er/x.md", "/docs/y.MD", "/node_modules", "/node_modules/z.md", "/big.md", "/link"}
    assert rows["/docs"].is_dir and not rows["/link"].is_dir and rows["/docs/y.MD"].size == 6 and rows["/docs/y.MD"].parent == f"{tree}/docs"
    kept = files.prune_ignored(catalog, ["node_modules"])
    assert kept.where("path like '%node_modules%'").count() == 0
    roots = spark.createDataFrame([(tree, 2, None), (f"{tree}/docs/", 9, ["md"])], "root string, depth int, extensions array<string>")
    chosen = files.eligible_documents(kept, roots, ["txt", "md"], max_bytes=100)
    assert sorted(r.path[len(tree) :] for r in chosen.collect()) == ["/.d.txt", "/.hid/a.txt", "/_c.txt", "/docs/deep/er/x.md", "/docs/y.MD"]


def test_catalog_of_deep_and_wide_folders_by_depth_and_ending(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_MOST", 2)
    deep = tmp_path / "deep"
    (deep / "/".join(f"d{k}" for k in range(12))).mkdir(parents=True)
    for k in range(40):
        (deep / f"wide/{k}/x y").mkdir(parents=True)
        (deep / f"wide/{k}/x y/f{k}.{'TXT' if k % 2 else 'md'}").write_text("a" * k)
    every = {str(p): (p.is_dir(), 0 if p.is_dir() else p.stat().st_size) for p in deep.rglob("*")}
    got = files.scan_catalog(spark, [str(deep), f"{deep}/wide", f"{deep}/"]).collect()
    assert {r.path: (r.is_dir, r.size) for r in got} == every and len(got) == len(every)
    below = lambda p: p[len(str(deep)) :].count("/")
    shallow = files.scan_catalog(spark, [str(deep)], depth=4, extensions=["txt"]).collect()
    assert {r.path for r in shallow} == {p for p, (is_dir, _) in every.items() if below(p) <= 4 and (is_dir or p.endswith(".TXT"))}
    remote = files.scan_catalog(spark, [deep.as_uri()]).collect()
    assert {(r.path, r.is_dir, r.size) for r in remote} == {(f"{deep.as_uri()}{p[len(str(deep)) :].replace(' ', '%20')}", *v) for p, v in every.items()}
    assert files.scan_catalog(spark, [f"{tmp_path}/none"]).count() == 0


def test_annotations(spark):
    rows = [("a.rs", False, False, True, "code", "Rust Source"), ("archive.zip", False, False, False, "archive", "Archive"), (".hid/b.txt", False, True, True, "docs", "Text File"), ("Dockerfile", False, False, True, "code", "File"), ("d", True, False, False, "other", "Folder"), (".env", False, True, True, "other", "Env File"), ("x.tar", False, False, False, "archive", "Archive")]
    df = spark.createDataFrame([("/r/" + p, p.rpartition("/")[2], d, h, pre, c, k) for p, d, h, pre, c, k in rows], "path string, name string, is_dir boolean, h boolean, p boolean, c string, k string")
    got = files.annotate_files(df).collect()
    assert all((r.hidden, r.previewable, r.category, r.kind) == (r.h, r.p, r.c, r.k) for r in got), got


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b ""q"" c"\n"x\ny",2\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [("a", 'b "q" c'), ("x\ny", "2")]
    (tmp_path / "h.txt").write_text("12\thello\tworld\nx\tno\n13\t\nbare\n")
    assert sorted(tuple(r) for r in readers.read_history_lines(spark, str(tmp_path / "h.txt")).collect()) == [(12, "hello\tworld"), (13, "")]
    (tmp_path / "rates.json").write_text(json.dumps({"rates": {"eur": 0.5, "usd": 9.0}, "fetched_at": 7}))
    assert sorted(tuple(r) for r in readers.load_rates(spark, str(tmp_path / "rates.json")).collect()) == [("EUR", 0.5, 7), ("USD", 1.0, 7)]
    (tmp_path / "empty.json").write_text(json.dumps({"rates": {}, "fetched_at": 7}))
    assert readers.load_rates(spark, str(tmp_path / "empty.json")).count() == 0
    good = {"name": "pkg-a", "version": "1.0", "api": 1, "download_url": "https://x/y", "sha256": "A" * 64, "keywords": ["k"], "permissions": {"kv": True, "network": ["h"]}}
    packages = [good, good | {"name": "Bad Name"}, good | {"name": "b", "download_url": "http://x"}, good | {"name": "c", "sha256": "zz"}, good | {"name": "d", "sha256": ""}]
    (tmp_path / "cat.json").write_text(json.dumps({"schema": 1, "packages": packages}))
    ok, bad = readers.load_catalog(spark, str(tmp_path / "cat.json"))
    assert sorted(r.name for r in ok.collect()) == ["d", "pkg-a"] and ok.where("name = 'pkg-a'").first().permissions.kv is True
    assert {r.name: r.reason for r in bad.collect()} == {"Bad Name": "name", "b": "download_url", "c": "sha256"}
    (tmp_path / "old.json").write_text(json.dumps({"schema": 2, "packages": packages}))
    assert readers.load_catalog(spark, str(tmp_path / "old.json"))[0].count() == 0
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.txt").write_text("one\ntwo")
    assert [r.text for r in readers.load_text_corpus(spark, str(tmp_path / "corpus")).collect()] == ["one\ntwo"]
    corpus = spark.createDataFrame([("a.pdf", "one\f \fthree"), ("b.txt", "x\fy"), ("c.pdf", None)], "path string, text string")
    assert sorted((r.path, r.page, r.text) for r in readers.paginate(corpus).collect()) == [("a.pdf", 0, "one"), ("a.pdf", 2, "three")]
    assert sorted(r.path for r in readers.needs_ocr(corpus).collect()) == ["a.pdf", "b.txt", "c.pdf"]


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "red apple"), (2, "red car")], "doc_id long, text string")
    terms = query_terms(spark.createDataFrame([(1, "red ca")], "query_id long, query_text string"))
    for frame, want in ((docs, [2]), (docs.where("doc_id = 1"), [])):
        index_store.write_index(build_index(frame), path)
        assert [r.doc_id for r in search(terms, index_store.read_index(spark, path)).collect()] == want


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="w"'
    docx = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:p/><w:p/><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>"})
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    pptx = zipped({f"ppt/slides/slide{k}.xml": slide(f"s{k}") for k in (10, 2, 1)})
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c><c r="E3" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>'
    xlsx = zipped({"xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    ods = zipped({"content.xml": '<o:doc xmlns:o="o" xmlns:t="t"><t:table t:name="T"><t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="float" o:value="3" t:number-columns-repeated="2"><t:p>3</t:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="1000000"><t:table-cell t:number-columns-repeated="16000"/></t:table-row></t:table></o:doc>'})
    evil = zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    rows = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.ods", ods), ("e.docx", evil), ("f.docx", b"junk"), ("g.xyz", docx)], "path string, content binary")
    got = {r.path: r for r in office.extract_office_text(rows).collect()}
    assert got["a.docx"].text == "Hello\n\nWorld" and got["b.pptx"].text.split() == ["s1", "s2", "s10"] and "one" in got["c.xlsx"].text
    assert all(got[p].text is None and got[p].error for p in ("e.docx", "f.docx", "g.xyz"))
    cells = office.spreadsheet_cells(rows.where("path in ('c.xlsx', 'd.ods', 'f.docx')")).collect()
    assert sorted((r.row, r.col, r.type, r.text) for r in cells if r.path == "c.xlsx") == [(0, 0, "text", "one"), (0, 2, "number", "2.5"), (2, 1, "boolean", "TRUE"), (2, 2, "text", "in"), (2, 4, "error", "#DIV/0!")]
    assert sorted((r.row, r.col, r.num) for r in cells if r.path == "d.ods") == [(0, 0, 3.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 3.0)]
    assert [r.error is not None for r in cells if r.path == "f.docx"] == [True]


def test_serial_dates(spark):
    df = spark.createDataFrame([(45678.0,), (1.0,), (59.0,), (60.0,), (61.0,)], "n double")
    assert [str(r[0]) for r in df.select(office.serial_date(F.col("n"))).collect()] == ["2025-01-21", "1900-01-01", "1900-02-28", "None", "1900-03-01"]
    assert str(df.limit(1).select(office.serial_date(F.lit(0.0), 1904)).first()[0]) == "1904-01-01"


# Streams


def run_stream(spark, tmp_path, parts, build, schema, mode="update"):
    """Feeds parts as files, one micro-batch each, and gives all rows that come out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    source, rows = tmp_path / "in", []
    source.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"staged{k}"))
        next((tmp_path / f"staged{k}").glob("part-*.json")).rename(source / f"{k}.json")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "log")).start()
    query.processAllAvailable()
    query.stop()
    return rows


def test_stream_usage_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"i{rng.randint(0, 3)}", "app", rng.randint(0, 5_000_000)) for _ in range(60)]
    schema = "id string, kind string, ts long"
    rows = run_stream(spark, tmp_path, [events[:20], events[20:40], events[40:]], state.stream_usage, schema)
    last = {r.id: r for r in rows}
    for r in usage.usage_scores(spark.createDataFrame(events, schema)).collect():
        assert last[r.id].usage_score == pytest.approx(r.usage_score) and last[r.id].last_launched == r.last_launched


def test_health_gate_and_its_stream(spark, tmp_path):
    calls = [(0, False), (1, False), (2, False), (3, True), (30_001, True), (30_002, True), (30_003, False), (30_004, False), (30_005, False), (60_006, False), (180_005, True), (180_006, True)]
    rows = [("s", ts, k, ok) for k, (ts, ok) in enumerate(calls)]
    schema = "source string, ts long, seq long, ok boolean"
    batch = {r.seq: (r.admitted, r.shut_until) for r in state.health_gate(spark.createDataFrame(rows, schema)).collect()}
    assert batch[2] == (True, 30_002) and batch[3] == (False, 30_002) and batch[4] == (False, 30_002) and batch[5] == (True, 0) and batch[8] == (True, 60_005)
    assert batch[9] == (True, 180_006) and batch[10] == (False, 180_006) and batch[11] == (True, 0)
    streamed = {r.seq: (r.admitted, r.shut_until) for r in run_stream(spark, tmp_path, [rows[:5], rows[5:9], rows[9:]], state.stream_health, schema)}
    assert streamed == batch


def test_superseded_rows(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 1, "late"), ("b", 1, "z")]
    schema = "session string, query_id long, id string"
    assert sorted(r.id for r in state.drop_superseded(spark.createDataFrame(rows, schema)).collect()) == ["y", "z"]
    out = run_stream(spark, tmp_path, [rows[:1], rows[1:2], rows[2:]], lambda s: state.stream_drop_superseded(s, keep_ms=None), schema, "append")
    assert sorted(r.id for r in out) == ["x", "y", "z"]


BATCH = "query_id long, source string, seq long, volatile boolean, id string, score double, title string"


def test_merge_results_batch_and_stream(spark, tmp_path):
    rows = [(1, "a", 1, False, "x", 1.0, "old"), (1, "a", 2, False, "x", 3.0, "new"), (1, "v", 1, True, "gone", 9.0, ""), (1, "v", 3, True, "here", 2.0, ""), (2, "a", 1, False, "q", 1.0, "")]
    merged = [(r.query_id, r.id, r.title, r["rank"]) for r in state.merge_results(spark.createDataFrame(rows, BATCH)).orderBy("query_id", "rank").collect()]
    assert merged == [(1, "x", "new", 1), (1, "here", "", 2), (2, "q", "", 1)]
    source, seen = tmp_path / "in", {}
    source.mkdir()
    for k, part in enumerate([rows[:3], rows[3:]]):
        spark.createDataFrame(part, BATCH).coalesce(1).write.json(str(tmp_path / f"s{k}"))
        next((tmp_path / f"s{k}").glob("part-*.json")).rename(source / f"{k}.json")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).json(str(source))
    merged = state.stream_merged(stream, keep_ms=None).writeStream.outputMode("update")
    query = merged.foreachBatch(lambda df, epoch: seen.update({epoch: df.collect()})).option("checkpointLocation", str(tmp_path / "keep")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.query_id, r.id) for r in seen[0]) == [(1, "gone"), (1, "x")]
    assert sorted((r.query_id, r.id, r["rank"]) for r in seen[1]) == [(1, "here", 2), (1, "x", 1), (2, "q", 1)]


def test_merged_results_are_shown_by_a_timer_and_when_sources_end(spark, tmp_path):
    shape = BATCH + ", status string"
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.json(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.json")).rename(tmp_path / "in" / f"{name}.json")

    arrive("a", (1, "a", 1, False, "x", 1.0, "one", None), (1, "b", 1, False, None, None, None, None), (2, "a", 1, False, "q", 1.0, "", None), (2, "a", 2, False, None, None, None, "done"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    shown = []
    query = state.stream_merge_results(stream, lambda df, _: shown.extend(map(tuple, df.collect())), str(tmp_path / "keep"), interval_ms=300)

    def wait(done):
        until = time.time() + 60
        while not done() and time.time() < until:
            time.sleep(0.2)
        assert done(), shown

    try:
        wait(lambda: {r[0] for r in shown} == {1, 2})  # query 2 has ended; query 1 is shown when its timer ends
        assert (2, "q", "a", 1.0, "", 1) in shown and (2, None, "a", None, "done", 0) in shown and (1, "x", "a", 1.0, "one", 1) in shown
        arrive("b", (1, "a", 2, False, "y", 5.0, "two", None), (1, "a", 3, False, None, None, None, "done"), (1, "b", 2, False, None, None, None, "timed out"))
        wait(lambda: (1, None, "b", None, "timed out", 0) in shown)
        assert {(1, "y", "a", 5.0, "two", 1), (1, "x", "a", 1.0, "one", 2), (1, None, "a", None, "done", 0)} <= set(shown)
    finally:
        query.stop()


def test_paths_are_given_once_they_are_quiet(spark, tmp_path):
    at = lambda path, ms: (path, ms)
    parts = [[at("/a", 0), at("/b", 100), at("/a", 400)], [at("/a", 800), at("/b", 900)], [at("/a", 5000), at(None, 5600)], [at(None, 9000)]]
    out = run_stream(spark, tmp_path, parts, state.quiet_paths, "path string, seen_at long", "append")
    found = sorted((r.path, round(r.first_seen.timestamp() * 1000), round(r.seen_at.timestamp() * 1000), r.n) for r in out)
    assert found == [("/a", 0, 800, 3), ("/a", 5000, 5000, 1), ("/b", 100, 100, 1), ("/b", 900, 900, 1)]


def test_file_changes(spark, tmp_path):
    schema = "path string, size long"
    table = spark.createDataFrame([("/a", 1), ("/a/b", 1), ("/a/c", 1), ("/d", 1)], schema)
    current = spark.createDataFrame([("/a", 2), ("/a/b", 2), ("/d", 9)], schema)
    touched = spark.createDataFrame([("/a", 1), ("/a", 2)], "path string, seen_at long")
    assert sorted(map(tuple, state.apply_file_changes(table, touched, current).collect())) == [("/a", 2), ("/a/b", 2), ("/d", 1)]
    written = {}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path": "/a", "seen_at": 1}\n{"path": "/a", "seen_at": 300}\n{"seen_at": 2000}\n')
    stream = spark.readStream.schema("path string, seen_at long").json(str(tmp_path / "in"))
    query = state.stream_file_changes(stream, lambda: table, lambda _: current, lambda df, epoch: written.update({epoch: sorted(map(tuple, df.collect()))}), str(tmp_path / "log"))
    query.processAllAvailable()
    until = time.time() + 30
    while len(written) < 2 and time.time() < until:  # the path is quiet once the batch that tells the time is done
        time.sleep(0.2)
    query.stop()
    assert [rows for _, rows in sorted(written.items())][:2] == [sorted(map(tuple, table.collect())), [("/a", 2), ("/a/b", 2), ("/d", 1)]]


def test_stale_sources(spark):
    log = spark.createDataFrame([("fresh", 9_000, True), ("old", 10, True), ("failing", 9_950, False), ("retry", 9_000, False), ("fixed", 10, True), ("fixed", 9_990, False)], "source string, ts long, ok boolean")
    got = {r.source: r.stale for r in state.stale_sources(log, now=10_000, interval_s=1).collect()}
    assert got == {"fresh": False, "old": True, "failing": False, "retry": True, "fixed": False}
