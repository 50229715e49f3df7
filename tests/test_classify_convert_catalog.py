"""Classification, conversion, catalogs, layout and maintenance."""

import colorsys
import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import catalog, classify, convert, layout, refresh
from sparkseek.operators.index import query_terms
from sparkseek.queries import QUERIES


def test_content_types(spark):
    rows = [("#ff8800", "color"), ("#FFF", "color"), ("#11223344", "color"), ("rgb(12, 34, 56)", "color"), ("rgba(0,0,0,0.5)", "color"), ("#ggg", "text"), ("#12", "text"), ("rgb(nope)", "text"), ("https://a b", "text"), ("see https://x.com", "text"), ("http://a.bc", "url"), ('{"a":1}', "json"), ('[{"a":1}]', "json"), ('{ "a"', "json"), ("", "text")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.content_type(F.col("s"))).collect())
    full = {r.s: r.got for r in df.withColumn("got", classify.content_type(F.col("s"), "full")).collect()}
    assert full['{ "a"'] == "text" and full['{"a":1}'] == "json" and full["rgb(12, 34, 56)"] == "color"


def test_history_rows(spark):
    history = spark.createDataFrame([(1, "[[ binary data 83 KiB png 1068x904 ]]"), (2, "[[ binary data 512 B jpeg 32x32 ]]"), (3, "[[ binary data png 64x64 ]]"), (4, "\n\n"), (5, "  first \nsecond"), (6, "#FFF")], "id long, content string")
    text = spark.createDataFrame([(1, 83 * 1024, "found"), (2, 1, "stale"), (3, 0, "unknown size")], "id long, byte_size long, text string")
    got = {r.id: r for r in classify.classify_history(history, image_text=text).collect()}
    assert [(got[k].byte_size, got[k].format, got[k].width, got[k].height, got[k].ocr_text) for k in (1, 2, 3)] == [(84_992, "png", 1068, 904, "found"), (512, "jpeg", 32, 32, None), (None, "png", 64, 64, "unknown size")]
    assert (got[4].preview, got[5].preview, got[6].color, got[1].content_type) == ("(blank)", "first", "#FFF", "image")
    assert classify.facet_counts(classify.classify_history(history)).first().asDict() == {"all": 6, "text": 2, "image": 3, "url": 0, "color": 1}


def test_entities_routes_and_statistics(spark):
    rows = [("https://x.y/z", "url"), ("www.a.b", "url"), ("a@b.cc", "email"), ("1 + 2*3", "math"), ("123", "none"), ("km to m", "math"), ("1.5 GiB to MB", "math"), ("don't", "word"), ("a", "none"), ("two words", "none"), ("", "none"), ("x" * 300, "none"), (None, "none")]
    assert all(r.entity == r.want for r in classify.detect_entities(spark.createDataFrame(rows, "text string, want string")).collect())
    routes = [("firefox", "plain", "firefox"), ("2+2", "calculator", "2+2"), ("sqrt x", "calculator", "sqrt x"), ("eur to huf", "conversion", "1 eur to huf"), ("5km to m", "conversion", "5km to m"), ("days until dec 25", "date", "days until dec 25"), ("today", "date", "today")]
    got = classify.route_queries(spark.createDataFrame(routes, "query_text string, want string, q string")).collect()
    assert all((r.route, r.eval_query) == (r.want, r.q) for r in got)
    stats = classify.text_statistics(spark.createDataFrame([("a b\nc\n",), ("",), (None,)], "text string")).collect()
    assert [(r.chars, r.words, r.lines) for r in stats] == [(6, 3, 3), (0, 0, 0), (0, 0, 0)]


def test_utf8_cut_and_logs(spark):
    text = "aé€😀b"
    for n in range(1, 12):
        want = text.encode()[:n].decode("utf-8", "ignore")
        assert spark.createDataFrame([(text,)], "t string").select(classify.utf8_cut(F.col("t"), n)).first()[0] == want
    logs = spark.createDataFrame([("a", k, k, "x" * 10) for k in range(10)] + [("b", 1, 1, "y")], "source string, ts long, seq long, message string")
    tail = classify.log_tail(logs, 3, 4).collect()
    assert sorted((r.source, r.ts, r.message) for r in tail) == [("a", 7, "xxxx"), ("a", 8, "xxxx"), ("a", 9, "xxxx"), ("b", 1, "y")]
    actions = spark.createDataFrame([("s", f"a{k}", f"l{k}", "", "", k) for k in range(70)] + [("s", "a0", "new", "", "", 99)], "source string, action_id string, label string, hint string, shortcut string, ts long")
    seen = {r.action_id: r for r in classify.seen_actions(actions).collect()}
    assert len(seen) == 64 and seen["a0"].label == "new" and seen["a0"].place == 1 and "a64" not in seen


def test_currency(spark):
    rates = spark.createDataFrame([("USD", 1.0, 0), ("EUR", 0.5, 0)], "currency string, rate double, fetched_at long")
    amounts = spark.createDataFrame([(1.0, "eur", "usd"), (100.0, "USD", "eur"), (1.0, "usd", "xyz")], "amount double, from string, to string")
    got = convert.convert_currency(amounts, rates, F.lit(2 * convert.DAY_MS)).collect()
    assert sorted((r.to, r.converted, r.provenance) for r in got) == [("eur", 50.0, "1970-01-01"), ("usd", 2.0, "1970-01-01"), ("xyz", None, None)]
    assert convert.convert_currency(amounts, rates, F.lit(1)).where("provenance is not null").count() == 0


def test_dates(spark):
    now = datetime.datetime(2026, 7, 1, 14, 30)
    rows = [(now, 3, "weeks", "Wed, Jul 22 2026"), (now, -45, "days", "Sun, May 17 2026"), (now, 6, "months", "Fri, Jan 1 2027"), (now, 2, "hours", "Wed, Jul 1 2026 16:30"), (datetime.datetime(2024, 1, 31), 1, "month", "Thu, Feb 29 2024"), (datetime.datetime(2024, 2, 29), 1, "year", "Fri, Feb 28 2025")]
    assert all(r.label == r.want for r in convert.shift_dates(spark.createDataFrame(rows, "at timestamp, n int, unit string, want string")).collect())
    today = datetime.date(2026, 7, 1)
    days = convert.days_until(spark.createDataFrame([(today, 12, 25), (today, 1, 1), (today, 7, 1), (today, 2, 30)], "today date, month int, day int")).collect()
    assert [r.days for r in days] == [177, 184, 0, None]


def test_zones(spark):
    at = lambda h, m, month=7: datetime.datetime(2026, month, 1, h, m)
    rows = [(at(15, 0), "New York", "paris", at(21, 0)), (at(15, 30), "Tokyo", "UTC", at(6, 30)), (at(15, 30), "UTC+2", "tokyo", at(22, 30)), (at(10, 0), "utc+5:30", "utc", at(4, 30)), (at(10, 0), "utc+99", "utc", None), (at(10, 0), "nowhere", "utc", None), (datetime.datetime(2026, 3, 8, 2, 30), "EST", "utc", None), (at(12, 0), "Europe/Oslo", "gmt", at(10, 0))]
    got = convert.convert_zones(spark.createDataFrame(rows, "wall timestamp_ntz, src string, dst string, want timestamp_ntz"), convert.zone_table(spark)).collect()
    assert len(got) == len(rows) and all(r.converted == r.want for r in got), got
    labels = spark.createDataFrame([("+05:30", "UTC+5:30"), ("-05:00", "UTC-5")], "o string, want string").withColumn("got", convert.offset_label(F.col("o")))
    assert all(r.got == r.want for r in labels.collect())


def test_date_phrases(spark):
    now = datetime.datetime(2026, 7, 1, 14, 30)
    rows = {
        "now": ("shift", "Wed, Jul 1 2026 14:30"), " Tomorrow ": ("shift", "Thu, Jul 2 2026 14:30"), "now + 3 weeks": ("shift", "Wed, Jul 22 2026"), "now+3  weeks": ("shift", "Wed, Jul 22 2026"),
        "today - 45 days": ("shift", "Sun, May 17 2026"), "tomorrow + 2 months": ("shift", "Wed, Sep 2 2026"), "now - 90 min": ("shift", "Wed, Jul 1 2026 13:00"), "now + 1 hr": ("shift", "Wed, Jul 1 2026 15:30"),
        "now + 3 parsecs": (None, None), "now + 3": (None, None), "yesterday": (None, None), "now + 999999 years": (None, None), "": (None, None),
        "days until dec 25": ("until", "177 days"), "days until 25 December": ("until", "177 days"), "days until 12/25": ("until", "177 days"), "days until 2026-06-29": ("until", "2 days ago"),
        "days until jul 2": ("until", "1 day"), "days until july 1": ("until", "today"), "days until 2026-07-01": ("until", "today"), "days until ju 4": (None, None), "days until feb 30": (None, None), "days until mayhem 3": (None, None),
        "time in Tokyo": ("zone", "23:30"), "time in utc+2": ("zone", "16:30"), "3pm EST in CET": ("zone", "21:00"), "15:30 tokyo in utc": ("zone", "06:30"), "3 pm in cet": ("zone", "17:00"), "12am in utc+1": ("zone", "01:00"),
        "utc to utc+2": ("zone", "16:30"), "now to tokyo": ("zone", "23:30"), "to new york": ("zone", "10:30"), "9:05am Europe/Oslo to utc": ("zone", "07:05"),
        "5 usd to eur": (None, None), "5km to mi": (None, None), "3 in cet": (None, None), "25:00 in cet": (None, None), "3:75pm in cet": (None, None), "time in nowhere": (None, None), "in": (None, None),
    }
    frame = spark.createDataFrame([(p, now, 1) for p in rows] + [(None, now, 1), ("now", None, 1)], "phrase string, now timestamp, days int")
    got = convert.date_phrases(frame, convert.zone_table(spark))
    assert got.columns == ["phrase", "now", "days", "kind", "title"] and got.where("days <> 1").count() == 0
    assert [(r.phrase, r.kind, r.title) for r in got.collect() if r.phrase is None or r.now is None] in ([(None, None, None), ("now", None, None)], [("now", None, None), (None, None, None)])
    assert {r.phrase: (r.kind, r.title) for r in got.where("phrase IS NOT NULL AND now IS NOT NULL").collect()} == rows


def test_versions_and_catalogs(spark):
    rows = [("1.2.0", "1.1.9", True), ("1.10", "1.9", True), ("1.0", "1.0.0", False), ("v2", "1.9", True), ("1.0", "1.0.1", False), ("1.0-b", "1.0", True), ("1.0-b", "1.0-b", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.newer == r.want for r in catalog.compare_versions(df, "a", "b").collect())
    assert catalog.compare_versions(df.where("a = '1.0-b'"), "a", "b", "not_newer").where("newer").count() == 0
    cat = spark.createDataFrame([("b", "2.0", 1, ["k"], "d"), ("a", "1.1", 1, ["Tool"], "d"), ("c", "9", 2, [], "x"), ("e", "1", 1, [], "tool")], "name string, version string, api int, keywords array<string>, description string")
    own = spark.createDataFrame([("a", "1.0", "catalog"), ("b", "2.0", "catalog"), ("c", "1", "catalog")], "name string, version string, origin string")
    assert [tuple(r) for r in catalog.available_updates(cat, own, 1).collect()] == [("a", "1.0", "1.1")]
    state = catalog.catalog_state(cat, own, 1)
    assert {r.name: r.state for r in state.collect()} == {"a": "update", "b": "installed", "c": "incompatible", "e": "not_installed"}
    queries = spark.createDataFrame([(1, "tool"), (2, "")], "query_id int, query_text string")
    assert [(r.query_id, r.name) for r in catalog.search_catalog(state, queries).orderBy("query_id", "place").collect()] == [(1, "a"), (1, "e"), (2, "a"), (2, "b"), (2, "c"), (2, "e")]


def test_permissions_and_packages(spark):
    kind = "struct<network array<string>, kv boolean, clipboard boolean, open_url boolean, paste boolean, spawn array<string>, bus boolean>"
    none = ([], False, False, False, False, [], False)
    rows = [("same", none, none), ("flag", none, ([], True, False, False, False, [], False)), ("host", (["a"], *none[1:]), (["a", "b"], *none[1:])), ("spawn", none, ([], False, False, False, False, ["git"], False)), ("less", (["a"], *none[1:]), none), ("old", None, none)]
    got = {r.name: (r.grows, r.relaxes_sandbox) for r in catalog.permission_growth(spark.createDataFrame(rows, f"name string, old {kind}, new {kind}")).collect()}
    assert got == {"same": (False, False), "flag": (True, False), "host": (True, False), "spawn": (True, True), "less": (False, False), "old": (False, False)}
    sha = hashlib.sha256(b"x").hexdigest()
    files = spark.createDataFrame([("a", "1", b"x"), ("b", "1", b"x"), ("c", "2", b"x"), ("d", "1", b"x"), ("e", "1", b"x")], "name string, version string, content binary")
    cat = spark.createDataFrame([("a", "1", f" {sha.upper()} "), ("b", "1", "0" * 64), ("c", "1", sha), ("d", "1", " ")], "name string, version string, sha256 string")
    assert {r.name: r.reason for r in catalog.verify_packages(files, cat).collect()} == {"a": None, "b": "checksum", "c": "version", "d": None, "e": "unknown"}


def test_ocr_text(spark):
    schema = "path string, seq int, level int, page int, block int, par int, line int, left int, top int, width int, height int, conf double, text string, page_width int, page_height int"
    rows = [("p", 0, 4, 1, 1, 1, 1, 0, 0, 9, 9, -1.0, "", 100, 100), ("p", 1, 5, 1, 1, 1, 1, 10, 10, 20, 10, 95.0, "London", 100, 100), ("p", 2, 5, 1, 1, 1, 1, 40, 10, 20, 10, 90.0, "Bridge", 100, 100), ("p", 3, 5, 1, 1, 1, 1, 70, 10, 20, 10, 10.0, "noise", 100, 100), ("p", 4, 5, 1, 1, 1, 2, 10, 30, 20, 10, 80.0, "Falls", 100, 100), ("q", 0, 5, 1, 1, 1, 1, 1, 1, 1, 1, 80.0, "x", 0, 0)]
    text, boxes = layout.ocr_reading_text(spark.createDataFrame(rows, schema))
    assert {r.path: r.text for r in text.collect()} == {"p": "London Bridge\nFalls", "q": "x"}
    assert [(r.word, r.line, r.x) for r in boxes.orderBy("line", "x").collect()] == [("London", 0, 0.1), ("Bridge", 0, 0.4), ("Falls", 1, 0.1)]


def glyphs(spark, *items):
    return spark.createDataFrame([(1, 0, k, ch, float(x), float(x) + 5, float(y), float(y) + 10) for k, (ch, x, y) in enumerate(items)], "doc_id long, page int, seq int, ch string, left double, right double, top double, bottom double")


def test_page_layout(spark):
    page = glyphs(spark, ("a", 0, 0), ("b", 5, 0), (" ", 10, 0), ("c", 15, 0), ("d", 40, 0), ("e", 0, 20), ("\n", 5, 20), ("f", 0, 20))
    words = layout.page_layout(page).orderBy("word").collect()
    assert [(r.line, r.text) for r in words] == [(0, "ab"), (0, "c"), (0, "d"), (1, "e"), (2, "f")]
    capped = layout.page_layout(page, max_words=2).collect()
    assert len(capped) == 2 and all(r.truncated for r in capped)
    boxes = layout.span_boxes(layout.page_layout(page), query_terms(spark.createDataFrame([(1, "ab"), (2, "zz")], "query_id int, query_text string"))).collect()
    assert [(r.query_id, r.left, r.right) for r in boxes] == [(1, 0.0, 10.0)]


def test_page_layout_of_whole_pages_moves_no_glyphs(spark, tmp_path):
    """A page given whole is laid out as its glyphs are; of the query's turns only texts are shuffled, and one page's are one."""
    page = glyphs(spark, ("a", 0, 0), ("b", 5, 0), (" ", 10, 0), ("c", 15, 0), ("d", 40, 0), ("e", 0, 20), ("\n", 5, 20), ("f", 0, 20), ("", 5, 20))
    boxes = page.groupBy("doc_id", "page").agg(F.collect_list(F.struct("seq", "ch", "left", "right", "top", "bottom")).alias("glyphs"))
    backwards = boxes.withColumn("glyphs", F.reverse("glyphs"))
    for caps in ({}, {"max_glyphs": 4}, {"max_words": 2}):
        expected = sorted(layout.page_layout(page, **caps).collect())
        assert sorted(layout.page_layout(boxes, **caps).collect()) == sorted(layout.page_layout(backwards, **caps).collect()) == expected
    turns = spark.createDataFrame([(1, 0, "user", "ab c\nd"), (1, 1, "user", None), (1, 2, "user", ""), (2, 0, "user", "x" * 50), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    words = QUERIES["page_layout"](spark, str(tmp_path))
    assert [tuple(r)[:5] for r in words.orderBy("doc_id", "word").collect()] == [(1, 0, 0, 0, "ab"), (1, 0, 0, 1, "c"), (1, 0, 1, 2, "d"), (2, 0, 0, 0, "x" * 40), (2, 0, 1, 1, "x" * 10)]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" not in plan and plan.count("Aggregate") == 1


def test_page_layout_of_odd_boxes(spark):
    """Boxes without a side, or with one that is no number, and glyphs that reach back over others."""
    nan = float("nan")
    rows = [
        (1, 0, 0, "a", 0.0, 5.0, None, 10.0), (1, 0, 1, "b", 5.0, 10.0, 0.0, 10.0), (1, 0, 2, "c", 10.0, None, 0.0, 10.0), (1, 0, 3, "d", 15.0, 20.0, 0.0, 10.0),
        (2, 0, 0, "a", 0.0, 50.0, 0.0, 10.0), (2, 0, 1, "b", 5.0, 10.0, 0.0, 10.0), (2, 0, 2, "c", 51.0, 55.0, 0.0, 10.0), (2, 0, 3, "d", None, 60.0, 0.0, 10.0),
        (3, 0, 0, "a", 0.0, nan, 0.0, 10.0), (3, 0, 1, "b", 5.0, 10.0, nan, 10.0), (3, 0, 2, "c", 10.0, 15.0, 0.0, 10.0),
    ]
    boxes = spark.createDataFrame(rows, "doc_id long, page int, seq int, ch string, left double, right double, top double, bottom double")
    words = layout.page_layout(boxes).orderBy("doc_id", "word").collect()
    assert [(r.doc_id, r.line, r.text) for r in words] == [(1, 0, "a"), (1, 0, "bc"), (1, 0, "d"), (2, 0, "abcd"), (3, 0, "a"), (3, 1, "bc")]
    assert [(r.left, r.right) for r in words[:4]] == [(0.0, 5.0), (5.0, 10.0), (15.0, 20.0), (0.0, 60.0)] and words[0].top is None


def test_span_boxes_lay_out_pages_once(spark):
    page = glyphs(spark, *((c, 5 * k, 0) for k, c in enumerate("ab")), ("c", 15, 0), ("-", 20, 0), ("c", 25, 0), ("d", 50, 0), ("d", 55, 0), *((c, 5 * k, 40) for k, c in enumerate("ab")))
    asked = query_terms(spark.createDataFrame([(1, "ab dd"), (2, "dd"), (3, "zz")], "query_id int, query_text string"), stem=False)
    boxes = layout.span_boxes(layout.page_layout(page.withColumn("doc_id", F.lit(None).cast("long"))), asked, stem=False)
    assert sorted((r.query_id, r.span, r.left, r.right, r.top) for r in boxes.collect()) == [(1, 1, 0.0, 10.0, 0.0), (1, 2, 50.0, 60.0, 0.0), (1, 3, 0.0, 10.0, 40.0), (2, 1, 50.0, 60.0, 0.0)]
    assert boxes._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_dominant_hue(spark):
    rows = [("i", 255, 0, 0, 255)] * 3 + [("i", 0, 0, 255, 255)] * 2 + [("i", 255, 255, 255, 255)] * 9 + [("i", 0, 255, 0, 0)] * 9 + [("j", 128, 128, 128, 255)] + [("k", 200, 120, 40, 255)]
    got = {r.image: r for r in layout.dominant_hue(spark.createDataFrame(rows, "image string, r int, g int, b int, a int")).collect()}
    assert got["i"].hue == pytest.approx(0) and got["i"].lightness == 0.5 and "j" not in got
    h, light, s = colorsys.rgb_to_hls(200 / 255, 120 / 255, 40 / 255)
    assert (got["k"].hue, got["k"].saturation, got["k"].lightness) == pytest.approx((h * 360, s, light))


def test_folders_and_natural_order(spark):
    files = spark.createDataFrame([("/a", "b.txt", False), ("/a", "Z", True), ("/a", "A.txt", False), ("/b", "x", False)], "parent string, name string, is_dir boolean")
    assert [r.name for r in layout.folder_listing(files).where("parent = '/a'").orderBy("place").collect()] == ["Z", "A.txt", "b.txt"]
    assert {r.parent: r.summary for r in layout.folder_summary(files).collect()} == {"/a": "1 folder, 2 files", "/b": "1 file"}
    names = spark.createDataFrame([("slide10.xml",), ("slide2.xml",), ("Slide1.xml",), ("slide02b",)], "name string")
    assert [r.name for r in layout.natural_order(names, "name").collect()] == ["Slide1.xml", "slide2.xml", "slide02b", "slide10.xml"]


def test_refresh(spark):
    now = spark.createDataFrame([("/a/x", 1, 1), ("/a/y", 2, 1), ("/b", 1, 1)], "path string, mtime long, size long")
    old = spark.createDataFrame([("/a/x", 1, 1), ("/a/y", 1, 1), ("/gone", 1, 1)], "path string, mtime long, size long")
    assert {r.path: r.status for r in refresh.plan_refresh(now, old).collect()} == {"/a/x": "same", "/a/y": "changed", "/b": "new"}
    assert {(r.path, r.mtime) for r in refresh.apply_refresh(old, now.where("path != '/a/x'")).collect()} == {("/a/x", 1), ("/a/y", 2), ("/b", 1), ("/gone", 1)}
    left, gone = refresh.remove_stale(old, now)
    assert left.count() == 2 and gone.first().removed == 1
    tree = spark.createDataFrame([("/a_b",), ("/a_b/c",), ("/a_b/c/d",), ("/axb/c",), ("/a_bc",)], "path string")
    assert sorted(r.path for r in refresh.remove_subtree(tree, spark.createDataFrame([("/a_b/",)], "path string")).collect()) == ["/a_bc", "/axb/c"]
    assert refresh.text_rows(spark.createDataFrame([("a", " "), ("b", None), ("c", "x")], "path string, text string")).count() == 1
    cache = spark.createDataFrame([(1, 10, "t"), (2, 5, ""), (3, 0, "u"), (9, 1, "dead")], "id long, byte_size long, text string")
    history = spark.createDataFrame([(1, "image", 10), (2, "image", 6), (3, "image", None), (4, "image", 7), (5, "text", 1)], "id long, kind string, byte_size long")
    live, pending = refresh.refresh_derived(cache, history)
    assert sorted(r.id for r in live.collect()) == [1, 2, 3] and sorted(r.id for r in pending.collect()) == [2, 4]


def test_incremental_refresh_equals_rebuild(spark):
    first = spark.createDataFrame([(f"/{k}", k, f"text {k}") for k in range(50)], "path string, mtime long, text string")
    second = spark.createDataFrame([(f"/{k}", k + (k % 3 == 0), f"text {k} {k % 3}") for k in range(20, 70)], "path string, mtime long, text string")
    meta = lambda df: df.select("path", "mtime", F.length("text").cast("long").alias("size"))
    plan = refresh.plan_refresh(meta(second), meta(first)).where("status != 'same'")
    kept, _ = refresh.remove_stale(refresh.apply_refresh(first, second.join(plan, "path", "left_semi")), second)
    assert sorted(map(str, kept.collect())) == sorted(map(str, second.collect()))


def test_index_cost(spark):
    mb = 1 << 20
    files = spark.createDataFrame([("r", f"/r/{k}.pdf", mb) for k in range(100)] + [("r", "/r/a.png", mb), ("r", "/r/a.txt", mb), ("s", "/s/q.bin", mb)], "root string, path string, size long")
    got = {r.root: r for r in refresh.estimate_index_cost(files).collect()}
    assert (got["r"].min_seconds, got["r"].max_seconds, got["r"].n_files, got["r"].n_pdf, got["r"].n_image) == (8, 172, 102, 100, 1)
    assert {r.root: r.max_seconds for r in refresh.estimate_index_cost(files, 2, False, False).collect()} == {"r": 3, "s": 1}
