"""Roots, units, formats and encodings that earlier versions got wrong."""

from sparkseek.operators import classify, convert, ranking, refresh
from sparkseek.sources import files, readers


def test_the_root_folder(spark):
    table = spark.createDataFrame([("/a", 1), ("/b/c.txt", 1), ("rel/d.txt", 1)], "path string, size long")
    root = spark.createDataFrame([("/",)], "path string")
    assert [r.path for r in refresh.remove_subtree(table, root).collect()] == ["rel/d.txt"]
    catalog = spark.createDataFrame([("/a.txt", False, 1), ("/b/c.txt", False, 1), ("/b/d/e.txt", False, 1), ("/b", True, 0)], "path string, is_dir boolean, size long")
    roots = spark.createDataFrame([("/", 2, None)], "root string, depth int, extensions array<string>")
    assert sorted(r.path for r in files.eligible_documents(catalog, roots, ["txt"]).collect()) == ["/a.txt", "/b/c.txt"]
    roots = spark.createDataFrame([("/b/", 1, None)], "root string, depth int, extensions array<string>")
    assert [r.path for r in files.eligible_documents(catalog, roots, ["txt"]).collect()] == ["/b/c.txt"]


def test_short_names_of_units(spark):
    rows = [("min", 30), ("mins", 30), ("hr", 2), ("hrs", 2), ("h", 2), ("hour", 2), ("minutes", 30), ("parsec", 1)]
    df = spark.createDataFrame(rows, "unit string, n int").selectExpr("unit", "n", "timestamp'2024-01-31 10:00:00' as at")
    got = {r.unit: (None if r.shifted is None else r.shifted.strftime("%H:%M"), r.label) for r in convert.shift_dates(df).collect()}
    assert {got[u][0] for u in ("min", "mins", "minutes")} == {"10:30"} and {got[u][0] for u in ("hr", "hrs", "h", "hour")} == {"12:00"} and got["parsec"][0] is None
    assert got["h"][1] == "Wed, Jan 31 2024 12:00"


def test_image_formats_of_any_name(spark):
    labels = ["83 KiB png 1068x904", "2 MiB PNG 10x20", "1 B avif", "12 KiB 5x6", "jxl", "3 GiB"]
    rows = [(k, f"[[ binary data {label} ]]") for k, label in enumerate(labels)]
    got = {r.id: r.format for r in classify.classify_history(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert got == {0: "png", 1: "png", 2: "avif", 3: None, 4: "jxl", 5: None}


def test_a_text_file_of_another_encoding_does_not_fail_the_job(spark, tmp_path):
    (tmp_path / "good.txt").write_text("grün\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes("grün".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": ("grün\n", None), "bad.txt": (None, "not UTF-8")}


def test_fill_when_sparse(spark):
    rows = [(1, "a", "app", 5.0), (1, "b", "dict", 9.0), (2, "a", "app", 1.0), (2, "b", "app", 1.0), (2, "c", None, 1.0), (2, "d", "dict", 1.0), (3, "x", "dict", 1.0), (3, "y", "dict", 2.0), (None, "n", "dict", 1.0)]
    got = ranking.fill_when_sparse(spark.createDataFrame(rows, "query_id long, id string, category string, score double"), at_most=1)
    assert sorted((r.query_id or 0, r.id) for r in got.collect()) == [(0, "n"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "y")]


def test_substrings_meet_on_grams(spark):
    import random

    from sparkseek.operators.substring import substring_matches

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\nü😀") for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "ab" * 3000]
    asked = ["", "a", "ü", "😀", "ab", "a\n", "abc", "😀ü", "ba b", "zz", "ab" * 20, "b c", None]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    queries = spark.createDataFrame([*enumerate(asked)], "query_id long, q string")
    found = substring_matches(rows, queries)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(k, i) for k, q in enumerate(asked) for i, t in enumerate(texts) if q is not None and t is not None and q in t]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substring_matches(rows, queries.limit(0)).count() == 0 and substring_matches(rows.limit(0), queries).count() == 0


def test_fuzzy_candidates_against_the_plain_alignment(spark):
    import random

    from sparkseek.operators import fuzzy

    rng = random.Random(8)
    titles = ["".join(rng.choice("abc -é_%1") for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["", " ", "a" * 300]
    asked = ["a", "ab", "a b", "cab", "É1", "%", "_a", "zz", "a" * 20, "abcabc", " ", "b-"]
    plain = lambda q, t: fuzzy.alignment_quality(q, t) or 0
    pairs = [(q.replace(" ", ""), t) for q in asked for t in titles]
    assert fuzzy.alignment_qualities(*map(list, zip(*pairs, strict=True))).tolist() == [plain(q, t) for q, t in pairs]
    found = fuzzy.fuzzy_candidates(spark.createDataFrame([*enumerate(asked)], "query_id long, query_text string"), spark.createDataFrame([*enumerate(titles)], "id long, title string"))
    fold = lambda s: s.strip().lower().replace("é", "e")
    want = {(k, i, plain(fold(q).replace(" ", ""), t.lower().replace("é", "e"))) for k, q in enumerate(asked) if fold(q) for i, t in enumerate(titles)}
    assert {(r.query_id, r.id, r.quality) for r in found.collect()} == {w for w in want if w[2]}
