"""Fuzzy matching, score composition, usage history and spelling."""

import random

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import fuzzy, ranking, spelling, usage
from sparkseek.plans.root_search import Source, Sources, contract, gate_sources


def test_match_tiers(spark):
    rows = [("Zed", "zed", "exact"), ("Café", "cafe", "exact"), ("Search Code", "search co", "prefix"), ("Visual Studio Code", "code", "word_start"), ("naïve-notes.txt", "notes", "word_start"), ("Visual Studio Code", "vsc", "fuzzy"), ("Files", "", "fuzzy"), ("a+b c++", "c++", "word_start"), ("scarf", "car", "fuzzy")]
    got = spark.createDataFrame(rows, "t string, q string, want string").withColumn("tier", fuzzy.match_tier(F.col("t"), F.col("q")))
    assert all(r.tier == r.want for r in got.collect())


def test_alignment_quality():
    assert fuzzy.alignment_quality("code", "code") == 1500 and fuzzy.alignment_quality("xyz", "code") is None
    assert fuzzy.alignment_quality("vsc", "visual studio code") > fuzzy.alignment_quality("vsc", "xvxsxc")
    assert fuzzy.alignment_quality("cd", "code") < fuzzy.alignment_quality("co", "code")


def brute_quality(query, title):
    best = None

    def walk(i, at, score):
        nonlocal best
        if i == len(query):
            best = score if best is None else max(best, score)
            return
        for k in range(at, len(title)):
            if title[k] == query[i]:
                gap = k - at
                join = 0 if i == 0 else (4 if gap == 0 else -3 - (gap - 1))
                walk(i + 1, k + 1, score + join + 16 + 8 * (k == 0 or not title[k - 1].isalnum()))

    walk(0, 0, 0)
    return best


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        q, t = "".join(rng.choices("ab", k=rng.randint(1, 4))), "".join(rng.choices("ab ", k=rng.randint(0, 9)))
        best = brute_quality(q, t)
        want = None if best is None else max(1, min(1500, round(1500 * best / fuzzy.alignment_full(q))))
        assert fuzzy.alignment_quality(q, t) == want


def test_fuzzy_candidates_and_gates(spark):
    titles = spark.createDataFrame([(1, "Visual Studio Code"), (2, "Café"), (3, "Files"), (4, None)], "id int, title string")
    queries = spark.createDataFrame([(1, "VSC"), (2, "cafe"), (3, "zzz"), (4, "")], "query_id int, query_text string")
    got = fuzzy.fuzzy_candidates(queries, titles).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 1), (2, 2)}
    rows = spark.createDataFrame([(1, "s", "abcdef", q, i) for i, q in enumerate([1000, 80, 60, 50, 10])], "query_id int, source string, norm_query string, quality int, id int")
    assert sorted(r.quality for r in fuzzy.quality_gate(rows).collect()) == [60, 80, 1000]
    assert sorted(r.quality for r in fuzzy.quality_gate(rows.where("quality > 50")).collect()) == [60, 80, 1000]
    two = rows.where("quality in (1000, 50)")
    assert [r.quality for r in fuzzy.quality_gate(two).collect()] == [1000]
    thresholds = spark.createDataFrame([("a" * n,) for n in range(1, 8)], "q string").select(fuzzy.quality_threshold(F.col("q"), 1.0).alias("t")).collect()
    assert [round(r.t) for r in thresholds] == [0, 500, 1000, 1167, 1333, 1500, 1500]
    cut = fuzzy.candidate_cut(spark.createDataFrame([(1, "fuzzy", 1500, k) for k in range(384)] + [(1, "exact", 1, 999)], "query_id int, tier string, quality int, id int"))
    assert cut.count() == 128 and cut.where("id = 999").count() == 1


def test_file_rules(spark):
    files = spark.createDataFrame([("a", True, True, False), ("b.zip", False, False, False), (".c", False, True, True), ("d.txt", False, True, True)], "name string, is_dir boolean, previewable boolean, hidden boolean")
    got = {r.name: r.intra for r in fuzzy.file_penalties(files).collect()}
    assert got == {"a": -700_000, "b.zip": -300_000, "d.txt": -200_000}
    assert fuzzy.file_penalties(files, True).count() == 4


CANDIDATE = "query_id int, id string, title string, category string, tier string, quality int, intra double, ext_name string, exec string"


def candidates(spark, *rows):
    return spark.createDataFrame([(1, f"r{i}", f"t{i}", c, tier, q, intra, ext, f"e{i}") for i, (c, tier, q, intra, ext) in enumerate(rows)], CANDIDATE)


def order(df):
    return [r.category for r in df.orderBy(F.desc("score")).collect()]


def test_default_order_of_categories(spark):
    rows = candidates(spark, ("file", "fuzzy", 100, -700_000.0, None), ("dict", "exact", 1500, 0.0, None), ("file", "exact", 100, 0.0, None), ("extension", "fuzzy", 0, 300_000.0, "x"), ("command", "fuzzy", 300, 0.0, None), ("app", "fuzzy", 300, 0.0, None), ("calc", "fuzzy", 0, 0.0, None))
    scored = ranking.compose_score(rows.where("id <> 'r2' and id <> 'r1'"), ranking.resolve_weights(spark))
    assert order(scored) == ["calc", "app", "command", "extension", "file"]
    parts = ranking.explain_scores(ranking.compose_score(rows, ranking.resolve_weights(spark))).where("id = 'r0'").first().breakdown
    assert parts.penalty == 700_000 and parts.base == 2_000_000


def test_weights_orders_and_balance(spark):
    rows = candidates(spark, ("file", "fuzzy", 0, 0.0, None), ("app", "fuzzy", 0, 0.0, None), ("extension", "fuzzy", 0, 0.0, "x"), ("extension", "fuzzy", 0, 0.0, "y"))
    hidden = ranking.resolve_weights(spark, weights={"file": 0})
    assert "file" not in order(ranking.compose_score(rows, hidden)) and "file" in order(ranking.compose_score(rows, hidden, root=False))
    assert order(ranking.compose_score(rows, ranking.resolve_weights(spark, weights={"file": 100})))[1] == "extension"
    assert order(ranking.compose_score(rows, ranking.resolve_weights(spark, order=["file", "bogus", "app", "file"])))[:2] == ["file", "app"]
    ext = ranking.extension_weights(spark, {"x": 0, "y": 100})
    kept = ranking.compose_score(rows, ranking.resolve_weights(spark), ext).where("category = 'extension'").collect()
    assert [(r.ext_name, r.score) for r in kept] == [("y", 3_500_000)]
    for balance, match, use in ((0, 600_000, 0), (50, 300_000, 750_000), (100, 0, 1_500_000)):
        row = ranking.resolve_weights(spark, balance=balance).first()
        assert (row.match_max, row.usage_max) == (match, use)


def test_sparse_fill_pins_and_dedup(spark):
    weights = ranking.resolve_weights(spark)
    few = ranking.compose_score(candidates(spark, *[("app", "fuzzy", 10, 0.0, None)] * 2, *[("dict", "fuzzy", k, 0.0, None) for k in range(8)]), weights)
    assert order(ranking.fill_when_sparse(few)).count("dict") == 5
    many = ranking.compose_score(candidates(spark, *[("app", "fuzzy", 10, 0.0, None)] * 3, ("dict", "fuzzy", 1, 0.0, None)), weights)
    assert "dict" not in order(ranking.fill_when_sparse(many))
    queries = spark.createDataFrame([(1, " Ring")], "query_id int, query_text string")
    pins = spark.createDataFrame([("ring tone", "r2"), ("rin", "r1")], "query string, result_id string")
    assert [r.id for r in ranking.pin_bonus(many, queries, pins).where("pin_bonus > 0").collect()] == ["r2"]
    rows = many.withColumn("title", F.lit("same")).withColumn("exec", F.lit(None).cast("string"))
    assert sorted(r.category for r in ranking.dedup_results(rows).collect()) == ["app", "dict"]
    scores = spark.createDataFrame([("r0", 20.0), ("r1", 400.0), ("r3", 400.0)], "id string, usage_score double")
    got = {r.id: r.usage_bonus for r in ranking.usage_bonus(many, scores).collect()}
    assert got == {"r0": 375_000, "r1": 750_000, "r2": 0, "r3": 0}
    scoped = ranking.scoped_search(candidates(spark, ("file", "exact", 1500, 0.0, None)), ranking.resolve_weights(spark, weights={"file": 0}), "content").first()
    assert scoped.score == 6_000_000 + 7_000_000 + 300_000


def test_usage_scores_against_the_recursion(spark):
    rng = random.Random(2)
    events = [(f"i{rng.randint(0, 4)}", "app", rng.randint(0, 10_000_000)) for _ in range(300)] + [("i0", "tab", 5)]
    got = {r.id: r for r in usage.usage_scores(spark.createDataFrame(events, "id string, kind string, ts long")).collect()}
    for i in {e[0] for e in events}:
        score, last = 0.0, None
        for ts in sorted(t for x, k, t in events if x == i and k == "app"):
            score = (score * 2 ** (-(ts - last) / 86_400 / 14) if last is not None else 0) + 1
            last = ts
        assert got[i].usage_score == pytest.approx(score) and got[i].last_launched == last
    later = usage.usage_scores(spark.createDataFrame([("a", "app", 0)], "id string, kind string, ts long"), as_of=F.lit(14 * 86_400)).first()
    assert later.usage_score == pytest.approx(0.5)


def test_pins_and_stores(spark):
    schema = "query string, result_id string, kind string, title string, subtitle string, created_ms long"
    pins = spark.createDataFrame([("code", "a", "app", "A", None, 1), ("mail", "b", "app", "B", None, 2)], schema)
    commands = spark.createDataFrame([(" CODE ", "a", "app", "A2", None, 9, 1), ("new", "c", "app", "C", None, 5, 2), ("new", "c", "app", "C2", None, 7, 3), ("  ", "d", "app", "D", None, 5, 4)], schema + ", seq int")
    after = usage.pin(pins, commands)
    assert sorted((r.query, r.result_id, r.title, r.created_ms) for r in after.collect()) == [("code", "a", "A2", 1), ("mail", "b", "B", 2), ("new", "c", "C2", 5)]
    assert usage.unpin(after, spark.createDataFrame([("Mail ", "b")], "query string, result_id string")).count() == 2
    assert usage.unpin_matching(after, spark.createDataFrame([("co", "a"), ("ma", "a")], "typed string, result_id string")).count() == 2
    listed = usage.list_pins(pins, spark.createDataFrame([("a",)], "id string")).collect()
    assert [(r.result_id, r.stale) for r in listed] == [("b", True), ("a", False)]
    assert usage.forget_prefix(pins, "a", "result_id").count() == 1
    kv = spark.createDataFrame([("x", "k", "12345"), ("x", "kk", "é"), ("y", "k", "1"), (None, "k", "1")], "extension string, key string, value string")
    row = usage.kv_usage(kv, spark.createDataFrame([("x", "k", "1")], "extension string, key string, value string"), limit=5).first()
    assert (row.bytes, row.refused) == (6, True)
    left = usage.purge_orphans({"kv": (kv, F.col("extension"))}, spark.createDataFrame([("y",)], "name string"))
    assert sorted(str(r.extension) for r in left["kv"].collect()) == ["None", "y"]
    ids = spark.createDataFrame([("ext:b:1",), ("ext:a:2:3",), ("ext:a:9",), ("app:z:1",), ("ext:bad",)], "id string")
    assert [r.name for r in usage.namespaces(ids).collect()] == ["a", "b"]


def osa_distance(a, b):
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


def edited(rng, word, letters, n):
    for _ in range(n):
        i = rng.randrange(len(word)) if word else 0
        kind = rng.randrange(4)
        if kind == 0:
            word = word[:i] + rng.choice(letters) + word[i:]
        elif kind == 1:
            word = word[:i] + word[i + 1 :]
        elif kind == 2:
            word = word[:i] + rng.choice(letters) + word[i + 1 :]
        else:
            word = word[:i] + word[i : i + 2][::-1] + word[i + 2 :]
    return word


def test_edits(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("abc", ""), ("cat", "cab"), ("recieve", "receive"), ("teh", "the"), ("ca", "abc"), ("abcd", "badc"), ("ab", "ba"), ("aab", "aba"), ("é日", "日é")]
    for _ in range(600):
        word = "".join(rng.choices("ab", k=rng.randint(0, 8)))
        pairs.append((word, edited(rng, word, "ab", rng.randint(0, 3))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.edits(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [d if (d := osa_distance(r.a, r.b)) <= 2 else None for r in got]


@pytest.mark.parametrize(("letters", "shortest", "longest"), [("abc", 1, 7), ("ab", 10, 16), ("abcdefé", 20, 60)])
def test_corrections_against_brute_force(spark, letters, shortest, longest):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(shortest, longest))) for _ in range(150)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, rank int")
    typed = sorted({edited(rng, rng.choice(words), letters, rng.randint(0, 3)) for _ in range(60)} | {""})
    got = sorted((r.word, r.correction, r.distance) for r in spelling.corrections(spark.createDataFrame([(w,) for w in typed], "word string"), vocab, limit=10_000).collect())
    want = sorted((t, w, osa_distance(t, w)) for t in typed if t for w in words if osa_distance(t, w) <= (1 if len(t) <= 4 else 2))
    assert got == want and want


def test_swaps_over_the_borders_of_segments(spark):
    known = ["abcdefghijklmno", "abcdefghijklmnop", "k" * 3000 + "xyz" * 1000]
    typed = []
    for word in known:
        one, two = len(word) // 3, len(word) * 2 // 3
        flip = lambda w, at: w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :]
        typed += [flip(word, one), flip(flip(word, one), two), "q" + flip(word, two), flip(word, one)[:-1]]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "word string, rank int")
    plan = spelling.corrections(spark.createDataFrame([(w,) for w in typed], "word string"), vocab)
    got = {(r.word, r.correction) for r in plan.collect()}
    assert {(t, known[k // 4]) for k, t in enumerate(typed)} <= got
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_completions_suggestions_and_fill(spark):
    vocab = spark.createDataFrame([("receive", 1), ("recipe", 2), ("recent", 3), ("cat", 4), ("car", 5)], "word string, rank int")
    ask = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert [r.word for r in spelling.completions(ask("ca").withColumnRenamed("word", "prefix"), vocab).orderBy("place").collect()] == ["cat", "car"]
    assert [r.suggestion for r in spelling.suggest(ask("rec"), vocab).orderBy("place").collect()] == ["rec", "receive", "recipe", "recent"]
    assert [r.suggestion for r in spelling.suggest(ask("recieve"), vocab).orderBy("place").collect()] == ["recieve", "receive", "recipe"]
    assert [r.suggestion for r in spelling.fill_words(ask("cat", "ca", "two words"), vocab, typos=False).collect()] == ["cat"]


def test_definitions(spark):
    entry = 'cat\n  n 1: a small animal; "the cat sat" [syn: {feline}, {puss}]\n     that purrs\n  2: a man\n  v 1: to whip\n'
    rows = spelling.definition_table(spark.createDataFrame([("cat", entry), ("dog", "  n : an animal")], "word string, entry string")).orderBy("word", "part_of_speech", "num").collect()
    assert [(r.word, r.part_of_speech, r.num) for r in rows] == [("cat", "n", 1), ("cat", "n", 2), ("cat", "v", 1), ("dog", "n", 1)]
    assert rows[0].synonyms == ["feline", "puss"] and rows[0].quotes == ["the cat sat"] and "small animal" in rows[0].text and "purrs" in rows[0].text
    assert rows[1].text == "a man"


def test_registered_sources(spark):
    queries = spark.createDataFrame([(1, "abc"), (2, "a"), (3, " ")], "query_id int, query_text string")
    source = Source("x", lambda q: q, always_on=True, min_length=2, scope_min_length=3)
    ids = lambda df: sorted(r.query_id for r in df.collect())
    assert ids(gate_sources(queries, source)) == [1] and ids(gate_sources(queries, source, "x")) == [1, 3]
    assert ids(gate_sources(queries, Source("y", lambda q: q, always_on=False))) == []
    rows = spark.createDataFrame([(1, f"{k}", "é" * 2000, float(k)) for k in range(300)] + [(1, "nan", "t", float("nan")), (1, "big", "t", 1e9)], "query_id int, id string, title string, relevance double")
    got = contract("x", rows).collect()
    assert len(got) == 200 and max(r.intra for r in got) == 300_000 and {len(r.title) for r in got} <= {1024, 1} and all(r.id.startswith("ext:x:") for r in got)
    sources = Sources()
    sources.register_source(source)
    with pytest.raises(ValueError):
        sources.register_source(source)


def test_a_failing_source_leaves_the_others_alone(spark):
    sources = Sources()
    give = lambda q: q.select("query_id", F.lit("a").alias("id"), F.lit("t").alias("title"), F.lit(50.0).alias("relevance"))
    sources.register_source(Source("good", give))
    sources.register_source(Source("unplanned", lambda q: q.select("no such column")))
    sources.register_source(Source("breaks", lambda q: give(q).withColumn("relevance", F.raise_error(F.lit("out of order")).cast("double"))))
    queries = spark.createDataFrame([(1, "ab"), (2, "cd")], "query_id int, query_text string")
    failed = {}
    assert sorted((r.query_id, r.id) for r in sources.candidates(queries, failed=failed).collect()) == [(1, "ext:good:a"), (2, "ext:good:a")]
    assert set(failed) == {"unplanned", "breaks"} and "out of order" in failed["breaks"]
    with pytest.raises(Exception, match="no such column"):
        sources.candidates(queries)
    assert sources.candidates(queries, "breaks", {}) is None
