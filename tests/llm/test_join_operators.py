"""Jaccard join, components, decontamination, LM scoring, top-k, WARC and the pipeline on small tables."""

import gzip
import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import components, decontaminate, lm_scoring, ngram_join, topk, warc


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_groups(rows, width, num, den):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, bases=6, copies=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for b in range(bases):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 160))))
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 12 + 1))):
                at = int(rng.integers(0, len(text)))
                text[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(text[: len(text) - int(rng.integers(0, 4))]))
    passage = " ".join(rng.choice(vocabulary, 40))
    rows += [f"{passage} {' '.join(rng.choice(vocabulary, 30))}" for _ in range(20)]
    return list(enumerate(rng.permutation(np.array(rows, dtype=object)).tolist()))


@pytest.mark.parametrize(("seed", "width", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 60, 100)])
def test_jaccard_groups_against_brute_force(spark, seed, width, num, den):
    rows = near_copies(seed)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs_of(spark, rows), width, num, den).collect()}
    assert got == brute_groups(rows, width, num, den)


@pytest.mark.parametrize("boundary", [0, 10_000])
def test_jaccard_groups_do_not_depend_on_the_boundary(spark, boundary, monkeypatch):
    monkeypatch.setattr(ngram_join, "cheapest_boundary", lambda sets: boundary)
    rows = near_copies(7, bases=4)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs_of(spark, rows), 4, 85, 100).collect()}
    assert got == brute_groups(rows, 4, 85, 100)


def test_jaccard_edge_cases(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "one two", 0), (5, "ONE  two", 0), (6, "one two three", 0), (7, long, 0), (8, long + " end", 0), (9, "a b c d e f", 0), (9, "a b c d e f", 0), (None, "a b c d e f", 0)]
    got = ngram_join.jaccard_groups(docs_of(spark, rows, ", n int"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 11
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29_996, 7), (8, 29_997, 7), (9, 2, 9), (None, 2, None)}
    assert ngram_join.jaccard_groups(docs_of(spark, [])).count() == 0
    twice = ngram_join.jaccard_groups(docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")]))
    assert {r[2] for r in twice.collect()} == {1}


def templated(groups, copies, common):
    """Groups of near copies that share a template which makes up much of them, but are not alike each other, with a
    passage that all documents hold, and many copies of one document."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.integers(0, 5000))}"
    passage, template = [word() for _ in range(common)], [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        own = [word() for _ in range(16)]
        for _ in range(copies):
            text = [*passage, *own[:8], *template, *own[8:]]
            text[int(rng.integers(0, len(text)))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(3)]) for _ in range(40)] + [" ".join(template)] * 1200
    return list(enumerate(rows))


def test_jaccard_groups_with_a_template_a_common_passage_and_many_copies(spark, monkeypatch):
    rows = templated(60, 3, 6)
    got, common, keepers = ngram_join.shared_shingles, [], []
    monkeypatch.setattr(ngram_join, "shared_shingles", lambda *a: (common.append(len(a[5])), keepers.append(len(a[6])), got(*a))[2])
    groups = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs_of(spark, rows), 4, 85, 100).collect()}
    assert groups == brute_groups(rows, 4, 85, 100)
    assert common[0] > 0 and keepers == [1]  # shingles of the passage are not counted, and the copies go once


def test_jaccard_pairs_of_templated_groups_grow_in_proportion(spark, monkeypatch):
    compared = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    counts = []
    for groups in (30, 150):
        compared.clear()
        ngram_join.jaccard_groups(docs_of(spark, templated(groups, 4, 6)), 4, 85, 100).count()
        counts.append(sum(compared))
    assert counts[1] <= 6 * counts[0]


@pytest.mark.parametrize("light", [0, 3])
def test_jaccard_groups_do_not_depend_on_what_is_light(spark, light, monkeypatch):
    monkeypatch.setattr(ngram_join, "_LIGHT", light)
    monkeypatch.setattr(ngram_join, "cheapest_boundary", lambda sets: 60)
    rows = near_copies(9, bases=5)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs_of(spark, rows), 4, 85, 100).collect()}
    assert got == brute_groups(rows, 4, 85, 100)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 3000 + k) for k in range(200)] + [(5, 5)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination

ITEM = "Maria has 5 apples and gives 2 apples to her friend Tom before she walks 3.5 km to the market with Tom."
PLAIN = "the river runs by the old mill and turns its wheel all day and all night long"


def hits(spark, *texts, items=(ITEM, PLAIN), **how):
    found = decontaminate.contaminated(docs_of(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), **how)
    return sorted((r.doc_id, r.item_id, r.reworded) for r in found.collect())


def test_decontamination_finds_copies_and_reworded_items(spark):
    reworded = "Anna has 7 apples and gives 4 apples to her friend Bob before she walks 12 miles to the market with Bob."
    inconsistent = reworded.replace("with Bob", "with Jim")
    got = hits(spark, f"Some words first. {ITEM} Then more.", f"Some words. {reworded} ok", inconsistent, ITEM.lower(), PLAIN.upper().replace(" ", "\n"), "the river runs by the old mill that is all", None, "", "x " * 50_000 + PLAIN)
    assert got == [(0, 0, False), (1, 0, True), (3, 0, False), (4, 1, False), (8, 1, False)]


def test_decontamination_of_copies_with_one_edited_value(spark):
    edited = ITEM.replace("with Tom", "with Jim")
    item = "The first road is 5 km long and the second road is 7 km long and ends by the old mill"
    got = hits(spark, edited, item.replace("7 km", "7 KM"), item.replace("5 km", "6 km").replace("7 km", "8 KM"), items=(ITEM, item))
    assert got == [(0, 0, True), (1, 1, False), (2, 1, True)]


def test_decontamination_of_reworded_short_and_dense_items(spark):
    short, dense = "What is 12 times 7?", "Add 5 km 20 m, 7 km 30 m, 9 km 40 m and 6 km 50 m, then 8 km 10 m"
    other = "Add 4 km 21 m, 3 km 31 m, 2 km 41 m and 1 km 51 m, then 6 km 11 m"
    texts = "So what is 31 times 4? Well.", f"We start. {other} is it.", "What is 31 plus 4?", "from 4 km 21 m, 3 km 31 m, 2 km 41 m and 1 km", dense
    assert hits(spark, *texts, items=(short, dense)) == [(0, 0, True), (1, 1, True), (4, 1, False)]


def test_decontamination_of_a_part_of_a_long_item(spark):
    item = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    words = item.split()
    got = hits(spark, " ".join(words[20:33]), " ".join(words[20:32]), " ".join(words[:40]), items=(item,))
    assert got == [(0, 0, False), (2, 0, False)]


def test_decontamination_in_blocks_short_items_and_repeated_rows(spark, monkeypatch):
    once = hits(spark, ITEM, PLAIN, "a short item here ok", items=(ITEM, PLAIN, "a short item here", "tiny", None, ""))
    monkeypatch.setattr(decontaminate, "_BLOCK", 5)
    assert hits(spark, ITEM, PLAIN, "a short item here ok", items=(ITEM, PLAIN, "a short item here", "tiny", None, "")) == once == [(0, 0, False), (1, 1, False), (2, 2, False)]
    items = spark.createDataFrame([(1, PLAIN, "x")], "item_id long, text string, hash string")
    twice = decontaminate.contaminated(docs_of(spark, [(1, PLAIN, 3), (1, PLAIN, 4), (None, PLAIN, 5)], ", at int"), items)
    assert sorted((r.doc_id or 0, r.item_id) for r in twice.collect()) == [(0, 1), (1, 1)]
    assert hits(spark, PLAIN, items=()) == []
    assert decontaminate.contaminated(docs_of(spark, []), items).count() == 0


# LM scoring


@pytest.mark.parametrize("common", [1, 30])
def test_cross_entropy_against_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_COMMON", common)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 80))) if x < 500), [True, False, None][k % 3]) for k in range(150)] + [(900, None, True), (901, "", False)]
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs_of(spark, rows, ", target boolean").repartition(3)).collect()}
    assert len(got) == len(rows)
    texts = {d: (t or "").split() for d, t, _ in rows}
    target = {d: bool(x) for d, _, x in rows}
    size, mass = len({w for t in texts.values() for w in t}), 10.0
    pairs, contexts = defaultdict(Counter), defaultdict(Counter)
    for d, t in texts.items():
        pairs[target[d]].update(zip([None, *t[:-1]], t, strict=False))
        contexts[target[d]].update([None, *t[:-1]] if t else [])
    for d, t in texts.items():
        if not t:
            assert got[d].n_tokens == 0 and got[d].difference is None
            continue
        loss = {}
        for side in (True, False):
            p, c = Counter(pairs[side]), Counter(contexts[side])
            if target[d] == side:
                p.subtract(zip([None, *t[:-1]], t, strict=True))
                c.subtract([None, *t[:-1]])
            loss[side] = -sum(math.log((p[v, w] + mass / size) / (c[v] + mass)) for v, w in zip([None, *t[:-1]], t, strict=True)) / len(t)
        assert got[d].n_tokens == len(t)
        assert got[d].target_loss == pytest.approx(loss[True], abs=0.01) and got[d].other_loss == pytest.approx(loss[False], abs=0.01)


def test_cross_entropy_of_empty_and_hot_tables(spark):
    assert lm_scoring.cross_entropy_difference(docs_of(spark, [], ", target boolean")).count() == 0
    nameless = lm_scoring.cross_entropy_difference(docs_of(spark, [(None, "a b", True), (None, "c d", False), (None, None, None)], ", target boolean")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in nameless) == [(None, 0), (None, 2), (None, 2)]
    same = lm_scoring.cross_entropy_difference(docs_of(spark, [(1, "a b c", True, 1)] * 400 + [(2, "a b d " * 5000, False, 2)], ", target boolean, row int")).collect()
    assert len(same) == 401 and len({r.difference for r in same if r.doc_id == 1}) == 1
    assert max(r.difference for r in same if r.doc_id == 1) < min(r.difference for r in same if r.doc_id == 2)


# Top-k


def vectors_of(spark, rows):
    return topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def brute_topk(rows, k):
    sound = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sound).items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out += [(q, rank + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 2048])
def test_topk_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for k in range(260)]
    rows += [(300 + k, rows[40][1]) for k in range(40)]  # ties
    rows += [(401, None), (402, [None] * 12), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (None, rows[0][1]), (406, [1.0, 2.0]), (420, [1.0, 2.0]), (440, []), (441, [])]
    vectors = vectors_of(spark, rows).repartition(5)
    got = topk.top_k(vectors, vectors.where("id % 20 = 0"), k=20, block=block)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 20)


def test_topk_large_numbers_few_candidates_and_empty_tables(spark):
    rows = [(0, [1e9, -3.0]), (1, [1e9, 2.0]), (2, [-1e9, 7.0])]
    vectors = vectors_of(spark, rows)
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("id = 0")).collect())) == brute_topk(rows, 20)
    huge = [(0, [1e9, -3.0]), (1, [1e9, 2.0]), (2, [2e9, 7.0]), (3, [3e38, 1.0]), (4, [-3e38, 0.0]), (5, [-2e38, 0.0]), (6, [3e38, 2.0]), (7, [3e38, 2.0]), (20, [3e38, -3e38])]
    found = topk.top_k(vectors_of(spark, huge).repartition(3), vectors_of(spark, huge).where("id % 20 = 0"), k=6)
    assert sorted(map(tuple, found.collect())) == brute_topk(huge, 6)
    twice = vectors_of(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (1, [3.0])])
    assert sorted(map(tuple, topk.top_k(twice, twice.where("id = 0")).collect())) == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 128), (0, 3, 1, 64 * 128)]
    alone = vectors_of(spark, [(20, [1.0])])
    assert topk.top_k(alone, alone).count() == 0
    none = vectors_of(spark, [])
    assert topk.top_k(none, none).count() == 0


# WARC


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    big, small = "é" * 600, "é" * 499
    rows = [(1, "http://a", big, "x"), (2, "http://b\r\nX: y", big, "x"), (3, None, big, "x"), (4, "u", small, "x"), (5, "u", small, "x"), (6, "u", None, "x"), (7, "u", "", "x"), (None, "u", big, "x"), (8, "u", "z" * 3_000_000, "x"), (8, "u", "z" * 3_000_000, "x"), (9, "u", "\r\n\r\nWARC/1.1\r\n", "x")]
    got = warc.archive_pages(spark, pages_of(spark, rows), str(tmp_path / "w"))
    found = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect())
    assert all(r.sound for r in got.collect())
    expected = Counter()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        to = {big: "3"}.get(html) if page != 3 else None
        expected[(None if page is None else str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to)] += 1
    assert found == expected


def test_warc_members_stand_alone_and_files_are_cut(spark, tmp_path):
    rows = [(k, "u", f"page {k} " * 50, "x") for k in range(200)]
    whole = warc.write_archives(warc.plan_records(pages_of(spark, rows)), str(tmp_path / "whole"), file_bytes=20_000)
    assert whole.count() > 3 and whole.agg(F.sum("n_records")).first()[0] == 200
    index = warc.normalise(whole, str(tmp_path / "normal")).collect()
    assert len(index) == 200 and all(r.error is None for r in index)
    for r in index[:10]:
        with open(r.archive, "rb") as f:
            f.seek(r.offset)
            text = gzip.decompress(f.read(r.length)).decode()
        assert text.startswith("WARC/1.1\r\n") and f"WARC-Record-ID: {r.record_id}" in text and text.endswith("\r\n\r\n")
    assert not [x for x in os.listdir(tmp_path / "normal") if x.startswith("_")]


def test_warc_two_attempts_of_a_task_are_not_mixed(spark, tmp_path):
    rows = [(k, "u", f"page {k} " * 50, "x") for k in range(120)]
    records = warc.plan_records(pages_of(spark, rows))
    write = lambda order: warc.write_archives(records.orderBy(order).coalesce(1), str(tmp_path / "whole"), file_bytes=20_000)
    lost, whole = write(F.col("id")), write(F.desc("id"))
    names = {r.archive for r in lost.collect()}, {r.archive for r in whole.collect()}
    assert not names[0] & names[1] and len(names[0] | names[1]) == len(os.listdir(tmp_path / "whole"))
    warc.normalise(whole, str(tmp_path / "normal"))
    index = warc.normalise(whole, str(tmp_path / "normal"))  # the other attempt's files lie beside
    assert sorted(int(r.page_id) for r in warc.read_records(index).collect()) == [*range(120)]
    listed = [json.loads(line) for r in index.select("archive").distinct().collect() for line in open(f"{r.archive}.idx")]
    assert Counter((x["archive"], x["offset"]) for x in listed) == Counter((r.archive, r.offset) for r in index.collect())
    assert whole.agg(F.sum("ids")).first()[0] == sum(zlib.crc32(f"<urn:page:{k}>".encode()) for k in range(120))


def test_warc_damaged_files_give_an_error_row(spark, tmp_path):
    rows = [(k, "u", hashlib.sha256(str(k).encode()).hexdigest() * 40, "x") for k in range(300)]
    path = warc.write_archives(warc.plan_records(pages_of(spark, rows).coalesce(1)), str(tmp_path / "whole")).first().archive
    data = open(path, "rb").read()
    for name, content in (("cut", data[: len(data) // 2]), ("bad", b"not gzip"), ("twice", data + data)):
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
    names = [(str(tmp_path / f"{n}.warc.gz"),) for n in ("cut", "bad", "twice", "missing")]
    index = warc.normalise(spark.createDataFrame(names, "archive string"), str(tmp_path / "n"))
    by = {n: index.where(F.col("archive").contains(hashlib.sha1(a.encode()).hexdigest()[:16])) for (a,), n in zip(names, ("cut", "bad", "twice", "missing"), strict=True)}
    count = {n: (x.where("error IS NULL").count(), x.where("error IS NOT NULL").count()) for n, x in by.items()}
    assert 0 < count["cut"][0] < 300 and count["cut"][1] == 1
    assert count["bad"] == (0, 1) and count["missing"] == (0, 1) and count["twice"] == (600, 0)
    assert warc.archive_pages(spark, pages_of(spark, [])).count() == 0


def test_warc_long_headers_and_errors_of_the_file_system(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "a", "x"), (2, "http://a/" + "b" * 3_000_000, "c", "x"), (3, "u", "d", "x")]
    got = warc.archive_pages(spark, pages_of(spark, rows).coalesce(1), str(tmp_path / "w"))
    assert sorted(r.page_id for r in got.collect()) == ["1", "2", "3"]
    whole = warc.write_archives(warc.plan_records(pages_of(spark, rows)), str(tmp_path / "whole"))
    (tmp_path / "folder.warc.gz").mkdir()
    with pytest.raises(Exception, match="folder.warc.gz"):  # an error of reading, and no sign of damage
        warc.normalise(spark.createDataFrame([(str(tmp_path / "folder.warc.gz"),)], "archive string"), str(tmp_path / "n"))
    path = whole.first().archive
    data = open(path, "rb").read()
    cut_off = lambda *a, **k: (open(path, "wb").write(data[: len(data) // 2]), whole)[1]
    monkeypatch.setattr(warc, "write_archives", cut_off)
    with pytest.raises(RuntimeError, match="records were archived"):
        warc.archive_pages(spark, pages_of(spark, rows), str(tmp_path / "c"))


# Queries and pipeline


def test_queries_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from sparkseek.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, data)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert Counter(map(str, map(tuple, got.select(*columns).collect()))) == Counter(map(str, want)), name


def test_pipeline_stages_decide_as_brute_force_does(spark):
    import corpus_pipeline as pipeline

    from sparkseek.llm.common import cut

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "1234 !!", "en", "s", 7), (90_002, None, "en", "s", None), (90_003, "", None, None, 0)], docs.schema)
    docs = docs.union(extra)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, data))
        kept[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["language_id"]
    assert ids(before) - ids(after) == {90_001, 90_002, 90_003}
    before, after = kept["line_dedup"]
    assert ids(before) == ids(after)
    before, after = kept["jaccard_join"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert ids(after) == {d for d, (_, c) in groups.items() if d == c}
    before, after = kept["decontaminate"]
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert ids(before) - ids(after) == {r.doc_id for r in before.collect() if any(i in " ".join(re.findall(r"\w+", r.text.lower())) for i in items)}
    before, after = kept["mix_sources"]
    taken = after.agg(F.sum("taken")).first()[0]
    size = sum(len(words_of(r.text)) for r in before.collect())
    assert abs(taken - 1.5 * size) <= 40


def test_pipeline_leaves_its_result_only(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    from sparkseek.functions import storage

    monkeypatch.setattr(storage, "shared_top", lambda spark: str(tmp_path))
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(list(tmp_path.iterdir())) == 1
