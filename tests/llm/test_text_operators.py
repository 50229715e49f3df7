"""Line dedup, license scans, quality, language ID and mixing on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import kernels, language_id, licenses, line_dedup, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# Kernels


@pytest.mark.parametrize("block", [16, 64, 1 << 21])
def test_tokens_agree_with_a_regular_expression_at_any_block_size(block, monkeypatch):
    monkeypatch.setattr(kernels, "_BLOCK", block)
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "Hello  WORLD\tfoo", "été ß\n a", "w" * 300, " "] + ["".join(rng.choice(list("ab  \n\tXé"), rng.integers(0, 50))) for _ in range(200)]
    column = pa.array(texts).slice(1)
    hashed, rows = kernels.tokens(*kernels.buffers(column))
    words = [(w, i) for i, t in enumerate(texts[1:]) for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert rows.tolist() == [i for _, i in words]
    by_word = defaultdict(set)
    for value, (word, _) in zip(hashed.tolist(), words, strict=True):
        by_word[word].add(value)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({min(v) for v in by_word.values()}) == len(by_word)


def test_shingle_sets_of_short_rows():
    sets = list(kernels.shingle_sets(pa.array(["a b c", "A  b c", "a b", None, " ", "a b c d e"]), 4))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 2]
    assert sets[0] == sets[1] and sets[0] != sets[2]


# Line dedup

LONG = "this line is long enough to count"


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and d != max(holders[key(x)]))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_line_dedup_against_brute_force(spark):
    rows = [(1, f"{LONG}\nown one"), (2, f"  {LONG.upper()}\t\n\nsame\n"), (3, f"x\n{LONG}\n{LONG}\ny"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "\n\n"), (9, f"{LONG}é"), (10, "É" * 20), (11, "É" * 20), (12, "é" * 20)]
    got = line_dedup.dedup_lines(docs_of(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == brute_lines(rows)


def test_line_dedup_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, LONG, 5, "a"), (1, LONG, 6, "b"), (2, LONG, 7, "c"), (3, LONG, 8, "d"), (None, LONG, 9, "e")]
    got = line_dedup.dedup_lines(docs_of(spark, rows, ", pos int, n_lines string"))
    assert got.columns == ["doc_id", "pos", "text", "n_lines", "n_dropped"]
    assert sorted((r.pos, r.text, r.n_dropped) for r in got.collect()) == [(5, "", 1), (6, "", 1), (7, "", 1), (8, LONG, 0), (9, "", 1)]
    two = line_dedup.dedup_lines(docs_of(spark, rows[:3], ", pos int, n_lines string"))  # two documents only
    assert {r.text for r in two.collect()} == {LONG}


def test_line_dedup_of_very_many_lines_and_of_an_empty_table(spark):
    many = "\n".join([LONG, *map(str, range(50_000)), LONG])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, [(1, many), (2, LONG), (3, LONG)])).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[1].text) == (50_002, 2, "\n".join(map(str, range(50_000))))
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


# License scans


def scan(spark, *texts):
    rows = licenses.scan_licenses(docs_of(spark, list(enumerate(texts)))).collect()
    return sorted((r.doc_id, r.license) for r in rows)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_license_texts_headers_and_tags(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    got = scan(spark, f"MIT License\n\nCopyright (c) 2020 A B\n\n{MIT}", apache, gpl, "// SPDX-License-Identifier: MIT\nint main() {}", "No words of that kind. MIT is a school.", None, "", "Released under the MIT License.")
    assert got == [(0, "MIT"), (1, "Apache-2.0"), (2, "GPL-3.0-or-later"), (3, "MIT"), (7, "MIT")]


def test_license_headers_of_source_files_count_once_and_tags_keep_versions_apart(spark):
    header = "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */\nint x;"
    tags = "# SPDX-License-Identifier: GPL-3.0-or-later\n\n# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+"
    got = scan(spark, header, tags, "Released under the MIT License\nReleased under the MIT License", "This OR that. SPDX-License-Identifier: BSD-3-Clause")
    assert got == [(0, "Apache-2.0"), (1, "Apache-2.0"), (1, "GPL-2.0-only"), (1, "GPL-2.0-or-later"), (1, "GPL-3.0-or-later"), (1, "MIT"), (2, "MIT"), (2, "MIT"), (3, "BSD-3-Clause")]


def test_licenses_over_long_gaps_and_in_long_expressions(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from sparkseek.llm import queries

    tags = ["MIT", "Apache-2.0", "ISC", "GPL-2.0+", "Unlicense"]
    many = [tags[k % 5] for k in range(1000)]
    texts = [
        "Released under the" + " " * 900 + "MIT License", "Released under the" + " \t" * 3000 + "\n" + "-" * 5000 + "\n" + " " * 2000 + "MIT License.",
        "// SPDX-License-Identifier: " + " OR ".join(many), "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT",
        "\n*".join(["x"] * 300) + "\nMIT License", "\n".join(["Released under the", *["*"] * 500, "MIT License"]), "*\n" * 2000, "AND MIT OR SPDX", None, "",
    ]
    docs_of(spark, list(enumerate(texts))).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op8_license_scan(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.license, r.n_matches) for r in rows)
    thousand = sorted((2, licenses.SPDX[t], 200) for t in tags)
    assert got == sorted([(0, "MIT", 1), (1, "MIT", 1), *thousand, (3, "GPL-2.0-only", 1), (3, "MIT", 1), (5, "MIT", 1)] + [r for r in got if r[0] == 4])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(queries.ORACLE_SQL["op8_license_scan"]).fetchall()) == got


def test_license_rules_need_their_sentences_in_order_and_near(spark):
    first, second = MIT.split("\n\n")[0], MIT.split("\n\n")[2]
    notice = MIT.split("\n\n")[1]
    apart = "One. Two. Three. Four. Five."
    got = scan(spark, f"{second}\n\n{notice}\n\n{first}", f"{first}\n\n{apart}\n\n{notice}\n\n{second}", f"{first}\n\nOne.\n\n{notice}\n\n{second}", "prose that has no end\nLicensed under CC BY-NC 4.0.\nmore prose. Released under the MIT License. And again: Released under the MIT License.")
    assert got == [(2, "MIT"), (3, "CC-BY-NC-4.0"), (3, "MIT"), (3, "MIT")]


def test_license_scan_of_long_texts_repeated_rows_and_other_columns(spark):
    text = "word " * 60_000 + "\nReleased under the MIT License.\n" + "x\n" * 30_000
    rows = [(1, text, "a"), (1, text, "a"), (None, "Released under the MIT License.", "b")]
    got = licenses.scan_licenses(docs_of(spark, rows, ", license string")).collect()
    assert sorted((r.doc_id or 0, r.license, r.rule) for r in got) == [(0, "MIT", "mit_named"), (1, "MIT", "mit_named")]
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


# Quality


def test_quality_learns_and_scores_edge_cases(spark):
    good, bad = "the house of the old man is near the river and the trees", "WIN!!! $$$ click *** now!!! $$$ free *** money!!!"
    rows = [(k, f"{good if k % 2 else bad} {k}") for k in range(200)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, None), (None, 1), (10_000, 1)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels)
    again = quality.train_quality(docs.repartition(7), labels)
    assert np.array_equal(weights, again)
    more = docs_of(spark, [(1, good, 9.0), (2, bad, 9.0), (3, None, 9.0), (4, "", 9.0), (5, good * 3000, 9.0), (1, good, 9.0)], ", score double")
    got = quality.score_quality(more, weights)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 6
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[1] > 0.9 and score[5] > 0.9 and score[2] < 0.1 and score[3] == score[4] and all(0 <= s <= 1 for s in score.values())


def test_quality_without_labels_or_rows(spark):
    weights = quality.train_quality(docs_of(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score_quality(docs_of(spark, [(1, "a b")]), weights).collect()] == [0.5]
    assert quality.score_quality(docs_of(spark, []), weights).count() == 0


def test_quality_of_held_out_documents(spark):
    from sparkseek.llm.queries import QUERIES

    got = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.93
    assert got.count() == 1000 and got.where("predicted != CASE WHEN score >= 0.7 THEN 1 ELSE 0 END").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


# Language ID


def test_bundles_against_a_plain_loop():
    texts = ["Ab c", "", None, "123 !", "**Ça va?", "x", "ab" * 100]
    bundler = language_id.Bundler(64)
    got = bundler(texts)
    for text, vector in zip(texts, got, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        letters = [ord(c) for c in " " + " ".join(words) + " "] if words else []
        codes = [a << 32 | b << 16 | c for a, b, c in zip(letters, letters[1:], letters[2:], strict=False)]
        plain = language_id.trigram_vectors(np.array(codes), 64).sum(axis=0) if codes else np.zeros(64)
        assert np.array_equal(plain, vector), text


def test_bundles_of_long_texts_and_with_a_small_vocabulary(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 40
    whole = language_id.Bundler(64)([text])
    monkeypatch.setattr(language_id, "_KEPT", 20)
    assert np.array_equal(language_id.Bundler(64)([text]), whole)


def test_language_id_edge_cases(spark):
    english, german = "the cat and the dog are in the house with the others", "der hund und die katze sind mit den anderen in dem haus"
    rows = [(k, english if k % 2 else german, "en" if k % 2 else "de") for k in range(40)] + [(90, "x", None), (None, "y", "en")]
    prototypes = language_id.train_prototypes(docs_of(spark, rows, ", lang string"))
    assert sorted(prototypes) == ["de", "en"]
    more = docs_of(spark, [(1, "the others and the house", "q"), (2, "die anderen und der hund", "q"), (3, None, "q"), (4, "12 !?", "q"), (5, "", "q"), (6, english * 30_000, "q"), (1, "the others and the house", "q")], ", score string")
    got = language_id.identify(more, prototypes)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.count() == 7
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert [r.lang_pred for r in language_id.identify(docs_of(spark, [(1, "abc")]), {}).collect()] == ["und"]
    assert language_id.train_prototypes(docs_of(spark, [], ", lang string")) == {}
    with pytest.raises(ValueError):
        language_id.train_prototypes(docs_of(spark, rows, ", lang string"), max_languages=1)


def test_pipeline_drops_texts_of_an_unlearned_script_and_keeps_short_clean_ones(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(0x430 + k) for k in rng.integers(0, 32, rng.integers(2, 10)))
    foreign = [(1_000_000 + k, " ".join(word() for _ in range(200))) for k in range(60)]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    short = [(2_000_000 + i, " ".join(t.split()[3:11])) for lang in ("de", "en", "es", "fr") for i, t in [(i, t) for i, t, of in rows if of == lang][:25]]
    more = spark.createDataFrame([(i, t, None) for i, t in foreign + short], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.select("doc_id", "text", "lang").union(more), "").select("doc_id").collect()}
    assert not kept & {i for i, _ in foreign}
    assert len(kept & {i for i, _ in short}) >= 98
    assert {i for i, t, _ in rows if t and re.search(r"[a-zA-Z]", t)} <= kept


def test_language_of_held_out_documents(spark):
    from sparkseek.llm.queries import QUERIES

    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


# Mixing


def brute_mix(rows, weights=(5, 2, 1), share=1.5, repeats=2, seed=17):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        level = (share * sum(size) - sum(repeats * total[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        over = {s for s in order if s not in full and weight[s] * level >= repeats * total[s]}
        if not over:
            break
        full |= over
    target = {s: float(repeats * total[s]) if s in full else weight[s] * level for s in order}
    out, at, stream = {}, Counter(), []
    key = lambda k: int(hashlib.md5(f"{seed}|{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:15], 16)
    for k in sorted(range(len(rows)), key=lambda k: (key(k), rows[k][0] is not None, rows[k][0], size[k])):
        s = rows[k][2]
        for copy in range(repeats):
            first = at[s] + copy * total[s]
            ends = {first + size[k]} | ({int(target[s]), int(target[s]) + 1} if first < target[s] < first + size[k] else set())
            for end in sorted(ends - {first}):
                stream.append((end / target[s], order.index(s), end, k, end - first))
                first = end
        at[s] += size[k]
        out[k] = 0
    left = int(share * sum(size))
    for *_, k, words in sorted(stream):
        out[k] += min(words, left)
        left -= min(words, left)
    return sorted([(rows[k][0], size[k], total[rows[k][2]], round(target[rows[k][2]], 6), out[k]) for k in out], key=str)


@pytest.mark.parametrize(("last", "span", "weights", "share"), [(20_000, 200_000, (5, 2, 1), 1.5), (7, 50, (5, 2, 1), 1.5), (7, 50, (3, 0.1), 0.7), (20_000, 50, (1,), 3.0)])
def test_mix_against_brute_force(spark, last, span, weights, share, monkeypatch):
    monkeypatch.setattr(mixing, "_LAST", last)
    monkeypatch.setattr(mixing, "_RANGE", span)
    rng = np.random.default_rng(5)
    rows = [(k, " ".join("w" * int(n)), ["a", "b", "é", "c", None, "Z"][int(rng.integers(0, 6)) if k % 3 else 0]) for k, n in enumerate(rng.integers(0, 30, 300))]
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, " \n", None), (None, "one two", "a"), (None, "one two three", "b"), (1003, "long " * 900, "b")]
    docs = docs_of(spark, rows, ", source string")
    for frame in (docs, docs.repartition(5)):
        got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame, weights=weights, share=share).collect()]
        assert sorted(got, key=str) == brute_mix(rows, weights=weights, share=share)


def test_mix_spends_the_budget_and_keeps_columns(spark):
    rows = [(k, "w " * (k % 17 + 3000 * (k == 7)), f"s{k % 5}", k) for k in range(400)]
    mixed = mixing.mix(docs_of(spark, rows, ", source string, taken int"))
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "virtual_finish", "taken"]
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= len(by_source) for r in by_source)
    assert sum(r.t for r in by_source) == sum(int(1.5 * sum(k % 17 + 3000 * (k == 7) for k in range(400))) for _ in "1")
    assert mixed.where("taken > 2 * size OR taken < 0").count() == 0


def test_fair_stream_is_in_order_of_virtual_time_and_ends_at_the_budget(spark):
    queues = spark.createDataFrame([(0, "0a", 5, 9, 6.5, 0), (1, "0a", 4, 9, 6.5, 5), (2, "0b", 3, 3, 2.5, 0), (3, "0b", 0, 3, 2.5, 3)], "at long, source_key string, size long, source_size long, target double, start long")
    stream = lambda budget: [(r.at, r.copy, r.words, r.end) for r in sorted(mixing.fair_stream(queues, budget, 2).collect(), key=lambda r: (r.virtual_finish, r.source_key, r.end))]
    assert stream(9) == [(0, 0, 5, 5), (2, 0, 2, 2), (1, 0, 1, 6), (1, 0, 1, 7)]
    assert stream(4) == [(0, 0, 4, 5)]
    assert sum(words for _, _, words, _ in stream(1000)) == 24


def test_mix_of_hot_and_empty_tables(spark):
    same = docs_of(spark, [(7, "a b c", "x")] * 50, ", source string")
    assert mixing.mix(same).agg(F.sum("taken")).first()[0] == 225
    assert mixing.mix(docs_of(spark, [], ", source string")).count() == 0
    nothing = mixing.mix(docs_of(spark, [(1, "", "x"), (2, None, None)], ", source string")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
