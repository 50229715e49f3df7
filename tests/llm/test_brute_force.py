"""Quality, language ID and decontamination held against plain loops, and what the pipeline does with odd tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import decontaminate, language_id, quality

DATA = "/root/testdata/sf0.01"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# Quality


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        at = np.unique(rng.integers(0, 40, 12))
        rows.append((at, rng.random(len(at)), int(rng.integers(0, 2))))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for at, x, label in rows:
            features = [*zip(at.tolist(), x.tolist(), strict=True), (64, 1.0)]
            w = {i: weight(i) for i, _ in features}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in features)))
            for i, v in features:
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = quality.ftrl(rows, bits=6, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, [weight(i) for i in range(65)], atol=1e-12)


def grams(text):
    """Unigrams and bigrams of words and punctuation runs, each with a way to write it alone."""
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")
    return words, list(zip(words, words[1:], strict=False))


def test_quality_scores_against_plain_dot_products(spark):
    rng = np.random.default_rng(9)
    weights = rng.normal(size=(1 << quality.BITS) + 1)
    place = lambda text: [int(x) for x in quality.places(pa.array([text]), quality.BITS)[0]]
    texts = ["", None, "One two, two two!", "été -- Straße 42 ... ok", "a" * 500, *(" ".join(rng.choice(list("abcde!?"), 30)) for _ in range(10))]
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(spark, list(enumerate(texts))), weights).collect()}
    for k, text in enumerate(texts):
        words, pairs = grams(text)
        spots = [place(w)[0] for w in words] + [place(f"{a} {b}")[2] for a, b in pairs]
        logit = weights[-1] + (quality.SCALE * sum(weights[s] for s in spots) / len(spots) if spots else 0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4), text


def test_training_vectors_repeated_labels_and_repeated_ids(spark):
    docs = docs_of(spark, [(1, "good words here"), (2, "bad! bad!"), (2, "bad! again!")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels)
    order = labels.select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality").orderBy("h", "doc_id", "quality").collect()
    texts = {1: ["good words here"], 2: ["bad! bad!", "bad! again!"]}
    rows = []
    for r in order:
        options = []
        for text in texts[r.doc_id]:
            at, count = np.unique(quality.places(pa.array([text]), quality.BITS)[0], return_counts=True)
            options.append((at, count * (quality.SCALE / count.sum()), r.quality))
        rows.append(options)
    orders = [[x for options in rows for x in (options if keep else options[::-1])] for keep in (True, False)]
    assert any(np.allclose(weights, quality.ftrl(o)) for o in orders)


# Language ID


def plain_letter(code, dim):
    """The vector of a letter, by the finalizer of SplitMix64 in whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    out = []
    for word in range(dim // 64):
        bits = mix((mix((code * 1_000_003 + word) & mask) + 0x2545F4914F6CDD1D) & mask)
        for byte in bits.to_bytes(8, "little"):
            out += [1 if byte >> (7 - k) & 1 else -1 for k in range(8)]
    return out


def plain_bundle(text, dim):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    letters = " " + " ".join(words) + " " if words else ""
    total = np.zeros(dim, dtype=np.int64)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        x, y, z = (plain_letter(ord(ch), dim) for ch in (a, b, c))
        total += np.array([x[(k - 2) % dim] * y[(k - 1) % dim] * z[k] for k in range(dim)])
    return total


def test_prototypes_cosines_and_predictions_against_plain_loops(spark):
    texts = {"en": ["the cat and the dog", "in the house of others", "we are here"], "de": ["der hund und die katze", "in dem haus der anderen"], "fr": ["le chat et le chien dans la maison"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    prototypes = language_id.train_prototypes(docs_of(spark, rows, ", lang string").repartition(3))
    length = lambda v: math.sqrt(float((v.astype(float) ** 2).sum()))
    plain = {lang: sum(np.rint(plain_bundle(t, 512) / length(plain_bundle(t, 512)) * 10_000) for t in ts) for lang, ts in texts.items()}
    assert all(np.abs(plain[lang] - prototypes[lang]).max() <= 1 for lang in texts)
    asked = [(0, "the others and the house"), (1, "die katze"), (2, "la maison"), (3, "Ça, c'est 3 été!"), (4, "12"), (5, "x")]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, asked), prototypes).collect()}
    for k, text in asked:
        v = plain_bundle(text, 512)
        if not v.any():
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        cosine = {lang: float(v @ p) / length(v) / length(p) for lang, p in plain.items()}
        best = min(cosine, key=lambda lang: (-cosine[lang], lang))
        assert got[k].lang_pred == best and got[k].score == pytest.approx(max(0.0, cosine[best]), abs=1e-4)


def test_only_the_first_documents_of_a_language_train_and_long_texts_go_in_parts(spark, monkeypatch):
    rows = [(k, f"word{chr(97 + k % 26)} der und", "de") for k in range(50)]
    few = language_id.train_prototypes(docs_of(spark, rows, ", lang string"), per_language=7)
    first = [r.doc_id for r in docs_of(spark, rows, ", lang string").orderBy(F.xxhash64("doc_id"), "doc_id").limit(7).collect()]
    again = language_id.train_prototypes(docs_of(spark, [r for r in rows if r[0] in first], ", lang string"))
    assert np.array_equal(few["de"], again["de"])
    for text in ("abcdefgh ijklmnop qrst", "  a  b 12 c, d\n\n e f.", "ΣΑΣ ΣΑΣ" * 5, "1" * 40 + "ab" + " " * 40, "x" * 30, "é" + "." * 25 + "ü"):
        for part in (1, 2, 3, 7, 10, 1 << 20):
            monkeypatch.setattr(language_id, "_PART", part)
            assert np.array_equal(language_id.Bundler(64)([text, "abc"])[0], plain_bundle(text, 64)), (text, part)


# Decontamination


def canonical(text):
    """(literal, kind, value) of every token: kind 0 word, 1 number, 2 unit, 3 name."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]
    joined = []
    for a, b in spans:
        if joined and text[a].isascii() and text[a].isdigit() and text[joined[-1][2]].isdigit() and a - joined[-1][1] == 1 and text[joined[-1][1]] in ".,":
            joined[-1] = [joined[-1][0], b, a]
        else:
            joined.append([a, b, a])
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    out = []
    for k, (a, b, _) in enumerate(joined):
        value, before = text[a:b], out[-1] if out else None
        number = value[0].isascii() and value[0].isdigit()
        unit = before is not None and before[1] == 1 and fold(value) in decontaminate.UNITS
        capital = re.match(r"[A-Z][^A-Z]|[À-Þ]", value) and (len(value.encode()) > 1)
        within = k > 0 and not re.search(r'[.!?:;\n"]', text[joined[k - 1][1] : a])
        out.append((fold(value), 1 if number else 2 if unit else 3 if capital and within else 0, value.lower()))
    return out


def windows(tokens, width, usable, least):
    """(form, window, place, slots) of all windows: literal ones, and templates with enough literals."""
    for at in range(len(tokens) - width + 1):
        part = tokens[at : at + width]
        plain = sum(t[1] == 0 for t in part)
        yield ("bare" if plain < least else "placed"), ("literal", *(t[0] for t in part)), at, []
        if least <= plain < width:
            yield ("template" if plain >= usable else "sparse"), ("template", *(t[0] if t[1] == 0 else t[1] for t in part)), at, [t[2] for t in part if t[1]]


def brute_contaminated(docs, items, width=8, min_literals=5, coverage=0.4, enough=6, shortest=1):
    needs = lambda w: (min_literals, min(min_literals, 2)) if w == width else (min(min_literals, (w + 1) // 2) if w > 3 else w,) * 2
    out = set()
    for i, item in items:
        tokens = canonical(item)
        w = min(width, len(tokens))
        if w < shortest:
            continue
        ours = list(windows(tokens, w, *needs(w)))
        everything, usable = {p for _, _, p, _ in ours}, {p for f, _, p, _ in ours if f != "bare"}
        by = defaultdict(list)
        for form, window, place, slots in ours:
            by[window].append((form, place, slots))
        for d, text in docs:
            shifts = defaultdict(lambda: defaultdict(list))
            for _, window, at, slots in windows(canonical(text), w, *needs(w)):
                for form, place, values in by.get(window, ()):
                    shifts[at - place][place].append((form, list(zip(values, slots, strict=True))))
            covered, reworded = set(), False
            for places in shifts.values():
                kinds = {}
                pairs = {p: [x for form, xs in found if form in ("template", "sparse") for x in xs] for p, found in places.items()}
                for p, found in places.items():
                    forms = {form for form, _ in found}
                    kinds[p] = "literal" if forms & {"bare", "placed"} else "few" if "sparse" in forms else "template"
                fits = lambda xs: len(set(xs)) == len({a for a, _ in xs})
                loose = [x for p, k in kinds.items() if k != "literal" for x in pairs[p]]
                some = [x for p, k in kinds.items() if k == "template" for x in pairs[p]]
                if fits(loose) and len(set(places) & usable) == len(usable):
                    chosen = set(places)
                elif fits(some):
                    chosen = {p for p, k in kinds.items() if k != "few"}
                else:
                    chosen = {p for p, k in kinds.items() if k == "literal"}
                if chosen:
                    covered |= chosen
                    reworded |= any(a != b for a, b in loose)
            share = max(len(covered) / len(everything), len(covered & usable) / len(usable) if usable else 0)
            if covered and (share >= coverage or len(covered) >= enough):
                out.add((d, i, reworded))
    return out


def other_values(text, rng):
    """A text with other numbers, units and names, the same ones for the same ones."""
    swap = {}
    names = ["Nora", "Emil", "Paula", "Viktor", "Ida", "Oskar", "Thea", "Anton", "Frieda", "Jonas"]
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    kinds = canonical(text)
    if len(spans) != len(kinds):  # numbers with a point: their two halves are one token
        spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    out, last = "", 0
    for (a, b), (_, kind, value) in zip(spans, kinds, strict=False):
        if kind in (1, 3):
            new = swap.setdefault(value, str(int(rng.integers(2, 99))) if kind == 1 else names[len(swap) % len(names)])
            out += text[last:a] + new
            last = b
    return out + text[last:]


def test_decontamination_against_plain_windows_and_slots(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["the", "road", "Maria", "Tom", "has", "apples", "and", "walks", "5", "km", "12", "miles", "to", "market", "with", "3.5", "hours", "Anna"]
    items = [(k, " ".join(rng.choice(vocabulary, int(n))) + ".") for k, n in enumerate([1, 1, 2, 2, 3, *rng.integers(3, 30, 25)])]
    docs = []
    for k in range(120):
        _, item = items[int(rng.integers(0, len(items)))]
        words = item.split()
        if k % 4 == 1:
            words = other_values(item, rng).split()
        if k % 4 == 2:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary))
        if k % 4 == 3:
            words = words[int(rng.integers(0, 6)) :]
        docs.append((k, " ".join([*rng.choice(vocabulary, 5), *words, *rng.choice(vocabulary, 5)])))
    found = decontaminate.contaminated(docs_of(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.reworded) for r in found.collect()} == brute_contaminated(docs, items)


def test_items_of_one_to_three_tokens_are_found_word_for_word(spark):
    items = [(1, "Zebra"), (2, "Zebra crossing!"), (3, "x is 7"), (4, "42"), (5, "..."), (6, "5 km"), (7, None)]
    docs = [(1, "a zebra, a zebra and a zebra"), (2, "the zebra CROSSING"), (3, "So x is 7."), (4, "x is 8, 421"), (5, "6 km or 42"), (6, ""), (7, None), (8, "it was 5 km")]
    found = decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted((r.doc_id, r.item_id, r.n_matched, r.n_windows, r.coverage, r.reworded) for r in found.collect())
    assert rows == [(d, i, 1, 1, 1.0, False) for d, i in ((1, 1), (2, 1), (2, 2), (3, 3), (5, 4), (8, 6))]


def test_most_reworded_benchmark_items_are_found_and_clean_documents_stay(spark):
    rng = np.random.default_rng(13)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    planted = [(k, i, f"Before it there is this. {other_values(t, rng)} And after it that.") for k, (i, t) in enumerate(items)]
    found = decontaminate.contaminated(docs_of(spark, [(k, t) for k, _, t in planted]), spark.createDataFrame(items, "item_id long, text string"))
    hits = {(r.doc_id, r.item_id) for r in found.collect()}
    wanted = {(k, i) for k, i, _ in planted}
    assert len(hits & wanted) >= 0.9 * len(wanted) and len(hits - wanted) <= 0.05 * len(wanted)


# Pipeline


def run_on(spark, tmp_path, rows, schema):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, [], SCHEMA).count() == 0


def test_pipeline_with_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(14)
    prose = lambda: " ".join(str(rng.choice(["der", "hund", "und", "die", "katze", "haus", "baum", "wald", "see", "berg"])) + chr(97 + int(rng.integers(0, 26))) for _ in range(60))
    texts = [prose() for _ in range(12)]
    rows = [(k, t, "de", f"s{k % 3}", len(t), 1, "x", 2.0) for k, t in enumerate(texts)]
    rows += [(None, prose(), "de", None, None, 2, "y", 0.5), (None, prose(), None, "s1", 3, 3, "z", 0.5), (3, texts[3], "de", "s0", 0, 4, "w", 0.5), (4, prose(), "de", "s1", 0, 5, "v", 0.5), (50, None, None, None, None, 6, "u", None), (51, texts[0], "de", "s0", 0, 7, "t", None)]
    out = run_on(spark, tmp_path, rows, SCHEMA + ", mark int, hash string, score double")
    assert out.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "mark", "hash", "score"]
    kept = Counter(r["mark"] for r in out.collect())
    assert 6 not in kept and 7 not in kept  # no text, and a copy of document 0
    assert all(r.n_chars == len(r.text) for r in out.collect())
    size = sum(len(r.text.split()) * 1 for r in out.select("text").collect())
    assert 0 < out.agg(F.sum("taken")).first()[0] <= 2 * size
