"""Periodic runs against a plain search, whitening against numpy's own eigenvectors."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.llm import queries, runs, whitening
from sparkseek.llm.runs import find_runs, runs_of
from sparkseek.llm.whitening import eigen, whiten

DATA = "/root/testdata/sf0.01"


# Runs


def plain_runs(words, least=12):
    """(start, length, period) by looking at every period and place."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(rng):
    for kind in range(5):
        n = int(rng.integers(0, 200))
        if kind == 0:
            yield rng.integers(1, 3, n)
        elif kind == 1:
            yield rng.integers(1, 40, n)
        elif kind == 2:
            yield np.ones(n, int)
        elif kind == 3:
            yield np.resize(rng.integers(1, 4, max(1, n // 7)), n)
        else:
            made = rng.integers(1, 6, n)
            if n > 40:
                p = int(rng.integers(1, n // 3))
                for i in range(int(rng.integers(p, n - p)), n - int(rng.integers(0, p))):
                    made[i] = made[i - p]
            yield made


@pytest.mark.parametrize("least", [2, 12, 30])
def test_runs_against_a_plain_search(least):
    rng = np.random.default_rng(least)
    for _ in range(40):
        docs = [*some_texts(rng)]
        docs += [docs[0], docs[2]]  # copies are apart
        got = runs_of(np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]), least)
        assert [tuple(int(x) for x in r) for r in zip(*got, strict=True)] == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d.tolist(), least)]


def test_runs_longer_than_a_flush(monkeypatch):
    monkeypatch.setattr(runs, "_FLUSH", 50)
    rng = np.random.default_rng(4)
    docs = [np.resize(rng.integers(1, 9, 37), 900), np.ones(400, int), *some_texts(rng)]
    got = runs_of(np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]))
    assert [tuple(int(x) for x in r) for r in zip(*got, strict=True)] == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d.tolist())]


def test_sorted_suffixes_give_all_extensions():
    rng = np.random.default_rng(5)
    words = np.resize(rng.integers(1, 3, 90), 700).astype(np.int32)
    codes = np.concatenate([[0], words, [0]]).astype(np.int32)
    suffixes = runs.Suffixes(codes, np.array([1]), np.array([701]))
    i, j = (x.ravel() for x in np.meshgrid(suffixes.place, suffixes.place))
    i, j = i[i < j], j[i < j]
    plain = np.array([next((k for k in range(len(codes)) if codes[a + k] != codes[b + k]), 0) for a, b in zip(i[::97], j[::97], strict=True)])
    assert (suffixes.lce(i[::97], j[::97]) == plain).all()
    assert ((runs.SHIFT < runs.PERIOD) & (runs.SHIFT >= 0)).all()


def test_a_large_periodic_text():
    word = np.random.default_rng(6).integers(1, 9, 41)
    text = np.resize(word, 200_000).astype(np.int32)
    text[100_000] = 77
    got = runs_of(text, np.array([len(text)]))
    assert [tuple(map(int, r)) for r in zip(*got, strict=True) if r[3] == 41] == [(0, 0, 100_000, 41), (0, 100_001, 99_999, 41)]


def test_find_runs_on_odd_rows(spark):
    again = "a b c a b c a b c a b c a"
    rows = [(1, again), (1, again), (None, again), (2, None), (3, ""), (4, " \t\n "), (5, "x y " * 13), (6, "one two"), (7, "n  " * 12 + "z")]
    df = spark.createDataFrame([(*r, "kept", 9) for r in rows], "doc_id long, text string, runs string, collapsed_ int").withColumnRenamed("collapsed_", "Collapsed")
    got = find_runs(df, keep=["doc_id", "runs", "Collapsed"]).collect()
    assert find_runs(df).columns == ["doc_id", "text", "runs", "Collapsed", "runs_", "collapsed_"]
    assert len(got) == len(rows) and {r["runs"] for r in got} == {"kept"} and {r["Collapsed"] for r in got} == {9}
    found = {(r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs_"]), r["collapsed_"]) for r in got}
    assert found == {
        (1, ((0, 13, 3),), "a b c"), (None, ((0, 13, 3),), "a b c"), (2, (), ""), (3, (), ""), (4, (), ""),
        (5, ((0, 13, 1),), "x y"), (6, (), "one two"), (7, ((0, 12, 1),), "n  z"),
    }
    assert find_runs(df.limit(0)).count() == 0


def test_the_query_against_a_plain_search(spark):
    docs = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    checked = 0
    for doc_id, words in docs.items():
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        elif doc_id % 4:
            continue
        if n > 1500:
            continue
        found = plain_runs(words)
        row = got[doc_id]
        assert row["n_runs"] == len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        checked += len(found)
    assert checked > 50


# Whitening


@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "low rank", "zero", "one", "two"])
def test_eigenpairs_against_numpy(kind):
    rng = np.random.default_rng(3)
    size = {"one": 1, "two": 2}.get(kind, 48)
    a = rng.normal(size=(size, size))
    q = np.linalg.qr(a)[0]
    spectrum = {"clusters": np.repeat([5.0, 4.0, 4.0 + 1e-9, 1.0], 12), "low rank": np.append(np.arange(1.0, 6.0), np.zeros(43)), "zero": np.zeros(48)}
    matrix = q @ np.diag(spectrum[kind]) @ q.T if kind in spectrum else np.diag(np.arange(48.0)) if kind == "diagonal" else a @ a.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = eigen(matrix, 20)
    norm = max(1e-300, np.linalg.norm(matrix, 2))
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:20], rtol=0, atol=1e-13 * norm)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 2e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13


def test_whitening_against_numpy(spark):
    got = queries.op11_whitening(spark, DATA).toPandas()
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x = np.floor(64 * np.array([*rows.values()], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 32 * n and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[*rows]].to_numpy()
    plain = centred @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((wide * plain).sum(axis=0))
    assert np.allclose(wide, plain * signs, atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-10)
    assert (got.groupby("vec_id")["deviation"].first().loc[[*rows]].to_numpy() == ((n * x - sums) ** 2).sum(axis=1)).all()


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0]), (None, [1.5, -0.25, 2.0]), (2, [0.0, 3.0, -1.0]), (3, [9.0, 1.0, 1.0]), (4, [2.5, 2.25, 0.0]),
        (5, None), (6, [0.1, None, 0.2]), (7, [0.1, nan, 0.2]), (8, [inf, 0.0, 0.0]), (9, [1e30, 0.0, 0.0]), (10, []), (11, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, N string")
    got = whiten(df).collect()
    assert whiten(df).columns == ["vec_id", "embedding", "N", "n_", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4] and {r["n_"] for r in got} == {6}
    white = np.array([r["whitened"] for r in got])
    assert white.shape == (6, 3) and np.abs(white.T @ white / 6 - np.eye(3)).max() < 1e-12
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("vec_id in (5, 6, 10)")).collect() == []
    same = whiten(df.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["deviation"], r["identity_error"]) for r in same] == [([], 0, 0.0)] * 2


def test_sums_beyond_64_bits(spark):
    big = 2.0**54
    got = whiten(spark.createDataFrame([(k, [big * (k % 3), float(k)]) for k in range(30)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 30 and {r["deviation"] for r in got if r["vec_id"] % 3 != 1} == {None}
    white = np.array([r["whitened"] for r in got])
    assert np.abs(white[:, :1].T @ white[:, :1] / 30 - 1).max() < 1e-12
    assert whitening.deviations(np.array([[2**60, 1]]), 2**40, [5, 6]).tolist() == [[2**100 - 5, 2**40 - 6]]


def test_words_and_joins_are_exact():
    texts = pa.array(["  b\ta\n", None, "", "a b a", "ü ü", "   "])
    packed, size, codes, sizes = runs.words_of(texts)
    assert sizes.tolist() == [2, 0, 0, 3, 2, 0] and codes.tolist() == [1, 2, 2, 1, 2, 3, 3]
    assert runs.joined(packed, size, sizes, np.array([True, False, True, True, False, True, True])).to_pylist() == ["b", "", "", "a b", "ü ü", ""]
    sliced = pa.array(["zz", "b a", "c"]).slice(1)
    packed, size, codes, sizes = runs.words_of(sliced)
    assert sizes.tolist() == [2, 1] and runs.joined(packed, size, sizes, np.ones(3, bool)).to_pylist() == ["b a", "c"]
