"""Upserts of an index, date cells, kinds of files, blocks of queries, and numbering over ranges."""

import io
import random
import re
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import storage
from sparkseek.operators import fuzzy, layout, search
from sparkseek.operators.index import build_index, query_terms, tokens, vocabulary_keys
from sparkseek.sources import index_store, office, readers


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_upserts_equal_a_new_index(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["red", "apple", "apples", "car", "the", "running", "run", "søk", "café"])
    current = {k: " ".join(word() for _ in range(rng.randint(0, 9))) for k in range(40)}
    path = str(tmp_path / "index")
    index_store.write_index(build_index(docs_of(spark, list(current.items()))), path)
    for step in range(4):
        changed = {rng.randint(0, 50): " ".join(word() for _ in range(5)) for _ in range(6)}
        removed = [rng.randint(0, 50) for _ in range(3)]
        for k in removed:
            current.pop(k, None)
            changed.pop(k, None)
        current |= changed
        touched = spark.createDataFrame([(k,) for k in [*changed, *removed]], "doc_id long")
        index_store.upsert_index(spark, path, build_index(docs_of(spark, list(changed.items()))), touched, compact_after=3 if step > 1 else 8)
        got, want = index_store.read_index(spark, path), build_index(docs_of(spark, list(current.items())))
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(got.postings.select("key", "doc_id", "tf", "positions")) == rows(want.postings.select("key", "doc_id", "tf", "positions"))
        assert rows(got.term_stats) == rows(want.term_stats) and rows(got.doc_stats) == rows(want.doc_stats)


def test_stems_of_words_are_those_of_the_vocabulary(spark):
    docs = docs_of(spark, [(1, "Running runs RUN cafés café relational"), (2, None), (3, "´ the the running")])
    words = tokens(docs)
    keys = {r.norm: r.key for r in vocabulary_keys(words).collect()}
    found = build_index(docs).postings.collect()
    assert {r.key for r in found} == set(keys.values()) and keys["running"] == keys["runs"] == keys["run"]
    assert {(r.doc_id, r.key): r.tf for r in found}[1, keys["run"]] == 3
    assert "positions" not in build_index(docs, positions=False).postings.columns


def test_unranked_queries_list_documents_in_order(spark):
    index = build_index(docs_of(spark, [(k, "the car is red" if k % 3 else "the other") for k in range(30)]), stem=False)
    queries = spark.createDataFrame([(1, "the is"), (2, "red ca"), (3, "the")], "query_id long, query_text string")
    hits = search.search(query_terms(queries, stem=False), index, limit=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in hits if r.query_id != 2] == [(1, 1, 0.0), (1, 2, 0.0), (1, 4, 0.0), (1, 5, 0.0), (3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0), (3, 3, 0.0)]
    assert all(r.score > 0 for r in hits if r.query_id == 2)


@pytest.mark.parametrize(("serial", "system", "shown"), [
    (1, 1900, "1900-01-01"), (59, 1900, "1900-02-28"), (60, 1900, None), (61, 1900, "1900-03-01"), (45678, 1900, "2025-01-21"), (45678.75, 1900, "2025-01-21 18:00:00"),
    (0.5, 1900, "12:00:00"), (0, 1904, "1904-01-01"), (-3, 1900, None), (9e9, 1900, None)])
def test_serial_text(serial, system, shown):
    assert office.serial_text(serial, system) == shown


def test_date_cells(spark):
    formats = ["General", "yyyy-mm-dd", '0.00 "days"', "[Red]0", "h:mm", "d/m/yy;@", "#,##0"]
    styles = "<styleSheet><numFmts>" + "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{f.replace(chr(34), "&quot;")}"/>' for k, f in enumerate(formats)) + "</numFmts><cellStyleXfs><xf numFmtId=\"14\"/></cellStyleXfs><cellXfs>"
    styles += "".join(f'<xf numFmtId="{164 + k}"/>' for k in range(len(formats))) + '<xf numFmtId="14"/><xf numFmtId="2"/></cellXfs></styleSheet>'
    cells = "".join(f'<c r="{chr(65 + k)}1" s="{k}"><v>100</v></c>' for k in range(len(formats) + 2))

    def book(date1904):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/styles.xml", styles)
            z.writestr("xl/workbook.xml", f'<workbook><workbookPr date1904="{date1904}"/></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData><row r="1">{cells}</row></sheetData></worksheet>')
        return out.getvalue()

    files = spark.createDataFrame([("a.xlsx", book(0)), ("b.xlsx", book(1))], "path string, content binary")
    got = {(r.path, r.col): (r.type, r.text) for r in office.spreadsheet_cells(files).collect()}
    dates = {1, 4, 5, 7}
    assert {col for path, col in got if got[path, col][0] == "date"} == dates
    assert got["a.xlsx", 1] == ("date", "1900-04-09") and got["b.xlsx", 1] == ("date", "1904-04-10") and got["a.xlsx", 2] == ("number", "100")


def test_documents_go_to_the_extractor_of_their_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("zwei\nZeilen é")
    (tmp_path / "sub" / "b.xyz").write_text("?")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<d><p><t>Hello</t></p></d>")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("zwei\nZeilen é", None) and got["c.docx"] == ("Hello", None)
    assert got["b.xyz"][0] is None and "xyz" in got["b.xyz"][1]


def test_queries_in_blocks_give_what_one_block_gives(spark):
    rng = random.Random(5)
    titles = spark.createDataFrame([(k, "".join(rng.choice("abcé 100%_\\x") for _ in range(12))) for k in range(200)], "id long, title string")
    asked = [(k, "".join(rng.choice("abé%_\\1") for _ in range(rng.randint(1, 3)))) for k in range(30)]
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    got = {(r.query_id, r.id) for r in fuzzy.fuzzy_candidates(queries, titles).collect()}
    fold = lambda s: s.lower().replace("é", "e")
    in_order = lambda q, t: re.search(".*".join(map(re.escape, fold(q))), fold(t)) is not None
    assert got == {(k, r.id) for k, q in asked for r in titles.collect() if in_order(q, r.title)}
    blocks = []
    whole = search.in_blocks(queries, lambda b: (blocks.append(1), b)[1], rows=7)
    assert len(blocks) == 5 and sorted(map(tuple, whole.collect())) == sorted(asked)


def test_natural_places_over_ranges(spark):
    names = [f"{'Slide' if k % 2 else 'slide'}{k % 50}.xml" for k in range(500)]
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition(5)
    got = layout.natural_places(df, "name", "k").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501))
    numbers = [int(re.search("[0-9]+", r.name)[0]) for r in got]
    assert numbers == sorted(numbers)


def test_intermediate_tables_need_a_shared_folder(spark):
    assert storage.shared_top(spark) == spark.conf.get("spark.checkpoint.dir")
    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: none))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_top(cluster)
    table = storage.written(spark.range(3).select(F.col("id")))
    path = table.inputFiles()[0].rpartition("/")[0]
    storage.remove(spark, [path])
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        spark.read.parquet(path).count()
