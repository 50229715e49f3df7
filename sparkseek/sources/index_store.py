"""The index as a table with versions: immutable segments of Parquet, and a log of numbered commits.

A change writes one segment: words, postings sorted by key and block with bounds of blocks, documents, pages, boxes, the documents
that it replaces, and how it changes the frequencies of keys. It takes effect with the next file of the log, which is made
only if there is none of that number; so of two writers one goes first, and the other works out its frequencies again and
tries the next number. Readers take the last file of the log: all of a commit or nothing, and never a gap.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.storage import changed_at, create_once, names_in, remove, shared_dir
from sparkseek.operators.index import Batch, Index, doc_blocks, packed_postings, unpacked, with_bounds

SCHEMA_VERSION = 4
_FEW = 100_000
#: Bytes of words, as written, of a task that makes postings of them, and of a row group of them.
_SPLIT = 32 << 20
#: So many blocks of a key (2 to this power) are dealt together.
_RUN_BITS = 10
#: Numbers of words and lines, which ascend, are written as differences.
_DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element": "false", "parquet.enable.dictionary#lines.list.element": "false"}


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all commits, ascending."""
    return sorted(int(n[:-5]) for n in names_in(spark, f"{path}/log") if n.endswith(".json") and n[:-5].isdigit())


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    version = max(versions(spark, path), default=None) if version is None else version
    if version is None:
        return None
    return json.loads(spark.read.text(f"{path}/log/{version:08d}.json", wholetext=True).first()["value"]) | {"version": version}


def _part(spark: SparkSession, path: str, segments: list[dict], name: str, columns: list[str] | None = None) -> DataFrame | None:
    """One table of all segments that have it, seg being a segment's place, without the rows of documents that later
    segments replace."""
    out = []
    for k, segment in enumerate(segments):
        if (name if name != "blocks" else "postings") not in segment["tables"]:
            continue
        if name == "blocks":  # bounds stand with the first document of a block, and hold without some of its documents
            df = spark.read.parquet(f"{path}/segments/{segment['name']}/postings").where("n IS NOT NULL")
            df = df.select("key", "block", "n", "max_tf", "max_share", F.col("doc_id").alias("first_doc"))
        else:
            df = spark.read.parquet(f"{path}/segments/{segment['name']}/{name}")
        if columns:
            df = df.select(*(c for c in columns if c in df.columns))
        if name != "blocks":
            for later in segments[k + 1 :]:
                if later["replaces"]:
                    gone = spark.read.parquet(f"{path}/segments/{later['name']}/replaced")
                    df = df.join(F.broadcast(gone) if later["replaces"] <= _FEW else gone, "doc_id", "left_anti")
        out.append(df.withColumn("seg", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out) if out else None


def _terms(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """(key, df) of the segments: the sum of what each changed."""
    parts = [spark.read.parquet(f"{path}/{s['terms']}") for s in segments]
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("df").alias("df")).where("df > 0")


@contextmanager
def _small_splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in tasks of _SPLIT bytes, so that what a task sorts stays in memory."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(_SPLIT))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stage(index: Index | Batch, replaced: DataFrame | None, path: str) -> dict:
    """Writes a segment that no commit names yet. Words are written first, and postings made of what was written, so texts
    are read once. The postings of a range of documents are sorted by key where its words are read and written there, so
    none is shuffled: readers of a few keys take the pages of each file that have them."""
    batch = isinstance(index, Batch)
    spark = (index.words if batch else index.postings).sparkSession
    name = uuid.uuid4().hex
    at, tables = f"{path}/segments/{name}", ["postings", "documents"]

    def save(df: DataFrame, table: str, **options) -> DataFrame:
        df.drop("seg").write.options(**options).parquet(f"{at}/{table}")
        return spark.read.parquet(f"{at}/{table}")

    words = index.words if batch else index.stored
    if words is not None:
        words = save(words.sortWithinPartitions("doc_id"), "stored", **{"parquet.block.size": _SPLIT})
        tables.append("stored")
    if batch:
        with _small_splits(spark):
            save(unpacked(packed_postings(words, index.stem).sortWithinPartitions("key", "first")), "postings", **_DELTAS)
        documents = words
    else:
        postings, documents = index.postings, index.documents
        if "block" not in postings.columns:
            postings = postings.join(doc_blocks(postings), "doc_id")
        if "len" not in postings.columns:  # of build_index()
            postings = postings.join(index.doc_stats, "doc_id")
            documents = index.doc_stats.withColumn("size", F.lit(None).cast("long")).withColumn("mtime", F.lit(None).cast("long"))
        save(with_bounds(postings, F.shiftright("block", _RUN_BITS)), "postings", **_DELTAS)
    documents = save(documents.select("doc_id", "len", "size", "mtime").sortWithinPartitions("doc_id"), "documents")
    for table in ("pages", "boxes"):
        if (df := getattr(index, table)) is not None:
            save(df.sortWithinPartitions("doc_id"), table)
            tables.append(table)
    n_replaced = 0 if replaced is None else save(replaced.select("doc_id").where("doc_id IS NOT NULL").distinct(), "replaced").count()
    n, total = documents.where("len > 0").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return {"name": name, "tables": tables, "replaces": n_replaced, "documents": n, "length": total, "stem": index.stem if batch else None}


def _counted(spark: SparkSession, path: str, segment: dict, base: list[dict]) -> dict:
    """The segment with its terms: frequencies of its own keys, less those of the documents that it replaces in base. For
    these only the words of the documents are read, which are sorted by id; postings only where words aren't stored."""
    here = f"{path}/segments/{segment['name']}"
    changes = [spark.read.parquet(f"{here}/postings").groupBy("key").agg(F.count("*").alias("df"))]
    lost = {"documents": 0, "length": 0}
    if base and segment["replaces"]:
        gone = spark.read.parquet(f"{here}/replaced")
        low, high = gone.agg(F.min("doc_id"), F.max("doc_id")).first()
        gone = F.broadcast(gone) if segment["replaces"] <= _FEW else gone

        def replaced(name: str, columns: list[str], some=lambda s: True) -> DataFrame | None:
            old = _part(spark, path, [s if some(s) else s | {"tables": []} for s in base], name, columns)
            return old if old is None else old.where(F.col("doc_id").between(F.lit(low), F.lit(high))).join(gone, "doc_id", "left_semi")

        lost["documents"], lost["length"] = replaced("documents", ["doc_id", "len"]).where("len > 0").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        for stem in (True, False):
            words = replaced("stored", ["doc_id", "block", "len", "words", "lines"], lambda s, stem=stem: s["stem"] is stem)
            if words is not None:
                changes.append(packed_postings(words, stem).groupBy("key").agg((-F.sum(F.size("doc_ids"))).alias("df")))
        postings = replaced("postings", ["doc_id", "key"], lambda s: s["stem"] is None)
        if postings is not None:
            changes.append(postings.groupBy("key").agg((-F.count("*")).alias("df")))
    name = f"segments/{segment['name']}/terms-{uuid.uuid4().hex}"
    terms = changes[0] if len(changes) == 1 else reduce(DataFrame.unionByName, changes).groupBy("key").agg(F.sum("df").alias("df")).where("df <> 0")
    terms.sortWithinPartitions("key").write.parquet(f"{path}/{name}")
    return segment | {"terms": name} | {f"lost_{k}": v for k, v in lost.items()}


def _commit(spark: SparkSession, path: str, version: int, segments: list[dict], documents: int, length: int) -> bool:
    state = {"schema_version": SCHEMA_VERSION, "segments": segments, "documents": documents, "length": length}
    return create_once(spark, f"{path}/log/{version:08d}.json", json.dumps(state))


def write_index(index: Index | Batch, path: str, attempts: int = 20) -> int:
    """Commits an index in place of all that is at path; returns the version."""
    spark = index[0].sparkSession
    segment = _counted(spark, path, _stage(index, None, path), [])
    for _ in range(attempts):
        version = max(versions(spark, path), default=0) + 1
        if _commit(spark, path, version, [segment], segment["documents"], segment["length"]):
            return version
    raise Conflict(path)


def upsert_index(spark: SparkSession, path: str, changed: Index | Batch, touched: DataFrame, compact_after: int = 8, attempts: int = 20) -> int:
    """Delete-then-insert by document, in one commit: what the index has of the documents in touched(doc_id) goes, and all
    of changed comes in. A document in touched only is removed; one that has no words stays known by its row in documents.

    The change alone is written. Where another writer committed meanwhile, this change goes on top of that one. Beyond
    compact_after segments they are merged, in a commit of its own."""
    own = changed.words if isinstance(changed, Batch) else changed.doc_stats
    segment = _stage(changed, touched.select("doc_id").union(own.select("doc_id")), path)
    for _ in range(attempts):
        state = _state(spark, path) or {"version": 0, "segments": [], "documents": 0, "length": 0}
        new = _counted(spark, path, segment, state["segments"])
        n, length = (state[k] + new[k] - new[f"lost_{k}"] for k in ("documents", "length"))
        if _commit(spark, path, state["version"] + 1, [*state["segments"], new], n, length):
            if len(state["segments"]) + 1 > compact_after:
                compact(spark, path)
            return state["version"] + 1
    raise Conflict(path)


def compact(spark: SparkSession, path: str, attempts: int = 20) -> int:
    """Merges all segments into one and commits it; what others committed meanwhile stays on top."""
    state = _state(spark, path)
    old = state["segments"]
    tables = {name: _part(spark, path, old, name) for name in ("documents", "stored", "pages", "boxes")}
    postings = _part(spark, path, old, "postings").drop("block", "n", "max_tf", "max_share")
    postings = postings.join(doc_blocks(postings), "doc_id")
    merged = _stage(Index(postings, None, None, **tables), None, path)
    stems = {s["stem"] for s in old}
    merged |= {"terms": f"segments/{merged['name']}/terms", "lost_documents": 0, "lost_length": 0, "stem": stems.pop() if len(stems) == 1 else None}
    _terms(spark, path, old).sortWithinPartitions("key").write.parquet(f"{path}/{merged['terms']}")
    for _ in range(attempts):
        if [s["name"] for s in state["segments"][: len(old)]] != [s["name"] for s in old]:
            return state["version"]  # others merged or replaced them
        if _commit(spark, path, state["version"] + 1, [merged, *state["segments"][len(old) :]], state["documents"], state["length"]):
            return state["version"] + 1
        state = _state(spark, path)
    raise Conflict(path)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index | None:
    """The last version of an index, or another one, or None where it is of another schema and must be built again."""
    state = _state(spark, path, version)
    if state is None:
        raise FileNotFoundError(f"no index at {path}")
    if state["schema_version"] != SCHEMA_VERSION:
        return None
    segments = state["segments"]
    documents = _part(spark, path, segments, "documents", ["doc_id", "len", "size", "mtime"]).drop("seg")
    return Index(
        _part(spark, path, segments, "postings"), documents.where("len > 0").select("doc_id", "len"), _terms(spark, path, segments), documents,
        *(_part(spark, path, segments, name) for name in ("blocks", "stored", "pages", "boxes")), (state["documents"], state["length"]),
    )


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 3600) -> list[str]:
    """Deletes commits before the last keep, and segments that no other names; these only if they are older than so many
    seconds, as a writer may be about to commit them. Returns the segments' names."""
    numbers = versions(spark, path)
    used = {s["name"] for v in numbers[-keep:] for s in _state(spark, path, v)["segments"]}
    late = (time.time() - older_than) * 1000
    gone = [n for n in names_in(spark, f"{path}/segments") if n not in used and changed_at(spark, f"{path}/segments/{n}") <= late]
    remove(spark, [f"{path}/log/{v:08d}.json" for v in numbers[:-keep]] + [f"{path}/segments/{n}" for n in gone])
    return sorted(gone)


def stored_index(index: Index | Batch) -> Index:
    """The index written to a new shared folder and read back, for jobs that use its tables several times."""
    path = shared_dir(index[0].sparkSession)
    write_index(index, path)
    return read_index(index[0].sparkSession, path)
