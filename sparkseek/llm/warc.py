"""WARC archives: writing, normalising and reading them as Spark jobs.

write_archives() writes a record for every page, many to a file, each file one gzip stream. normalise() inflates such
a file once from start to end, however large, rewrites every record as a gzip member of its own, and writes beside it
an index of offsets. read_records() then reads any record by its offset alone. Files are written under a name of the
task's attempt and renamed when whole; what counts is the files that committed attempts list.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, shared_dir

#: What Hadoop calls file systems that pyarrow has by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_IO = 1 << 18
_READ = 1 << 23
#: Fixed value: the date of all records, so that the same pages give the same files.
DATE = "2000-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, type string, record_id string, uri string, error string"
_INDEX_ROW = pa.schema([(name, pa.int64() if name in ("offset", "length") else pa.string()) for name in (c.split()[0] for c in INDEX.split(", "))])


def _file_system(uri: str):
    """A file system of pyarrow for a URI or an absolute path, and the path in it. Raises ValueError for a scheme that
    pyarrow has none for."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives can't be kept at {uri}: {error}; use a path or a file, hdfs, s3, gs or abfs URI") from error


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id, uri, payload: bytes, digest: str, refers_to) -> bytes:
    """A whole WARC record, block and closing blank lines included."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(uri or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _id_hash(page_id) -> int:
    return zlib.crc32(_record_id(page_id).encode())


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def plan_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, uri, payload, digest, refers_to) for every row of pages; digest: SHA-1 of the payload in UTF-8 (null: empty).

    Of rows with equal payloads of min_bytes or more, those with the largest id have a null refers_to, the others that
    id. Rows without an id are never referred to; they revisit as others do."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(payload_col, F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    largest = cut(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest")
    )
    long = rows.where(F.octet_length("payload") >= min_bytes).join(largest, "digest", "left")
    long = long.select("id", "uri", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))
    short = rows.where(F.octet_length("payload") < min_bytes)  # the many empty ones have one digest, and are not dealt by it
    return long.union(short.select("id", "uri", "payload", "digest", F.lit(None).cast(long.schema["refers_to"].dataType).alias("refers_to")))


def write_archives(records: DataFrame, path: str, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the records of plan_records() to files under path, each one gzip stream of file_bytes of records or a
    little more, and returns (archive, n_records, ids): ids is the sum of their ids' hashes.

    A file's name has the attempt of its task, and only files of attempts that Spark committed are returned: with a task
    run twice, at once or again, nothing of the other attempt counts, in whatever order either saw its rows."""

    def write(batches):
        context = TaskContext.get()
        files, top = _file_system(path)
        files.create_dir(top, recursive=True)
        done, out, part = [], None, None

        def close():
            out.write(part["deflate"].flush())
            out.close()
            files.move(part["temp"], f"{top}/{part['name']}")
            done.append((f"{path}/{part['name']}", part["n"], part["ids"]))

        for batch in batches:
            for page_id, uri, payload, digest, refers_to in zip(*(batch.column(c) for c in ("id", "uri", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"whole-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    part = {"name": name, "temp": f"{top}/_{name}.part", "deflate": zlib.compressobj(6, zlib.DEFLATED, 31), "n": 0, "size": 0, "ids": 0}
                    out = files.open_output_stream(part["temp"])
                record = _record(page_id.as_py(), uri.as_py(), payload.as_py().encode(), digest.as_py(), refers_to.as_py())
                out.write(part["deflate"].compress(record))
                part["n"] += 1
                part["ids"] += _id_hash(page_id.as_py())
                part["size"] += len(record)
                if part["size"] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        names, counts, sums = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string()), "n_records": pa.array(counts, pa.int64()), "ids": pa.array(map(str, sums), pa.string())})

    return cut(records.mapInArrow(write, "archive string, n_records long, ids string").withColumn("ids", F.col("ids").cast("decimal(38,0)")))


class Damaged(Exception):
    """What a file holds is no sound archive; errors of reading and writing are others."""


class _Inflated:
    """The inflated bytes of a gzip file of one or several members, read once in small pieces."""

    def __init__(self, file):
        self.file, self.inflate, self.buffer, self.fresh = file, zlib.decompressobj(31), bytearray(), True

    def fill(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.inflate, self.fresh = zlib.decompressobj(31), True
            else:
                rest = self.inflate.unconsumed_tail
            data = rest or self.file.read(_IO)
            if not data:
                if not self.fresh:
                    raise Damaged("the gzip stream ends early")
                return False
            self.fresh = False
            try:
                more = self.inflate.decompress(data, _IO)
            except zlib.error as error:
                raise Damaged(str(error)) from error
            if more:
                self.buffer += more
                return True

    def until(self, mark: bytes) -> bytes:
        """What is left up to and with mark; empty at the end of the file."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                if self.buffer.strip():
                    raise Damaged("a record ends early")
                return b""
        found += len(mark)
        out = bytes(self.buffer[:found])
        del self.buffer[:found]
        return out

    def pieces(self, n: int):
        while n:
            if not self.buffer and not self.fill():
                raise Damaged("a record ends early")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _opened(files, at: str):
    try:
        return files.open_input_stream(at, compression=None)
    except FileNotFoundError as error:
        raise Damaged(str(error)) from error


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise Damaged("a record without a length")
    return int(value)


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrites the files named in archives(archive) under path, every record as its own gzip member, with an index
    NAME.idx beside each (JSON lines), and returns the rows of these indexes (INDEX). Names have the attempt of the task;
    the rows are those of the attempts that Spark committed, and what they don't point to is of a lost attempt.

    A file is inflated once and in small pieces, whatever its size and that of its records, and whether it is one gzip
    stream or several. A file that is damaged gives what comes before the damage, and a row with an error; so does a
    file that isn't there, with no record. All other errors of reading, and all of writing, fail the task."""

    def rewrite(batches):
        context = TaskContext.get()
        files, top = _file_system(path)
        files.create_dir(top, recursive=True)
        rows: list[dict] = []
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                name = f"{hashlib.sha1(archive.encode()).hexdigest()[:16]}-{context.taskAttemptId()}.warc.gz"
                temp = f"{top}/_{name}.part"
                source, at = _file_system(archive)
                offset = 0
                with files.open_output_stream(temp) as out, files.open_output_stream(f"{temp}.idx") as index:

                    def row(index=index, name=name, **x):
                        rows.append({"archive": f"{path}/{name}"} | x)
                        index.write((json.dumps(rows[-1]) + "\n").encode())

                    try:
                        with _opened(source, at) as file:
                            stream = _Inflated(file)
                            while head := stream.until(b"\r\n\r\n").lstrip():
                                fields = _headers(head)
                                length, deflate = _length(fields), zlib.compressobj(6, zlib.DEFLATED, 31)
                                out.write(deflate.compress(head))
                                for piece in stream.pieces(length):
                                    out.write(deflate.compress(piece))
                                for piece in stream.pieces(4):
                                    out.write(deflate.compress(piece))
                                out.write(deflate.flush())
                                end = out.tell()
                                row(offset=offset, length=end - offset, type=fields.get("warc-type"), record_id=fields.get("warc-record-id"), uri=fields.get("warc-target-uri"))
                                offset = end
                                if len(rows) >= 10_000:
                                    yield pa.RecordBatch.from_pylist(rows, _INDEX_ROW)
                                    rows.clear()
                    except Damaged as error:
                        row(error=f"{archive}: {error}")
                files.move(temp, f"{top}/{name}")
                files.move(f"{temp}.idx", f"{top}/{name}.idx")
        yield pa.RecordBatch.from_pylist(rows, _INDEX_ROW)

    n = archives.count()
    if not n:
        return archives.sparkSession.createDataFrame([], INDEX)
    return cut(archives.select("archive").repartition(min(n, 100_000)).mapInArrow(rewrite, INDEX))


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, sound) of the records in an index: page_id
    and refers_to as text, or null; sound: whether the payload of a response has the digest in its header."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string, sound boolean"

    def read(batches):
        for batch in batches:
            rows, opened, name = [], None, None
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != archive:
                    if opened:
                        opened.close()
                    files, at = _file_system(archive)
                    opened, name = files.open_input_file(at), archive
                opened.seek(offset)
                rows.append(_parsed(_Inflated(_Window(opened, length))))
            if opened:
                opened.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    sound = index.where("error IS NULL").select("archive", "offset", "length")
    # Index rows are short, so tasks are made by what they point to: some 8 MB each.
    tasks = max(1, math.ceil((sound.agg(F.sum("length")).first()[0] or 0) / _READ))
    return sound.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(read, schema)


class _Window:
    """The next n bytes of a file."""

    def __init__(self, file, n: int):
        self.file, self.n = file, n

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.n))
        self.n -= len(data)
        return data


def _parsed(stream: _Inflated) -> tuple:
    fields = _headers(stream.until(b"\r\n\r\n"))
    page = lambda k: (v := fields.get(k, "")) and v.removeprefix("<urn:page:").removesuffix(">") or None
    http = stream.until(b"\r\n\r\n")
    size = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, sound = fields["warc-type"], True
    if kind == "response":
        digest = hashlib.sha1()
        for piece in stream.pieces(int(fields["content-length"]) - len(http)):
            digest.update(piece)
        sound, said = digest.hexdigest() == said, digest.hexdigest()
    return page("warc-record-id"), size, said, kind, page("warc-refers-to"), fields["warc-target-uri"], sound


def archive_pages(spark: SparkSession, pages: DataFrame, path: str | None = None, min_bytes: int = 1000,
                  id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages written as archives under path (the shared folder by default), normalised, and read back by offset, as
    read_records() gives them. Raises RuntimeError if pages, archives and index don't have the same number of records and
    the same sum of their ids' hashes, or if the index has an error. Empty pages give no archive and an empty result."""
    path = path or shared_dir(spark)
    whole = write_archives(plan_records(pages, min_bytes, id_col, uri_col, payload_col), f"{path}/whole")
    index = normalise(whole, f"{path}/normal")
    of = lambda c: (F.count(c), F.sum(F.crc32(c).cast("decimal(38,0)")))
    asked = pages.select(F.concat(F.lit("<urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">")).alias("id")).agg(*of(F.col("id"))).first()
    written = whole.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.sum("ids")).first()
    *archived, error = index.agg(*of(F.when(F.col("error").isNull(), F.col("record_id"))), F.min("error")).first()
    if error is not None or not tuple(asked) == tuple(written) == tuple(archived):
        raise RuntimeError(f"{archived[0]} of {written[0]} records were archived, of {asked[0]} pages, or not the same ones: {error}")
    return read_records(index)
