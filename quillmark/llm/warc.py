"""WARC archives as a PySpark Python data source.

``df.write.format("warc")`` writes record-compressed .warc.gz files: every
task writes to a name of its own and the commit moves the finished files into
place, so lost or repeated tasks leave no records behind.
``spark.read.format("warc")`` plans partitions over the files by size, takes
predicates on the record type and on headers, reads a record's headers first
and passes over the payloads of records that the predicates refuse, or of all
records where the schema asked for has no payload.

Paths go through pyarrow's file systems, so any store that those can reach
works. Revisit records follow WARC 1.1's identical-payload-digest profile:
they hold the HTTP head, which keeps the payload's length, and no payload.

Cases: a null html is an empty payload; a null page_id gives a record without
page number, read back as null, and never is what others refer to while an
equal payload has a number (if none has, all are responses); an archive that
ends inside a record is an error, never a shorter result; rows that repeat
the smallest page_id of a payload are all responses; an empty table gives an
archive folder without records; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from .common import materialise, scratch_path

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: What the writer takes: the reader's columns that aren't derived from the payload.
WRITE_SCHEMA = T.StructType([SCHEMA["page_id"], SCHEMA["target_uri"], SCHEMA["refers_to"], SCHEMA["payload"]])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task goes on in a new file, and those that a reader's partition takes.
FILE_BYTES, PARTITION_BYTES = 64 << 20, 64 << 20
#: Bytes that the reader takes from a file at a time.
BLOCK = 1 << 18


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path within."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path[5:] if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# -- records ----------------------------------------------------------------


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def make_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit where refers_to is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    record = uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page_id}/{uri}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(uri)}"] if uri is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordStream:
    """Records of a .warc or .warc.gz stream: headers first, the block only if it is asked for."""

    def __init__(self, source, compressed: bool, block: int = BLOCK):
        self.source, self.compressed, self.block = source, compressed, block
        self.inflate = zlib.decompressobj(31) if compressed else None
        self.held, self.at, self.raw = b"", 0, b""
        #: Whether a gzip member has begun and not ended.
        self.inside = False

    def _more(self) -> bool:
        """Hold more plain bytes; False at the end of the stream."""
        while True:
            data = self.raw or self.source.read(self.block)
            self.raw = b""
            if not data:
                if self.inside:
                    raise ValueError("the archive ends inside a gzip member")
                return False
            if not self.compressed:
                plain = data
            else:
                plain = self.inflate.decompress(data, 1 << 20)
                self.inside = not self.inflate.eof
                if self.inflate.eof:
                    self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                else:
                    self.raw = self.inflate.unconsumed_tail
            if plain:
                self.held, self.at = self.held[self.at :] + plain, 0
                return True

    def _head(self) -> bytes | None:
        while True:
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0:
                head, self.at = self.held[self.at : end], end + 4
                return head
            if not self._more():
                if self.held[self.at :].strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record's header")
                return None

    def _take(self, n: int, keep: bool) -> bytes:
        out, left = [], n
        while left:
            part = self.held[self.at : self.at + left]
            self.at += len(part)
            left -= len(part)
            if keep:
                out.append(part)
            if left and not self._more():
                raise ValueError(f"the archive ends {left} bytes early")
        return b"".join(out)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, block) of each record; wanted(headers) is 0 to pass over it, 1 for the block's first kilobyte, 2 for all of it."""
        while (head := self._head()) is not None:
            lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
            headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}
            length = int(headers["content-length"])
            how = wanted(headers)
            first = length if how == 2 else min(length, 1024) if how else 0
            block = self._take(first, True) if how else None
            self._take(length - first + 4, False)
            if how:
                yield headers, block


def split_http(block: bytes) -> tuple[int, bytes]:
    """(the HTTP head's content length, the body)."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = next((int(line.split(b":", 1)[1]) for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")), len(body))
    return length, body


# -- reading ----------------------------------------------------------------

#: Columns whose values a record's WARC headers alone give.
HEADER_COLUMNS = {"page_id": "x-page-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page-id"}


def header_values(headers: dict[str, str]) -> dict[str, object]:
    get = headers.get
    return {
        "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None,
        "record_type": get("warc-type"),
        "target_uri": get("warc-target-uri"),
        "payload_digest": get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None,
    }


class FilesPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.names
        self.path = options["path"]
        self.verify = str(options.get("verifydigest", options.get("verifyDigest", "false"))).lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take what headers can decide; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo | In | IsNull | IsNotNull):
                self.tests.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def accepts(self, values: dict[str, object]) -> bool:
        for kind, column, value in self.tests:
            own = values[column]
            if kind == "IsNull" and own is not None or kind == "IsNotNull" and own is None:
                return False
            if kind == "EqualTo" and (own is None or own != value) or kind == "In" and (own is None or own not in value):
                return False
        return True

    def partitions(self) -> list[FilesPartition]:
        from pyarrow import fs

        store, root = file_system(self.path)
        found = store.get_file_info(root) if store.get_file_info(root).type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=False))
        files = sorted((f.path, f.size) for f in (found if isinstance(found, list) else [found]) if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", ".")))
        out, own, size = [], [], 0
        for path, n in files:
            if own and size + n > self.partition_bytes:
                out, own, size = [*out, FilesPartition(own)], [], 0
            own, size = [*own, path], size + n
        return [*out, FilesPartition(own)]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        payload = "payload" in self.names or self.verify
        need = 2 if payload else 1 if "payload_bytes" in self.names else 0
        state: dict[str, object] = {}

        def wanted(headers: dict[str, str]) -> int:
            state["values"] = values = header_values(headers)
            if not self.accepts(values):
                return 0
            return 1 if need < 2 or values["record_type"] == "revisit" else 2

        for path in partition.value:
            with store.open_input_stream(path, compression=None) as source:
                for _, block in RecordStream(source, path.endswith(".gz")).records(wanted):
                    values = state["values"]
                    length, body = split_http(block)
                    whole = values["record_type"] != "revisit"
                    if self.verify and whole and payload_digest(body) != values["payload_digest"]:
                        raise ValueError(f"{path}: the payload of page {values['page_id']} doesn't have its digest")
                    row = values | {"payload_bytes": length, "payload": body if whole and payload else None}
                    yield tuple(row[name] for name in self.names)


# -- writing ----------------------------------------------------------------


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names = schema.names
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))
        self.level = int(options.get("gziplevel", options.get("gzipLevel", 4)))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows) -> _Files:
        from pyspark import TaskContext

        store, root = file_system(self.path)
        store.create_dir(f"{root}/_pending", recursive=True)
        context = TaskContext.get()
        task = f"{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}"
        files, out, size = [], None, 0
        place = {name: self.names.index(name) for name in WRITE_SCHEMA.names}
        for row in rows:
            if out is None or size >= self.file_bytes:
                if out:
                    out.close()
                name = f"{task}-{len(files):04d}.warc.gz"
                files.append((f"{root}/_pending/{name}", f"{root}/{name}"))
                out, size = store.open_output_stream(files[-1][0], compression=None), 0
            page, uri, refers, payload = (row[place[n]] for n in WRITE_SCHEMA.names)
            squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            data = squeeze.compress(make_record(page, uri, bytes(payload or b""), refers)) + squeeze.flush()
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return _Files(files)

    def commit(self, messages) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for message in messages:
            for pending, final in message.files if message else ():
                store.move(pending, final)
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_pending")


class WarcSource(DataSource):
    """Format "warc". Options: path; read: verifyDigest, partitionBytes; write: fileBytes, gzipLevel."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, page: str = "page_id", uri: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """The writer's rows: of equal payloads of at least least_bytes, the smallest page is the response that the others revisit.

    Only digests are grouped, after partial aggregation, and only digests that
    several pages have are kept; the table of those is written and joined, so
    that Spark broadcasts it if its files are small and else splits a skewed
    digest's rows.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digest = F.unhex(F.sha1(payload))
    first = pages.where(F.octet_length(payload) >= least_bytes).select(F.col(page).cast("long").alias("first_id"), digest.alias("digest")).groupBy("digest").agg(F.min("first_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = pages.select(F.col(page).cast("long").alias("page_id"), F.col(uri).cast("string").alias("target_uri"), digest.alias("digest"), payload.alias("payload"))
    joined = own.join(materialise(first, "warc-first"), "digest", "left")
    # a page without a number revisits the numbered one
    return joined.select("page_id", "target_uri", F.expr("CASE WHEN first_id IS NOT NULL AND NOT page_id <=> first_id THEN first_id END").alias("refers_to"), "payload")


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    """Write a record per page to a folder of .warc.gz files."""
    register(pages.sparkSession)
    plan_records(pages, **columns).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The records of an archive folder; without payload among the columns none is decoded (unless verified).

    Spark hands predicates to Python sources only where the session's
    spark.sql.python.filterPushdown.enabled is set, so it is set here.
    """
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([SCHEMA[c] for c in columns]) if columns else SCHEMA
    return spark.read.format("warc").schema(schema).option("verifyDigest", verify).load(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder and read its records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_records(pages.sparkSession, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], verify=True)
