"""Submissions as a Python data source: one ZIP is one supplier, every entry a parsed file; or loose files.

``spark.read.format("submissions").option("paths", ...)`` plans a partition
per archive (loose files in lots by size) and parses within the reader, so
file contents never reach a shuffle. on_error="fail" (default) stops at an
archive that isn't safe or readable, "quarantine" gives a row with its error
instead.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .parsers import Limits, parse_file, read_entry, safe_entries

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("submission_id", "supplier", "zip_name", "zip_path", "zip_sha256", "path", "source_path", "name", "kind", "mime", "extension")]
    + [T.StructField("extension_mismatch", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("ord", T.LongType())]
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
    + [T.StructField(n, T.StringType()) for n in ("fingerprint", "sample", "parse_error", "archive_error")]
)
LOOSE_SUPPLIER = "本地文件"
#: Places of one submission's files within the order of the project; bytes of loose files of one task.
SPAN, LOT = 1 << 24, 256 << 20


class Lot(InputPartition):
    def __init__(self, number: int, paths: list[str], loose: bool):
        super().__init__((number, paths, loose))


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _read(path: str, limit: int) -> bytes:
    store, own = _store(path)
    if store.get_file_info(own).size > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    with store.open_input_stream(own, compression=None) as source:
        return source.read()


class SubmissionReader(DataSourceReader):
    def __init__(self, options: dict):
        given = options.get("paths") or options["path"]
        self.paths = list(dict.fromkeys(json.loads(given) if given.startswith("[") else [given]))
        self.loose = options.get("mode", "compare") == "files"
        self.quarantine = options.get("on_error", "fail") == "quarantine"
        self.author = options.get("office_author", "reference")
        self.limits = Limits()

    def partitions(self) -> list[Lot]:
        if not self.loose:
            return [Lot(i, [p], False) for i, p in enumerate(self.paths)]
        lots, size = [[]], 0
        for path in self.paths:
            store, own = _store(path)
            n = store.get_file_info(own).size or 0
            if lots[-1] and size + n > LOT:
                lots.append([])
                size = 0
            lots[-1].append(path)
            size += n
        starts = [sum(map(len, lots[:i])) for i in range(len(lots))]
        return [Lot(start, lot, True) for start, lot in zip(starts, lots, strict=True)]

    def read(self, partition: Lot) -> Iterator[tuple]:
        number, paths, loose = partition.value
        yield from self._loose(number, paths) if loose else self._archive(number, paths[0])

    def _row(self, place: dict, path: str, source: str, data: bytes, order: int) -> tuple:
        mime, kind, own = parse_file(path, data, self.author)
        row = place | {"path": path, "source_path": source, "name": os.path.basename(path), "kind": kind, "mime": mime, "extension": os.path.splitext(path)[1].lower(), "extension_mismatch": False, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "ord": order, "attributes": own.attributes, "lists": own.lists, "fingerprint": own.fingerprint, "sample": own.sample, "parse_error": own.error, "archive_error": None}
        return tuple(row.get(n) for n in SCHEMA.names)

    def _archive(self, number: int, path: str) -> Iterator[tuple]:
        name = os.path.basename(path)
        place = {"submission_id": hashlib.sha256(path.encode()).hexdigest()[:16], "supplier": os.path.splitext(name)[0], "zip_name": name, "zip_path": path}
        try:
            data = _read(path, self.limits.total)
            place["zip_sha256"] = hashlib.sha256(data).hexdigest()
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                entries, _ = safe_entries(archive, self.limits)
                del data
                for i, (own, info) in enumerate(entries):
                    if not own.endswith("/"):
                        yield self._row(place, own, "", read_entry(archive, info), number * SPAN + i)
        except Exception as error:
            if not self.quarantine:
                raise
            row = place | {"ord": number * SPAN, "archive_error": str(error) or type(error).__name__}
            yield tuple(row.get(n) for n in SCHEMA.names)

    def _loose(self, start: int, paths: list[str]) -> Iterator[tuple]:
        place = {"submission_id": "loose", "supplier": LOOSE_SUPPLIER, "zip_name": "", "zip_path": "", "zip_sha256": ""}
        for i, path in enumerate(paths):
            yield self._row(place, os.path.basename(path), path, _read(path, self.limits.entry), start + i)


class SubmissionSource(DataSource):
    """Format "submissions". Options: paths (JSON list) or path, mode compare/files, on_error fail/quarantine, office_author reference/core."""

    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> SubmissionReader:
        return SubmissionReader(dict(self.options))


def read_submissions(spark: SparkSession, paths: list[str], mode: str = "compare", **options: str) -> DataFrame:
    """A row per file of the archives (or of the loose files); repeated paths are read once. Comparing takes two archives."""
    if mode == "compare" and len(set(paths)) < 2:
        raise ValueError("two archives or more are needed")
    spark.dataSource.register(SubmissionSource)
    return spark.read.format("submissions").option("paths", json.dumps(list(dict.fromkeys(paths)))).option("mode", mode).options(**options).load()


def quarantined(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, archives that could not be read)."""
    return files.where(F.col("archive_error").isNull()).drop("archive_error"), files.where(F.col("archive_error").isNotNull()).select("zip_path", "supplier", "archive_error")
