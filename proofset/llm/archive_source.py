"""A Spark data source over a directory of ZIP archives with stored members.

Planning takes the archives of the directory's manifest, or lists the directory if
there is none, and cuts each archive into byte ranges; it opens no archive. A task reads the index of its archive and takes the members whose header
begins in its range, so each member has one reader. Members are read by offset and
checked against their CRC, each retried by itself with a fresh handle; payloads
leave in Arrow batches of bounded size.

This module imports nothing of the package, so that its classes can be sent to
workers by value.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The folder of Parquet files (archive, size) in a directory that says which archives count.
MANIFEST = "_manifest"
SCHEMA = "archive string, offset long, member string, payload binary"
_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("payload", pa.binary())])


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


def open_store(uri: str):
    """The file system and path of a directory's URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_member(store, archive: str, offset: int, size: int, crc: int, attempts: int, pause: float) -> bytes:
    """The stored bytes of the member whose local header is at ``offset``."""
    for attempt in range(1, attempts + 1):
        try:
            with store.open_input_file(archive) as f:
                head = f.read_at(30, offset)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {offset} of {archive}")
                name, extra = struct.unpack_from("<HH", head, 26)
                data = f.read_at(size, offset + 30 + name + extra)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError(f"member at {offset} of {archive} is damaged")
            return data
        except OSError:
            if attempt == attempts:
                raise
            time.sleep(pause * attempt)
    raise AssertionError


def _archives(uri: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the archives that count."""
    from pyarrow import fs, parquet

    store, path = open_store(uri)
    listed = lambda folder: [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._"]
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        yield from ((f.path, f.size) for f in listed(path) if f.base_name.endswith(".zip"))
        return
    for f in listed(f"{path}/{MANIFEST}"):
        rows = parquet.read_table(f.path, filesystem=store, columns=["archive", "size"])
        yield from zip(rows["archive"].to_pylist(), rows["size"].to_pylist(), strict=True)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 8 << 20))
        self.attempts = int(options.get("attempts", 4))
        self.pause = float(options.get("pause", 0.2))

    def partitions(self) -> list[ByteRange]:
        ranges = [ByteRange(path, a, min(a + self.split, size)) for path, size in sorted(_archives(self.uri)) for a in range(0, size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = open_store(self.uri)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            members = sorted(
                (m.header_offset, m.compress_size, m.CRC, m.filename, m.compress_type)
                for m in z.infolist()
                if partition.start <= m.header_offset < partition.end
            )
        rows, held = [], 0
        for offset, size, crc, name, kind in members:
            if kind != zipfile.ZIP_STORED:
                raise ValueError(f"{name} in {partition.archive} is compressed; only stored members are read")
            rows.append((partition.archive, offset, name, read_member(store, partition.archive, offset, size, crc, self.attempts, self.pause)))
            held += size
            if held >= self.batch:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").load(directory)``

    Options: splitBytes (bytes of an archive to a task), batchBytes (payload to a
    batch), attempts and pause (seconds, times the attempt) for each member.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})
