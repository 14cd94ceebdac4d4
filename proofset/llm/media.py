"""Media columns: texts stored as images in archives, read back by byte ranges.

Writing: a text's UTF-8 bytes, filled with zeros to a multiple of 64, become the
8-bit grey samples of a PNG 64 samples wide. Each task appends its images to
archives of about ``ARCHIVE_BYTES`` in the shared folder. An archive gets its final
name, which the partition, the task's attempt and a counter decide, by a move after its
last byte. The manifest lists the archives of the attempts that Spark committed, so
what failed, repeated or speculative attempts leave behind is never read.

Reading: the data source of ``archive_source`` plans byte ranges over the manifest's
archives and streams members in Arrow batches; features come from the decoded samples.

The shared folder must be a store that Arrow's file systems reach (local or
mounted paths, HDFS, S3, GCS).

Defined results
    null or empty text   64 zero bytes: an image of one line
    very long text       one member, however many lines
    null id              stays null
    repeated rows        a member each
    ties, equal texts    equal values
    empty table          empty result
    extra columns        are not read, so their names cannot clash
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm import archive_source
from proofset.llm.common import documents, scratch_path, ship

WIDTH = 64
LEVEL = 1
ARCHIVE_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up to a positive multiple of 64."""
    return text + bytes(WIDTH - len(text)) if not text else text + bytes(-len(text) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes, length: int) -> bytes:
    """A grey 8-bit PNG of ``samples``; ``length`` of them are the text's."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(lines), WIDTH + 1), dtype=np.uint8)
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return b"".join(
        (
            _SIGNATURE,
            _chunk(b"IHDR", head),
            _chunk(b"tEXt", b"Length\0%d" % length),
            _chunk(b"IDAT", zlib.compress(filtered, LEVEL)),
            _chunk(b"IEND", b""),
        )
    )


def decode(image: bytes) -> tuple[bytes, int]:
    """Samples and the text's length of an image that ``encode`` made."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, length = 8, [], b"", None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(image[at + 4 : at + 8 + n]) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"{kind!r} chunk is damaged")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        at += 12 + n
    width, height, depth, colour = struct.unpack_from(">IIBB", head)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an 8-bit grey image of this width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    samples = np.ascontiguousarray(lines[:, 1:]).tobytes()
    return samples, len(samples) if length is None else length


def feature(samples: bytes) -> str:
    """Height, mean, deviation and a 64-bit average hash over an 8 x 8 grid."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    columns = lines.reshape(len(lines), 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    edges = np.arange(8) * len(lines) // 8
    bands = np.add.reduceat(columns, edges, axis=0) if len(lines) >= 8 else np.repeat(columns.sum(axis=0, keepdims=True), 8, axis=0)
    counts = np.diff(edges, append=len(lines)) if len(lines) >= 8 else np.full(8, len(lines))
    grid = bands / (counts[:, None] * (WIDTH // 8))
    bits = "".join("1" if g else "0" for g in (grid > grid.mean()).ravel())
    return f"h{len(lines)} mean{lines.mean():.3f} dev{lines.std():.3f} hash{int(bits, 2):016x}"


class _Archive:
    """One archive being written beside its final place."""

    def __init__(self, uri: str, name: str):
        self.store, path = archive_source.open_store(uri)
        self.final, self.open_as = f"{path}/{name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.open_as)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.members = self.bytes = 0

    def add(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.members += 1
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int, int]:
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        self.store.move(self.open_as, self.final)
        return self.final, self.members, self.bytes, size


_MANIFEST_ROWS = "archive string, members long, bytes long, size long"


def write_archives(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store each row's payload under ``uri``; one row per archive: archive, members, bytes, size.

    The manifest is kept in the folder's ``MANIFEST``.
    """
    spark = docs.sparkSession
    store, path = archive_source.open_store(uri)
    store.create_dir(path, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, archive, at = TaskContext.get(), [], None, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    archive = _Archive(uri, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.zip")
                data = text.as_py() or b""
                archive.add(f"{'null' if key is None else key}_{at}.png", encode(payload(data), len(data)))
                at += 1
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["archive", "members", "bytes", "size"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    manifest = f"{uri}/{archive_source.MANIFEST}"
    rows.mapInArrow(write, _MANIFEST_ROWS).write.parquet(manifest)
    return spark.read.schema(_MANIFEST_ROWS).parquet(manifest)


def read_archives(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """The members of the archives in ``uri``'s manifest, or of all there if it has none: archive, offset, member, payload."""
    cloudpickle.register_pickle_by_value(archive_source)
    spark.dataSource.register(archive_source.ArchiveSource)
    return spark.read.format("archive_members").options(**options).load(uri)


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """One row per member: its id, digests and the image's feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        for batch in batches:
            out = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                samples, length = decode(image)
                key = name.split("_")[0]
                out.append(
                    (
                        None if key == "null" else int(key),
                        length,
                        len(samples),
                        hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-WIDTH:]),
                        len(image),
                        hashlib.sha256(image).hexdigest(),
                        feature(samples),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return members.select("member", "payload").mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, through archives in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    uri = scratch_path(spark, "media-archives")
    write_archives(docs, uri, id_col, text_col)
    return features(read_archives(spark, uri))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
