"""Media columns: lossless images in archives, read through a Spark data source.

Payloads of 8-bit samples are stored as grey PNG images, many to a ZIP archive
(members stored as they are, since PNG compresses). Archives are built in
memory up to a size, then written in one go under a name no other attempt
uses. Where each archive's directory lies goes to an index, a Parquet table
beside the archives; only the archives of successful tasks are in it, and only
those are ever read.

Member names have a fixed length, so directory entries do too. The data source
``archive_members`` takes the index, plans partitions as byte ranges of the
archives' directories (several small archives to one partition) without opening
an archive, and executors read only their ranges. Members that lie close together are fetched in one read. A
member that can't be read or fails its checksum is read again by its offset,
alone, a few times; then the job fails rather than lose it. Batches of bounded
size go to Spark as Arrow records.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import column_of, shared_path, slices

UNIT = 576
_PNG = b"\x89PNG\r\n\x1a\n"
_NAME = 41  # bytes of a member's name
_ENTRY = 46 + _NAME
MOST_MEMBERS = 60_000  # below the 65,535 that a plain directory can count


def filesystem(uri: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def fs_selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(samples: bytes, width: int = UNIT) -> bytes:
    """A grey 8-bit PNG whose rows are ``samples`` from left to right, top to bottom."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)  # a row starts with its filter, 0: none
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_decode(image: bytes) -> bytes:
    """The samples of an image that :func:`png_encode` made; ValueError if it is damaged."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, size, data = 8, None, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"the {kind!r} chunk fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("the image has no header")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("the image uses row filters")
    return rows[:, 1:].tobytes()


def member_name(number: int, doc_id: int | None) -> bytes:
    """Of fixed length: a number unique in the archive, and the id."""
    return b"%012d_%s.png" % (number, b"null".rjust(24, b"_") if doc_id is None else b"%+024d" % doc_id)


def member_id(name: bytes) -> int | None:
    return None if name.endswith(b"_null.png") else int(name[13:37])


class ArchiveBuilder:
    """A ZIP archive of stored members, in memory."""

    def __init__(self):
        self.body, self.entries, self.members = io.BytesIO(), [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        name = member_name(self.members, doc_id)
        fixed = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(name), 0)
        self.entries.append(b"PK\x01\x02" + struct.pack("<H", 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, self.body.tell()) + name)
        self.body.write(b"PK\x03\x04" + fixed + name)
        self.body.write(data)
        self.members += 1

    def close(self) -> tuple[bytes, int, int]:
        """The archive, and where its directory starts and how long it is."""
        at, directory = self.body.tell(), b"".join(self.entries)
        self.body.write(directory)
        self.body.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, self.members, self.members, len(directory), at, 0))
        return self.body.getvalue(), at, len(directory)


INDEX = "archive string, directory long, directory_bytes long"


def store_payloads(docs: DataFrame, folder: str, *, archive_bytes: int = 32_000_000, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Store every row's text as an image in archives under ``folder``; returns the path of their index.

    Null texts are empty. The index has one row (:data:`INDEX`) per archive,
    and a file per task.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = filesystem(folder)
        target.create_dir(base, recursive=True)
        builder = ArchiveBuilder()

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            data, at, size = builder.close()
            with target.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([size], pa.int64())], names=["archive", "directory", "directory_bytes"])

        for batch in batches:
            ids = column_of(batch, "doc_id").to_pylist()
            for first, texts in slices(column_of(batch, "text")):
                for at, text in enumerate(texts, first):
                    builder.add(ids[at], png_encode(padded(text.encode())))
                    if builder.body.tell() >= archive_bytes or builder.members >= MOST_MEMBERS:
                        yield flush()
                        builder = ArchiveBuilder()
        if builder.members:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    index = f"{folder}/index"
    rows.mapInArrow(store, INDEX).write.parquet(index)
    return index


@dataclass
class DirectoryRanges(InputPartition):
    """Bytes ``start .. end`` of the directories of some archives, as (archive, start, end)."""

    ranges: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["folder"].rstrip("/")
        self.range_bytes = max(1, int(options.get("rangebytes", 512_000)) // _ENTRY) * _ENTRY
        self.partition_bytes = int(options.get("partitionbytes", 128_000_000))
        self.batch_bytes = int(options.get("batchbytes", 8_000_000))
        self.attempts = int(options.get("attempts", 4))

    def partitions(self) -> list[DirectoryRanges]:
        """Byte ranges of all directories, gathered up to ``partitionbytes`` of archives, from the index alone."""
        import pyarrow.parquet as pq

        store, path = filesystem(f"{self.folder}/index")
        out, held = [], 0
        for part in sorted(f.path for f in store.get_file_info(fs_selector(path)) if f.base_name.endswith(".parquet")):
            with store.open_input_file(part) as f:
                for name, at, size in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["archive", "directory", "directory_bytes"]).columns)):
                    if size % _ENTRY:
                        raise ValueError(f"{name} isn't an archive of this module")
                    for a in range(0, size, self.range_bytes):
                        end = min(a + self.range_bytes, size)
                        # members lie before the directory, about evenly
                        share = at * (end - a) // max(size, 1)
                        if not out or size > self.range_bytes or held + share > self.partition_bytes:
                            out.append(DirectoryRanges([]))
                            held = 0
                        out[-1].ranges.append((name, at + a, at + end))
                        held += share
        return out

    def read(self, partition: DirectoryRanges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        store, base = filesystem(self.folder)
        for archive, start, end in partition.ranges:
            path = f"{base}/{archive}"
            directory = self._again(lambda path=path, start=start, end=end: self._bytes(store, path, start, end - start))
            members = []
            for at in range(0, len(directory), _ENTRY):
                if directory[at : at + 4] != b"PK\x01\x02":
                    raise ValueError(f"{path} has no directory at {start}")
                crc, size = struct.unpack_from("<II", directory, at + 16)
                members.append((struct.unpack_from("<I", directory, at + 42)[0] + 30 + _NAME, size, crc, directory[at + 46 : at + _ENTRY]))
            group, held = [], 0
            for member in members:
                if group and held + member[1] > self.batch_bytes:
                    yield self._batch(store, path, group)
                    group, held = [], 0
                group.append(member)
                held += member[1]
            if group:
                yield self._batch(store, path, group)

    def _bytes(self, store, path: str, at: int, size: int) -> bytes:
        with store.open_input_file(path) as f:
            f.seek(at)
            data = f.read(size)
        if len(data) != size:
            raise OSError(f"{path} ended at {at + len(data)}")
        return data

    def _again(self, get):
        for attempt in range(self.attempts):
            try:
                return get()
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)

    def _batch(self, store, path: str, group: list[tuple]) -> pa.RecordBatch:
        first = group[0][0]
        try:
            together = self._bytes(store, path, first, group[-1][0] + group[-1][1] - first)
        except OSError:
            together = b""
        out = []
        for at, size, crc, _ in group:
            data = together[at - first : at - first + size]
            if len(data) != size or zlib.crc32(data) != crc:
                data = self._again(lambda at=at, size=size, crc=crc: self._member(store, path, at, size, crc))
            out.append(data)
        return pa.RecordBatch.from_arrays([pa.array([member_id(m[3]) for m in group], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "media"])

    def _member(self, store, path: str, at: int, size: int, crc: int) -> bytes:
        data = self._bytes(store, path, at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"{path}: the member at {at} fails its checksum")
        return data


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").option("folder", ...)``, of archives with their index."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def media_rows(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` and ``media`` (the stored image) for every row of ``docs``, read back from archives."""
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    store_payloads(docs, folder, **options)
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("folder", folder).load()


def describe_payload(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and the share of the commonest one."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / max(1, counts.sum())
    mean = float(p @ np.arange(256))
    spread = float(p @ (np.arange(256) - mean) ** 2) ** 0.5
    some = p[p > 0]
    return f"mean={mean:.3f};std={spread:.3f};entropy={float(-(some * np.log2(some)).sum()):.4f};top={int(counts.argmax())}:{float(p.max()):.4f}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode every image and compute digests and features of its samples."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in column_of(batch, "media"):
                image = stored.as_py()
                payload = png_decode(image)
                # 255 never occurs in UTF-8, so the padding ends the text
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), describe_payload(payload)))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [f.split()[0] for f in MEDIA_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return media.mapInArrow(compute, MEDIA_SCHEMA)
