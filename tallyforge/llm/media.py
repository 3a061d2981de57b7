"""Media columns: texts stored as images in archives, read back by a custom Spark data source.

Payloads (UTF-8 bytes, padded with zeros to a positive multiple of 64) are stored as 8-bit greyscale PNG images of
width 64, members of ZIP archives in the shared folder. The data source plans partitions as byte ranges of the
archives: a partition takes the members whose header begins in its range, which it learns from the archive's own
directory, so the driver lists files and no more. Members stream through Arrow in batches; one that fails to read, or
fails its checksum, is read again from its own offset, up to ATTEMPTS times, without the others.

Archives are written as drafts of one attempt of a task; the attempt that Spark commits tells theirs, and only those
are moved into place, so what a lost or repeated task leaves behind is never read, whatever rows it was dealt.

Defined cases: null text counts as empty, whose payload is 64 zeros; equal texts give equal media; rows of equal or
null id are members of their own, and an empty id is not a null one; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import bounded, fresh_dir, open_store, stage

WIDTH = 64
LEVEL = 4
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
#: Ranges that the driver plans, beside one for each archive.
MOST_RANGES = 100_000
ATTEMPTS, WAIT_S = 3, 0.05
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_CHUNK = 1 << 30
DRAFTS = "drafts"
MEMBER = "member string, archive string, offset long, media binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def to_png(data: bytes, n_bytes: int) -> bytes:
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter 0: stored as it is
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(rows.tobytes(), LEVEL)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0" + str(n_bytes).encode())
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", packed[i : i + MOST_CHUNK]) for i in range(0, len(packed), MOST_CHUNK)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples (height x WIDTH) and the number of payload bytes before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, n_bytes, shape = 8, [], 0, (0, 0)
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n_bytes = int(data[6:])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:], n_bytes


def member_name(key) -> str:
    """A file name that tells null, the empty text and any other id apart."""
    return "none" if key is None else "id-" + quote(str(key), safe="")


def member_key(member: str) -> str | None:
    name = member.split("/", 1)[1][: -len(".png")]
    return unquote(name[len("id-") :]) if name.startswith("id-") else None


def write_archives(docs: DataFrame, folder: str) -> int:
    """Stores each text of docs as a member of an archive in folder; returns their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(f"{root}/{DRAFTS}", recursive=True)
        task, part, n, held, done, tried = TaskContext.get(), 0, 0, 0, [], uuid.uuid4().hex
        buffer = io.BytesIO()
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def put() -> None:
            nonlocal buffer, archive, part
            archive.close()
            draft = f"{root}/{DRAFTS}/{tried}-{part:05d}.zip"
            with store.open_output_stream(draft) as out:
                out.write(buffer.getbuffer())
            done.append((draft, f"{root}/media-{task.partitionId():07d}-{part:05d}.zip", held))
            buffer, part = io.BytesIO(), part + 1
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data, size = payload(text.as_py())
                key = key.as_py()
                archive.writestr(zipfile.ZipInfo(f"{n:09d}/{member_name(key)}.png"), to_png(data, size))
                n, held = n + 1, held + 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    put()
                    held = 0
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["draft", "name", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for draft, name in zip(batch.column("draft").to_pylist(), batch.column("name").to_pylist(), strict=True):
                with contextlib.suppress(FileNotFoundError):  # then another attempt has moved it
                    store.move(draft, name)
                if store.get_file_info(name).type == pa.fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield batch.select(["n"])

    kept = stage(docs.select("doc_id", "text").mapInArrow(bounded(work), "draft string, name string, n long"), "archives")
    return kept.mapInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, root = open_store(self.folder)
        found = store.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
        archives = sorted((f for f in found if f.path.endswith(".zip")), key=lambda f: f.path)
        step = max(self.range_bytes, -(-sum(f.size for f in archives) // MOST_RANGES))  # longer ranges, not more of them, for large folders
        ranges = [ByteRange(f.path, at, at + step) for f in archives for at in range(0, f.size, step)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = open_store(self.folder)
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        names, offsets, media, held = [], [], [], 0
        source = store.open_input_file(partition.path)
        for m in sorted(members, key=lambda m: m.header_offset):
            for attempt in range(1, ATTEMPTS + 1):
                try:
                    data = read_member(source, m.header_offset, m.compress_size, m.CRC)
                    break
                except (OSError, ValueError, struct.error):
                    if attempt == ATTEMPTS:
                        raise
                    time.sleep(WAIT_S * attempt)
                    source = store.open_input_file(partition.path)
            names.append(m.filename)
            offsets.append(m.header_offset)
            media.append(data)
            held += len(data)
            if held >= BATCH_BYTES:
                yield self._batch(names, offsets, media, partition.path)
                names, offsets, media, held = [], [], [], 0
        if names:
            yield self._batch(names, offsets, media, partition.path)

    @staticmethod
    def _batch(names: list[str], offsets: list[int], media: list[bytes], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([path] * len(names), pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], ["member", "archive", "offset", "media"])


def read_member(source, offset: int, size: int, crc: int) -> bytes:
    """One stored member, from the header at offset; ValueError if it isn't whole."""
    source.seek(offset)
    head = source.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    source.seek(offset + 30 + name + extra)
    data = source.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}")
    return data


class ArchiveSource(DataSource):
    """spark.read.format("tallyforge_archives").option("folder", ...): one row for each member."""

    @classmethod
    def name(cls) -> str:
        return "tallyforge_archives"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["folder"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("folder", folder).option("range_bytes", range_bytes).load()


def feature(samples: np.ndarray) -> str:
    """Height, least and most sample, sum, squares, and how many samples each eighth of the range holds."""
    x = samples.astype(np.int64)
    return f"h={len(x)};min={x.min()};max={x.max()};sum={x.sum()};sq={(x * x).sum()};hist=" + ",".join(map(str, np.bincount((x >> 5).ravel(), minlength=8)))


def describe(media: DataFrame, key: str = "bigint") -> DataFrame:
    """What op5 returns, from members read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, data in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples, n = from_png(data)
                raw = samples.tobytes()
                rows.append((member_key(member), n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.select("member", "media").mapInArrow(bounded(work), "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("doc_id", F.col("doc_id").cast(key))


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs, reads it back and describes it."""
    folder = fresh_dir(docs.sparkSession, "media")
    write_archives(docs, folder)
    return describe(read_archives(docs.sparkSession, folder), docs.schema["doc_id"].dataType.simpleString())
