"""Token ids in binary files: every id in the fewest bits that the vocabulary needs, in blocks that can be read alone.

A file is MAGIC, blocks, a table of its documents, the blocks' places and checksums, and a trailer:

    blocks      BLOCK ids each, the last fewer; id k of a block takes bits k * width to (k + 1) * width - 1, least first
    documents   an Arrow stream: doc_id (any type) and n_tokens of each document, in order
    places      of each block: where it begins (64 bits) and its crc32 (32 bits), little-endian
    trailer     width, ids a block (32 bits each), ids, blocks, where the documents and the places begin (64 each), MAGIC

Ids unpack in numpy, a block at a time, and any range of ids is read from the blocks that hold it.

Writing: rows are dealt by ranges of (doc_id, hash of the text, place in the input), so that neither one id nor one
text fills a task, sorted, encoded and written as they come. A task names its files by its own attempt and returns
their list; the staged list is the only way to them, so what a lost or repeated task leaves is never read. Reading
starts from that list, with the number of ids in all files before.

A text is encoded by its distinct chunks, each a word with the space before it, or white space: no token of a byte-level
model crosses from one to the next, so the ids are those of the whole text. Texts with other
kinds of white space, or with the name of a special token, are encoded whole. A worker keeps the ids of MOST_CHUNKS chunks.

Defined cases: a null text counts as empty and has the end id only; ids come in ascending order, null first; rows of one
id by the hash of the text; equal rows are rows of their own; an empty table gives no file and no row; other columns are
ignored, whatever their names; an id that the width can't hold fails.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded, fresh_dir, open_store, stage

MODEL = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"TFTOKEN1"
TRAILER = struct.Struct("<IIQQQQ8s")
PLACE = np.dtype([("at", "<u8"), ("crc", "<u4")])
BLOCK = 1 << 16
#: A file ends with the document that reaches one of these.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 19
MOST_CHUNKS = 1_000_000
OUT_BYTES = 4 << 20
#: Tasks that read files, one for each or more.
MOST_TASKS = 4096
_SPACE = r"[ \t\n\r\x0b\x0c]"
_WORD = r"[^ \t\n\r\x0b\x0c]"
#: A word with one space before it; white space up to the last of a run before a word; a run at the end; a break before a word.
_chunks = re.compile(f" ?{_WORD}+|{_SPACE}+(?={_SPACE}{_WORD})|{_SPACE}+(?!{_WORD})|{_SPACE}")
_plain = re.compile(f" ?{_WORD}").match
#: White space beyond the six ASCII kinds, to whichever standard.
_odd_space = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    padded = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))).astype(np.uint64)
    bit = np.arange(n, dtype=np.int64) * width
    at, out = bit >> 3, np.zeros(n, np.uint64)
    for k in range((width + 7) // 8 + 1):  # an id touches so many bytes at most
        out |= padded[at + k] << np.uint64(8 * k)
    return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class TokenWriter:
    """One file, to a stream that is only appended to."""

    def __init__(self, out, width: int, kind: pa.DataType, block: int = BLOCK):
        self.out, self.width, self.kind, self.block = out, width, kind, block
        self.at, self.n_ids, self.places, self.held, self.waiting = 0, 0, [], [], 0
        self.keys, self.sizes = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) // self.block * self.block
            for at in range(0, full, self.block):
                self._block(ids[at : at + self.block])
            self.held, self.waiting = [ids[full:].copy()], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.places.append((self.at, zlib.crc32(data)))
        self._put(data)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        documents_at, sink = self.at, pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(self.keys, self.kind), "n_tokens": pa.array(self.sizes, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self._put(sink.getvalue().to_pybytes())
        places_at = self.at
        self._put(np.array(self.places, PLACE).tobytes())
        self._put(TRAILER.pack(self.width, self.block, self.n_ids, len(self.places), documents_at, places_at, MAGIC))


class TokenFile:
    """A file to read from: documents (a table), n_ids and any range of ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.width, self.block, self.n_ids, n_blocks, self.documents_at, places_at, magic = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or not whole")
        self.places = np.frombuffer(self._bytes(places_at, n_blocks * PLACE.itemsize), PLACE)
        self.places_at = places_at

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("a token file ends early")
        return data

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self._bytes(self.documents_at, self.places_at - self.documents_at)).read_all()

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n - 1 of the file, from their blocks alone."""
        if start < 0 or n < 0 or start + n > self.n_ids:
            raise IndexError(f"ids {start} to {start + n} of {self.n_ids}")
        found, first = [np.zeros(0, np.uint32)], start // self.block
        for b in range(first, -(-(start + n) // self.block)):
            found.append(self._block(b))
        return np.concatenate(found)[start - first * self.block :][:n]

    @functools.lru_cache(maxsize=2)  # noqa: B019 - neighbours share a block, and a file is closed soon
    def _block(self, b: int) -> np.ndarray:
        count = min(self.block, self.n_ids - b * self.block)
        data = self._bytes(int(self.places["at"][b]), (count * self.width + 7) // 8)
        if zlib.crc32(data) != self.places["crc"][b]:
            raise ValueError(f"block {b} of a token file is damaged")
        return unpack(data, count, self.width)


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, by a model of the tokenizers library."""

    def __init__(self, model: str):
        with open(model, "rb") as f:
            told = f.read()
        self.model = Tokenizer.from_str(told.decode())
        said = json.loads(told)
        before = said.get("pre_tokenizer") or {}
        #: Chunks stand for themselves only where nothing but a byte-level split comes before the model.
        self.by_chunk = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.added = [x["content"] for x in said.get("added_tokens", ())]
        self.kept: dict[str, bytes] = {}

        lines = self.model.encode("\n", add_special_tokens=False).ids
        self.line = lines[0] if len(lines) == 1 else None

    def _by_chunk(self, text: str) -> bool:
        return self.by_chunk and not _odd_space.search(text) and not any(x in text for x in self.added)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, chunks: list[str]) -> None:
        """Keeps the ids of chunks: those without a line break together, one a line, the others one by one."""
        plain = [c for c in chunks if _plain(c)] if self.line is not None else []
        for c in set(chunks).difference(plain):
            self.kept[c] = self._whole(c).tobytes()
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self._whole("\n".join(some))
            cuts = np.flatnonzero(ids == self.line) * 4
            data = ids.tobytes()
            if len(cuts) != len(some) - 1:
                raise ValueError("a chunk holds the id of a line break")
            self.kept.update((c, data[b + 4 if b >= 0 else 0 : e]) for c, b, e in zip(some, [-1, *cuts.tolist()], [*cuts.tolist(), len(data)], strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [_chunks.findall(t) if self._by_chunk(t) else None for t in texts]
        new = list(set().union(*(s for s in split if s)).difference(self.kept))
        self._new(new)
        for text, chunks in zip(texts, split, strict=True):
            yield self._whole(text).tobytes() if chunks is None else b"".join(map(self.kept.__getitem__, chunks))
        for c in new[max(0, MOST_CHUNKS - len(self.kept) + len(new)) :]:
            del self.kept[c]


@functools.cache
def encoder(model: str) -> Encoder:
    """One for each worker: its chunks serve all of the worker's tasks."""
    return Encoder(model)


def vocabulary_size(model: str) -> int:
    return Tokenizer.from_file(model).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, folder: str, model: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Writes all texts of docs to files in folder; returns their list: path, start (ids in the files before), n_ids, n_docs."""
    model = model or public_tokenizers.path(MODEL)
    width = bits_for(max(vocabulary_size(model), end_id + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task, mine, end = TaskContext.get(), encoder(model), np.array([end_id], np.uint32)
        done, out, file, tried = [], None, None, uuid.uuid4().hex[:12]

        def finish() -> None:
            file.close()
            out.close()
            done[-1] += (file.n_ids, len(file.keys))

        for batch in batches:
            keys = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, found in zip(keys, mine.encode(texts), strict=True):
                if file is None:
                    path = f"{root}/tokens-{task.partitionId():07d}-{len(done):05d}-{tried}.bin"
                    out = store.open_output_stream(path)
                    file = TokenWriter(out, width, keys.type)
                    done.append((task.partitionId(), len(done), path))
                file.add(key.as_py(), np.concatenate((np.frombuffer(found, "<u4"), end)))
                if file.n_ids >= FILE_IDS or len(file.keys) >= FILE_DOCS:
                    finish()
                    file = None
        if file is not None:
            finish()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in enumerate(kinds)], ["part", "piece", "path", "n_ids", "n_docs"])

    key = [F.col("doc_id"), F.col("_tf_hash"), F.col("_tf_place")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tf_hash"), F.monotonically_increasing_id().alias("_tf_place"))
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *key).sortWithinPartitions("doc_id", "_tf_hash")
    files = stage(dealt.select("doc_id", "text").mapInArrow(bounded(work), "part int, piece int, path string, n_ids long, n_docs long"), "token_files")
    # Two levels: ids of the parts before, a row for each part, and inside a part of the files before.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "part").select("path", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"), "n_ids", "n_docs")


def _emit(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])


def documents_in(source, start: int = 0) -> Iterator[tuple]:
    """doc_id, start, n_tokens and ids (little-endian, 32 bits each) of each document of an open file, start counted from the one given."""
    file, at = TokenFile(source), 0
    for batch in file.documents().to_batches():
        for key, n in zip(batch.column("doc_id"), batch.column("n_tokens").to_pylist(), strict=True):
            yield key.as_py(), start + at, n, file.ids(at, n).astype("<u4").tobytes()
            at += n


def read_tokens(files: DataFrame, folder: str, key: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the listed files; key: the type of doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    yield from _batches(documents_in(source, start), _key_type(source))

    # A file is a unit of work. The number is named, or Spark would put the short list into one task.
    tasks = max(1, min(MOST_TASKS, files.count()))
    return files.select("path", "start").repartition(tasks, "path").mapInArrow(bounded(work), f"doc_id {key}, start long, n_tokens long, ids binary")


def _key_type(source) -> pa.DataType:
    return TokenFile(source).documents().schema.field("doc_id").type


def _batches(rows: Iterable[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 24
        if size >= OUT_BYTES:
            yield _emit(held, kind)
            held, size = [], 0
    if held:
        yield _emit(held, kind)


def token_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """What op12 returns: every document of the files written from docs, and the crc32 of its ids."""
    folder = fresh_dir(docs.sparkSession, "tokens")
    files = write_tokens(docs, folder, model)
    found = read_tokens(files, folder, docs.schema["doc_id"].dataType.simpleString())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
