"""Packed ids, files and whole queries against the tokenizer's own output, and the defined cases."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import tokenfiles
from tallyforge.llm.common import fresh_dir

PATH = public_tokenizers.path(tokenfiles.MODEL)
ALPHABET = ["a", "b", "é", "न", "中", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "　", "'s", "'", "!", "1", "23", "<|endoftext|>", "​", " ", "😀", "\r\n", "\x85", "-", "ll", "\x00", "The", " the"]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("width", range(1, 33))
def test_pack(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003, dtype=np.uint64).astype(np.uint32)
    data = tokenfiles.pack(ids, width)
    assert len(data) == (1003 * width + 7) // 8 and (tokenfiles.unpack(data, 1003, width) == ids).all()
    assert [int("".join(f"{b:08b}"[::-1] for b in data)[k * width : (k + 1) * width][::-1], 2) for k in (0, 5, 1002)] == ids[[0, 5, 1002]].tolist()
    assert tokenfiles.pack(ids[:0], width) == b"" and not len(tokenfiles.unpack(b"", 0, width))
    if width < 32:
        with pytest.raises(ValueError, match="bits"):
            tokenfiles.pack(np.array([1 << width]), width)


def test_bits():
    assert [tokenfiles.bits_for(v) for v in (1, 2, 3, 256, 257, 32_000, 49_408, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 16, 17]


def test_encoder(model):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["", " ", "\n", "x" * 100_000, " \n" * 1000, "a" + " " * 5000 + "b"]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    mine = tokenfiles.Encoder(PATH)
    assert mine.by_chunk and list(mine.encode(texts)) == want and list(mine.encode(texts)) == want


def test_encoder_of_other_models(model):
    """A model that splits otherwise is asked for whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    mine = tokenfiles.Encoder(path)
    assert not mine.by_chunk
    assert list(mine.encode(["Two  words", ""])) == [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("Two  words", "")]


def test_few_chunks_kept(model, monkeypatch):
    monkeypatch.setattr(tokenfiles, "MOST_CHUNKS", 3)
    mine, texts = tokenfiles.Encoder(PATH), ["a b c d e f", "f e d", "x y z a"]
    for t in texts:
        assert list(mine.encode([t])) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()] and len(mine.kept) <= 3


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("width", [9, 16, 17])
@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_random_access(width, block):
    rng, out = np.random.default_rng(block), io.BytesIO()
    file = tokenfiles.TokenWriter(out, width, pa.string(), block)
    documents = [(None if i % 5 == 0 else f"d{i}", rng.integers(0, 1 << width, n).astype(np.uint32)) for i, n in enumerate([1, 0, 300, 7, 64, 2, 129])]
    for key, ids in documents:
        file.add(key, ids)
    file.close()
    every, read = np.concatenate([d[1] for d in documents]), tokenfiles.TokenFile(Source(out.getvalue()))
    assert read.documents().to_pydict() == {"doc_id": [d[0] for d in documents], "n_tokens": [len(d[1]) for d in documents]}
    for start, n in [(0, 0), (0, len(every)), (5, 1), (63, 3), (300, 100), (len(every), 0), (len(every) - 1, 1)]:
        assert (read.ids(start, n) == every[start : start + n]).all()
    with pytest.raises(IndexError):
        read.ids(len(every), 1)
    damaged = bytearray(out.getvalue())
    damaged[len(tokenfiles.MAGIC)] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles.TokenFile(Source(damaged)).ids(0, 1)
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(Source(out.getvalue()[:-1]))


DOCS = "doc_id long, text string, start string, n_tokens int, path string, part string"


def rows_for(seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(-50, 5000), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200)))) for _ in range(500)]
    return rows + [(9, None), (9, ""), (9, "same"), (9, "same"), (None, "none"), (None, None), (77, "word " * 200_000)] + [(8, None)] * 300


def test_digests(spark, model):
    rows = rows_for()
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS).repartition(5)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.token_digests(docs).collect() if r["doc_id"] is not None)
    every = tokenfiles.token_digests(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in every] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))  # null first
    assert [r["start"] for r in every] == np.cumsum([0, *(r["n_tokens"] for r in every)])[:-1].tolist()
    ids = [np.array([*e.ids, 0], "<u4") for e in model.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in every) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
    assert len(got) == len(rows) - 2
    assert not tokenfiles.token_digests(docs.limit(0)).collect()


def test_files(spark, model, monkeypatch):
    """Many small files of one partition, ids of text, another model and end; files of lost attempts are never read."""
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 10)
    docs = spark.createDataFrame([(f"k{i:03d}", f"text {i}") for i in range(95)], "doc_id string, text string")
    folder = fresh_dir(spark, "tokens")
    files = tokenfiles.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=49_407, partitions=3)
    told = files.orderBy("start").collect()
    assert len(told) >= 10 and sum(r["n_docs"] for r in told) == 95
    assert [r["start"] for r in told] == np.cumsum([0, *(r["n_ids"] for r in told)])[:-1].tolist()
    found = tokenfiles.read_tokens(files, folder, "string").orderBy("start").collect()
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [r["doc_id"] for r in found] == [f"k{i:03d}" for i in range(95)]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in found] == [[*other.encode(f"text {i}", add_special_tokens=False).ids, 49_407] for i in range(95)]


def test_hot_ids_are_dealt(spark):
    """One id with one text in a third of all rows is spread over tasks."""
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("text")).repartition(6)
    folder = fresh_dir(spark, "tokens")
    files = tokenfiles.write_tokens(docs, folder, partitions=12)
    assert files.agg(F.max("n_docs")).first()[0] < 2 * 9000 / 12 and files.agg(F.sum("n_docs")).first()[0] == 9000
