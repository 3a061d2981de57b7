"""Language-model scores by stupid backoff, computed relationally from the corpus itself.

Documents are dealt into blocks of BLOCK_BYTES or so. Each block gives its distinct n-grams of order 1 and 2 as sorted
64-bit hashes with counts, cut by hash range; the parts of a range meet in one task, which is the count table of that
range, and every block gets its n-grams' corpus counts back and sums each document's score. Both relations, n-gram
parts and documents, come from one shuffle of the texts. A hot n-gram is one entry of each block that holds it. A part
that is empty is no row, so rows never pass the distinct n-grams of the blocks, however many ranges there are.

Counts leave the scored document out, so a document's own words don't vouch for it: with c the count in all other
documents and N their words, a word after a history scores ln(c(h w) / c(h)) if c(h w) > 0, else ln(ALPHA) plus its
score alone, which is ln(c(w) / N) or, if no other document has it, ln(ALPHA / N). Each word's score is rounded to
1e-6, so that sums are whole numbers of those and don't depend on their order.

Defined cases: words count A-Z as a-z; null, empty or blank text has 0 words and null scores; equal texts with
different ids vouch for each other; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded
from .textvec import mix, word_hashes

ALPHA = 0.4
BLOCK_BYTES = 8 << 20
#: Bytes of hashes that one range of the count table takes in, or so.
RANGE_BYTES = 8 << 20
_U = np.uint64


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of 6 bytes, where they fit, else as they are; the first byte tells which."""
    steps = np.diff(hashes, prepend=hashes[:1])
    if len(hashes) and steps.max() < 1 << 48:
        return b"d" + hashes[:1].tobytes() + np.ascontiguousarray(steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"w" + hashes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(data, _U, offset=1)
    steps = np.zeros(((len(data) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.concatenate([np.frombuffer(data, _U, 1, offset=1), steps.view("<u8").ravel()]), dtype=_U)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where all fit, else in 8; the first byte tells which."""
    wide = len(counts) > 0 and int(counts.max()) >= 1 << 32
    return (b"8" if wide else b"4") + counts.astype(np.uint64 if wide else np.uint32).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if data[:1] == b"8" else np.uint32, offset=1).astype(np.int64)


def _bigrams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of one document, and the index of each second word."""
    follows = np.ones(len(words), bool)
    follows[at[:-1][at[:-1] < len(words)]] = False
    i = np.flatnonzero(follows)
    return mix(mix(words[i - 1]) * _U(3) + words[i]), i


def _parts(order: int, grams: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Range, hashes and counts of the distinct grams; ranges are the first bits of the hash, after the order's."""
    if not len(grams):
        return
    hashes, counts = np.unique(grams, return_counts=True)
    ranges = (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(hashes)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (order << 32) + int(ranges[a]), pack(hashes[a:b]), narrow(counts[a:b])


def _count(table: pa.Table) -> pa.Table:
    """One range: the parts of all blocks in, the same parts with corpus counts out."""
    parts = [unpack(x) for x in table.column("hashes").to_pylist()]
    own = [widened(x) for x in table.column("counts").to_pylist()]
    every, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, inverse, np.concatenate(own))
    ends = np.cumsum([len(p) for p in parts])
    totals = [narrow(total[inverse[e - len(p) : e]]) for p, e in zip(parts, ends, strict=True)]
    return pa.table({"g": table.column("g"), "part": table.column("part"), "totals": pa.array(totals, pa.binary())})


def _looked_up(grams: np.ndarray, order: int, back: list[tuple[int, bytes]], doc: np.ndarray) -> np.ndarray:
    """For each gram, how often other documents have it."""
    if not len(grams):
        return np.zeros(0, np.int64)
    hashes, at = np.unique(grams, return_inverse=True)
    total = np.concatenate([widened(b) for p, b in back if p >> 32 == order])
    _, pair, mine = np.unique(doc * len(hashes) + at, return_inverse=True, return_counts=True)
    return total[at] - mine[pair]


def score(docs: DataFrame, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_seen (words whose pair with the word before occurs elsewhere), log_score (sum), mean_log_score."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textvec import utf8

        for batch in batches:
            words = sum(len(word_hashes(batch.column("text")[i : i + 500])[0]) for i in range(0, batch.num_rows, 500))
            at = utf8(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([pa.array([int(at[-1] - at[0])]), pa.array([words])], ["b", "w"])

    n_bytes, n_words = docs.select("text").mapInArrow(bounded(size), "b long, w long").agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    blocks = max(1, -(-n_bytes // block_bytes))
    bits = max(0, (-(-8 * n_words // RANGE_BYTES) - 1).bit_length())
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("g")).repartition(blocks, "g")

    def extract(table: pa.Table) -> pa.Table:
        words, at = word_hashes(table.column("text"))
        rows = [*_parts(1, words, bits), *_parts(2, _bigrams(words, at)[0], bits)]
        g = table.column("g")[0].as_py()
        part, hashes, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"g": pa.array([g] * len(rows), pa.int64()), "part": pa.array(part, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        words, at = word_hashes(table.column("text"))
        parts = sorted(zip(back.column("part").to_pylist(), back.column("totals").to_pylist(), strict=True))
        sizes = np.diff(at)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pairs, second = _bigrams(words, at)
        alone, joint = _looked_up(words, 1, parts, doc), _looked_up(pairs, 2, parts, doc[second])
        others = np.maximum(n_words - sizes, 1)[doc]
        logs = np.log(np.where(alone > 0, alone, alpha)) - np.log(others)
        seen = joint > 0
        out = logs.copy()
        out[second] = np.where(seen, np.log(np.maximum(joint, 1)) - np.log(np.maximum(alone[second - 1], 1)), math.log(alpha) + logs[second])
        micro = np.zeros(len(sizes), np.int64)
        np.add.at(micro, doc, np.rint(out * 1e6).astype(np.int64))
        n_seen, sums = np.bincount(doc[second], seen, len(sizes)), micro / 1e6
        none = sizes == 0
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "n_seen": pa.array(n_seen.astype(np.int64)),
            "log_score": pa.array(sums, mask=none), "mean_log_score": pa.array(sums / np.maximum(sizes, 1.0), mask=none),
        })

    parts = dealt.groupBy("g").applyInArrow(extract, "g long, part long, hashes binary, counts binary")
    counted = parts.groupBy("part").applyInArrow(_count, "g long, part long, totals binary").repartition(blocks, "g")
    return dealt.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(finish, f"doc_id {key}, n_words long, n_seen long, log_score double, mean_log_score double")


def oracle() -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d),
    p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS h FROM w),
    mine1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w), all1 AS (SELECT w, sum(c) AS c FROM mine1 GROUP BY w),
    mine2 AS (SELECT r, h, w, count(*) AS c FROM p WHERE h IS NOT NULL GROUP BY r, h, w), all2 AS (SELECT h, w, sum(c) AS c FROM mine2 GROUP BY h, w),
    alone AS (SELECT m.r, m.w, (a.c - m.c)::BIGINT AS c FROM mine1 m JOIN all1 a ON a.w = m.w),
    joint AS (SELECT m.r, m.h, m.w, (a.c - m.c)::BIGINT AS c FROM mine2 m JOIN all2 a ON a.h = m.h AND a.w = m.w),
    n AS (SELECT r, greatest((SELECT count(*) FROM w) - len(ws), 1) AS others FROM d),
    x AS (SELECT p.r, p.h, j.c AS joint, h.c AS before, ln(CASE WHEN w.c > 0 THEN w.c::DOUBLE ELSE {ALPHA}::DOUBLE END) - ln(n.others::DOUBLE) AS own
          FROM p JOIN n ON n.r = p.r JOIN alone w ON w.r = p.r AND w.w = p.w LEFT JOIN alone h ON h.r = p.r AND h.w = p.h LEFT JOIN joint j ON j.r = p.r AND j.h = p.h AND j.w = p.w),
    s AS (SELECT r, count(*) FILTER (joint > 0) AS n_seen,
                 sum(round(1e6::DOUBLE * CASE WHEN joint > 0 THEN ln(joint::DOUBLE) - ln(greatest(before, 1)::DOUBLE) WHEN h IS NULL THEN own ELSE ln({ALPHA}::DOUBLE) + own END)::BIGINT)::BIGINT AS micro FROM x GROUP BY r)
    SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(s.n_seen, 0)::BIGINT AS n_seen, s.micro / 1e6::DOUBLE AS log_score, s.micro / 1e6::DOUBLE / len(d.ws) AS mean_log_score
    FROM d LEFT JOIN s ON s.r = d.r
    """
