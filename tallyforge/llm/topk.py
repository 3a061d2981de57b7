"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers, dealt by length into bands and by hash into blocks of BLOCK_ROWS or so, each block
one packed row, sorted by length. Queries are packed too. A first pass over the PROBES longest vectors gives every
query a score that its k-th best can't be under. With it, a band whose greatest length can't reach any query of a
query block is never joined to it. In a block, each query has a local cosine threshold, its lower bound over its
length times the block's greatest: above 1 it skips the block; from COORDINATE on it keeps the vectors whose unit
coordinates at its FOCUS largest ones lie where that cosine allows; below, those long enough. What is left is verified
by exact integer products.

Quantised components are 32-bit integers where they fit, else whole doubles, and products are computed in doubles, in
64 bits or in Python's integers, whichever holds them. A score beyond 64 bits counts as the nearest number of 64 bits.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a component that scaling
takes beyond the doubles counts as the largest of them; only vectors of one dimension are compared; rows of the query's own id are no candidates; ties go to the smaller id;
repeated rows count once; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stage

K, SCALE = 5, 256
BLOCK_ROWS, QUERY_ROWS, BANDS, PROBES = 4096, 512, 32, 1024
COORDINATE, FOCUS = 0.6, 3
SLACK = 1e-9
LARGEST = np.finfo(np.float64).max
LEAST, MOST = -(2**63), 2**63 - 1
PACKED = "dim int, ids binary, matrix binary"


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, dim, norm, v (32-bit integers or whole doubles, packed) of the vectors that take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, packed = [], [], [], []
            for key, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.nan_to_num(np.floor(x * scale))
                ids.append(key)
                dims.append(len(x))
                norms.append(float(lengths(x[None, :])[0]))
                packed.append((x if (np.abs(x) >= 2**31).any() else x.astype(np.int32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["id", "dim", "norm", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(bounded(work), "id long, dim int, norm double, v binary")


def lengths(x: np.ndarray) -> np.ndarray:
    """The length of each row, or the largest double where it is beyond."""
    most = np.abs(x).max(axis=1, initial=0.0)
    if not len(x) or most.max() < 2.0**500:
        return np.sqrt((x * x).sum(axis=1))
    part = x / np.maximum(most, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most.clip(1.0) * np.sqrt((part * part).sum(axis=1)), LARGEST)


def _pack(table: pa.Table) -> tuple[int, bytes, bytes]:
    """Dimension, ids and matrix of a group, longest first."""
    order = np.lexsort((table.column("id").to_numpy(), -table.column("norm").to_numpy()))
    rows, dim = table.column("v").to_pylist(), table.column("dim")[0].as_py()
    return dim, table.column("id").to_numpy()[order].tobytes(), _joined([rows[i] for i in order], dim)


def _joined(rows: list[bytes], dim: int) -> bytes:
    """One matrix of packed vectors: doubles if any of them holds doubles."""
    if all(len(r) == 4 * dim for r in rows):
        return b"".join(rows)
    return b"".join(r if len(r) == 8 * dim else np.frombuffer(r, np.int32).astype(np.float64).tobytes() for r in rows)


def _matrix(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(matrix, np.int32 if len(matrix) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim).astype(np.float64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while every sum stays under 2**53, in integers of 64 bits while it stays under 2**63, else in Python's; beyond 64 bits the nearest number."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]  # infinite at worst
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(), np.abs(c).max()) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(whole(q), whole(c).T), LEAST, MOST).astype(np.int64)


def _floor(score) -> float:
    """A double that a whole number is not less than."""
    x = float(score)
    return x if abs(x) < 2**53 else float(np.nextafter(x, -np.inf))


def _best(ids: np.ndarray, scores: np.ndarray, own: int, least: float, k: int) -> Iterator[tuple[int, int]]:
    """The k best of scores that reach least, ties to the smaller id, without the query's own."""
    at = np.flatnonzero((scores >= least) & (ids != own))
    if len(at) > 8 * k:  # those at or above the k-th score
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    for i in at[np.lexsort((ids[at], ~scores[at]))][:k]:
        yield int(ids[i]), int(scores[i])


def search_block(qid: np.ndarray, q: np.ndarray, least: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of each query's best in one block, whose rows are sorted by length, longest first."""
    qn, cn = lengths(q), lengths(c)
    unit = c / np.maximum(cn, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        local = np.where(least > 0, least / (qn * cn[0]), -1.0) * (1 - SLACK)
    local = np.where(np.isnan(local), 2.0, local)
    by_length = np.flatnonzero(local < COORDINATE)
    if len(by_length):
        reach = np.where(least[by_length] > 0, least[by_length] / np.maximum(qn[by_length], 1e-300) * (1 - SLACK), -1.0)
        ends = np.searchsorted(-cn, -reach, "right")
        scores = _products(q[by_length], c[: ends.max()])
        for row, i, end in zip(scores, by_length, ends, strict=True):
            for found, s in _best(cid[:end], row[:end], qid[i], least[i], k):
                yield int(qid[i]), found, s
    for i in np.flatnonzero((local >= COORDINATE) & (local <= 1)):
        u, t = q[i] / qn[i], local[i]
        keep = np.ones(len(c), bool)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + SLACK
            # The cap of cosine t around u; where it holds the axis itself, or its opposite, that end is open.
            low, high = (-1.0 if -u[f] >= t else u[f] * t - spread), (1.0 if u[f] >= t else u[f] * t + spread)
            keep &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
        at = np.flatnonzero(keep)
        for found, s in _best(cid[at], _products(q[i : i + 1], c[at])[0], qid[i], least[i], k):
            yield int(qid[i]), found, s


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer products of each query with all other vectors. is_query: a condition on column id."""
    rows = stage(_quantised(vectors, id_col, vec_col, scale), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    bands = max(1, min(BANDS, n // BLOCK_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)] or [0.5], 1000)).first()[0] or []))[: bands - 1] if n else []
    top = rows.agg(F.max("norm")).first()[0] or 0.0
    upper = [*cuts, top]  # the greatest length of each band
    chunks = max(1, -(-n // (len(upper) * BLOCK_ROWS)))
    band = sum((F.col("norm") > c).cast("int") for c in cuts) if cuts else F.lit(0)

    def block(table: pa.Table) -> pa.Table:
        dim, ids, matrix = _pack(table)
        return pa.table({"cid": pa.array([table.column("cid")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [ids], "matrix": [matrix]})

    def query_block(table: pa.Table) -> pa.Table:
        dim, ids, matrix = _pack(table)
        return pa.table({"dim": pa.array([dim], pa.int32()), "qids": [ids], "queries": [matrix]})

    blocks = rows.withColumn("cid", (band * chunks + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks))).cast("int")).groupBy("dim", "cid").applyInArrow(block, "cid int, dim int, ids binary, matrix binary")
    packed = rows.where(is_query).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, -(-n_queries // QUERY_ROWS))))).groupBy("dim", "qb").applyInArrow(query_block, "dim int, qids binary, queries binary")
    # Staged, so that the driver gets PROBES rows: if it took them from the ordered rows, every task would send it as many.
    longest = stage(rows.orderBy(F.desc("norm"), "id").limit(PROBES), "probes")
    probes = [(r["dim"], r["id"], bytes(r["v"])) for r in longest.collect()]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, ids, matrix in zip(*(batch.column(c).to_pylist() for c in ("dim", "qids", "queries")), strict=True):
                qid, q = _matrix(ids, matrix, dim)
                mine = list({p[1]: p for p in probes if p[0] == dim}.values())
                pid, p = _matrix(np.array([x[1] for x in mine], np.int64).tobytes(), _joined([x[2] for x in mine], dim), dim) if mine else (np.zeros(0, np.int64), np.zeros((0, dim)))
                scores = _products(q, p)
                scores = np.where(pid[None, :] == qid[:, None], LEAST, scores)
                least = np.array([_floor(x) for x in np.sort(scores, axis=1)[:, -k].tolist()]) if len(pid) > k else np.full(len(qid), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(least > 0, lengths(q) / least, np.inf)
                out.append((least.tobytes(), float(ratio.max())))
            least, ratio = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "qids", "queries")), pa.array(least, pa.binary()), pa.array(ratio, pa.float64())], ["dim", "qids", "queries", "least", "ratio"])

    limited = stage(packed.mapInArrow(bounded(bound), "dim int, qids binary, queries binary, least binary, ratio double"), "queries")
    pairs = limited.withColumn("cid", F.explode(F.sequence(F.lit(0), F.lit(len(upper) * chunks - 1))))
    reach = F.element_at(F.array(*[F.lit(float(u)) for u in upper]), F.floor(F.col("cid") / chunks).cast("int") + 1)
    # Query blocks are small as files, but not once for every block: Spark must not take them for a table to broadcast.
    pairs = pairs.where(F.col("ratio") * reach * (1 + SLACK) >= 1).join(stage(blocks, "blocks").hint("merge"), ["cid", "dim"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, qids, queries, least, ids, matrix in zip(*(batch.column(c).to_pylist() for c in ("dim", "qids", "queries", "least", "ids", "matrix")), strict=True):
                found = list(search_block(*_matrix(qids, queries, dim), np.frombuffer(least, np.float64), *_matrix(ids, matrix, dim), k))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = pairs.select("dim", "qids", "queries", "least", "ids", "matrix").mapInArrow(bounded(verify), "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return f"""
    WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND vec_id IS NOT NULL),
    p AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id, coalesce(list_sum([a.q[i] * b.q[i] FOR i IN generate_series(1, len(a.q))]), 0)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
    """
