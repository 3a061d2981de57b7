"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

Two texts link when their sets of k-word shingles have a Jaccard similarity of NUM / DEN or more. Texts of equal sets
are one node. Shingles are ordered rare first, by a sketch of document frequencies over the whole corpus (counters
shared by hash, their number grows with the corpus up to a fixed bound; any total order keeps the join exact, a rarer
one keeps it small, and what is common enough to stand out of a counter's noise comes last whatever the corpus). Of n
shingles the first n - ceil(t n) + 1 are a node's prefix, and two nodes that link share a prefix shingle. Pairs pass a
length filter, a positional filter (what can precede a shared shingle in both orders, and what can follow it) and a
suffix filter (each element that only one set has flips one bit of a parity sketch, so sketches that differ in d bits
belong to sets that differ in d elements or more; it has a bit for every two elements, or more).

A shingle that m nodes share is never spelled out into m (m - 1) / 2 pairs, and pairs inside one component are not
looked at, since they change none. Three rounds find the components:

1. Hubs. Nodes that share a prefix shingle and the least hash of their sets are verified against one of them, which
   joins a group of near copies with about one pair for each member.
2. Forests. Nodes that share a prefix shingle share its hub, so what is left between components is found by going
   through each hub's nodes in blocks of bounded size. A pair of blocks gives the best candidates that connect its
   components, a forest, so never more pairs than nodes; they are verified, and components grow.
3. Proof. Where all of a forest's pairs are links, its blocks are settled. In the others, nodes that still have a
   candidate in another component meet again with their whole sets, and every candidate between different components
   is verified there. Only links that join two components leave the task, fewer than it has nodes. Nothing is left
   after that, so components are exact.

A node, shingle, hub or component may hold a third of all rows. Counting and first-of-group aggregates combine before
they shuffle; joins of rows with what is small for each key send keys of more than 1 / MOST_HOT of the rows, so
MOST_HOT keys at most, by broadcast. Joins of pairs with sketches and whole sets, and of edges with their least
neighbours, are plain: there a hub's rows are split by Spark's adaptive skew handling.

Defined cases: a text with fewer than k words has its whole sequence as one shingle; null text, or none but white
space, gives the empty set, which links with nothing; rows of equal id count each by its own text; a null id takes
part, and its component is the smallest id that it reaches, or null; an empty table gives no rows; other columns are
ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, discard, join_unevenly, stage
from .textvec import mix, shingles, word_hashes

K, NUM, DEN = 3, 90, 100
#: One frequency counter for each so many bytes of text, and the fewest and most of them.
TEXT_BYTES_EACH, COUNTERS, MOST_COUNTERS = 512, 1 << 20, 1 << 22
#: Bits of the least parity sketch, how many elements each bit may stand for, and the bytes of sketches compared at once.
SKETCH, PER_BIT, SKETCH_BYTES = 1024, 2, 16 << 20
#: Bits for each wanted id, and the most bits, of the bitmap that picks texts out of a scan; more ids are joined.
BITS_EACH, MOST_BITS = 16, 1 << 27
FAN_IN = 8
BATCH = 1000
#: The most nodes, and shingles, of a hub's block; and how many nodes are compared with a block at once.
HUB_BLOCK, HUB_SHINGLES, STRIPE = 2048, 4 << 20, 128


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each row."""
    for start in range(0, len(column), BATCH):
        words, at = word_hashes(column[start : start + BATCH])
        for i in range(len(at) - 1):
            yield shingles(words[at[i] : at[i + 1]], k)


def _digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _narrow(v: np.ndarray) -> bytes:
    """Counts in as few bytes each as they take, 4 at most, where they stop growing; the first byte tells how many."""
    most = int(v.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    v = np.minimum(v, np.uint64(2**32 - 1)) if v.itemsize == 8 else v
    return bytes([size]) + v.astype(f"uint{8 * size}").tobytes()


def _wide(data: memoryview | bytes) -> np.ndarray:
    return np.frombuffer(data, f"uint{8 * bytes(data[:1])[0]}", offset=1)


def combine(rows: DataFrame, op: str) -> np.ndarray | None:
    """One vector from a binary column v of equally long narrowed vectors, by sums or unions of FAN_IN at a time; one vector reaches the driver."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("v"):
                v = _wide(memoryview(x.as_buffer()))
                if total is None:
                    total = v.astype(np.uint64 if op == "sum" else np.uint8)
                elif op == "sum":
                    total += v
                else:
                    total |= v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_narrow(total)], pa.binary())], ["v"])

    rows = stage(rows, "vectors")
    while (n := rows.count()) > 1:
        rows = stage(rows.repartition(-(-n // FAN_IN)).mapInArrow(bounded(fold), "v binary"), "vectors")
    found = rows.first()
    return None if found is None else _wide(bytes(found[0]))


def frequencies(docs: DataFrame, k: int = K) -> np.ndarray:
    """Document counts (up to 2**32 - 1, since they only order), each shared by the shingles that hash to it: COUNTERS of them, more for large tables, MOST_COUNTERS at most."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = min(MOST_COUNTERS, max(COUNTERS, 1 << (n_bytes // TEXT_BYTES_EACH).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            held = []
            for i, s in enumerate(_sets(batch.column("text"), k)):
                held.append(s)
                if i % 256 == 255 or i == batch.num_rows - 1:
                    counts += np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array([_narrow(counts)], pa.binary())], ["v"])

    found = combine(docs.select("text").mapInArrow(bounded(work), "v binary"), "sum")
    return np.zeros(size, np.uint8) if found is None else found


def _prefixes(docs: DataFrame, held: Broadcast, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, node, n, least (hash of the set), prefix (rare first), sketch of each row. held: the frequencies."""
    key = docs.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        last = np.uint64(len(counts) - 1)
        for batch in batches:
            nodes, sizes, least, prefixes, sketches = [], [], [], [], []
            for s in _sets(batch.column("text"), k):
                n = len(s)
                keep = n - (num * n + den - 1) // den + 1 if n else 0
                order = np.lexsort((s, counts[(s & last).astype(np.int64)]))[:keep]
                nodes.append(_digest(s))
                sizes.append(n)
                least.append(int(s[:1].view(np.int64)[0]) if n else None)  # sets are sorted
                prefixes.append(s[order].view(np.int64))
                sketches.append(_sketch(s))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64()))
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.int64()), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "node", "n", "least", "prefix", "sketch"])

    shape = f"doc_id {key.dataType.simpleString()}, text_hash long, node long, n long, least long, prefix array<long>, sketch binary"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(bounded(work), shape)


def _need(a: str, b: str, num: int, den: int) -> F.Column:
    """The least overlap of a link between sets of these sizes."""
    return F.ceil(F.lit(num) * (F.col(a) + F.col(b)) / F.lit(num + den))


def _passing(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, na, nb of pairs (a, na, ia, b, nb, ib: rows for shared prefix shingles, not all of them) that pass the positional filter.

    Both orders are one order, so before a shared shingle the sets share as many as the lesser place has, at most.
    """
    most = F.least("ia", "ib") + 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    one = pairs.groupBy("a", "b").agg(F.min(most).alias("most"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return one.where(F.col("most") >= _need("na", "nb", num, den)).select("a", "b", "na", "nb")


def _lengths_fit(num: int, den: int) -> F.Column:
    return F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")


def _sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of elements falls on each bit. Sizes differ by factors of 8, so a large one folds into a small one."""
    bits = SKETCH
    while len(found) > PER_BIT * bits:
        bits *= 8
    return np.packbits(np.bincount((found >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """Sketches of several sizes: two are compared at the size of the lesser."""

    def __init__(self, sketches: list[bytes]):
        self.size = np.array([len(x) for x in sketches], np.int64)
        self.at, self.rows, above, who = {}, {}, np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
        for size in sorted(set(self.size.tolist()), reverse=True):
            while len(who) and above.shape[1] > size:  # 8 bits of the larger are one of the lesser
                above = np.packbits(np.bitwise_count(above) & 1, axis=1)
            own = np.flatnonzero(self.size == size)
            mine = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(-1, size)
            above, who = (np.concatenate([above, mine]), np.concatenate([who, own])) if len(who) else (mine, own)
            self.rows[size] = np.ascontiguousarray(above).view(np.uint64)
            self.at[size] = np.full(len(sketches), -1, np.int64)
            self.at[size][who] = np.arange(len(who))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits sketches a[i] and b[i] differ."""
        out, level = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for size, rows in self.rows.items():
            here = np.flatnonzero(level == size)
            for start in range(0, len(here), step := max(1, SKETCH_BYTES // size)):
                i = here[start : start + step]
                out[i] = np.bitwise_count(rows[self.at[size][a[i]]] ^ rows[self.at[size][b[i]]]).sum(axis=1, dtype=np.int64)
        return out


def _may_differ(both: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many elements two linked sets of this joint size may differ in."""
    return both - 2 * -(-num * both // (num + den))


def _suffix_filter(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            both = Sketches(batch.column("sa").to_pylist() + batch.column("sb").to_pylist())
            keep = both.differ(np.arange(n), np.arange(n, 2 * n)) <= _may_differ(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), num, den)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    joined = pairs.join(info.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(info.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bounded(work), "a long, b long")


class Labels:
    """Labels of a block's nodes, which links between them unite."""

    def __init__(self, label: np.ndarray):
        _, self.of = np.unique(label, return_inverse=True)
        self.parent = np.arange(self.of.max(initial=-1) + 1)

    def root(self, i: int) -> int:
        x = self.of[i]
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def unite(self, i: int, j: int) -> bool:
        """Whether nodes i and j had different labels, which are one from now on."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def now(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent[self.of]


def _stripes(table: pa.Table, sketches: Sketches, labels: Labels, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a pair of blocks that pass the length and suffix filters under different labels: pairs and in how many bits they differ, STRIPE rows at a time."""
    n, block = (table.column(c).to_numpy() for c in ("n", "block"))
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    for start in range(0, len(left), STRIPE):
        i, label = left[start : start + STRIPE, None], labels.now()
        ok = (label[i] != label[right]) & (den * np.minimum(n[i], n[right]) >= num * np.maximum(n[i], n[right]))
        if x == y:
            ok &= i < right
        a, b = np.nonzero(ok)
        a, b = i[a, 0], right[b]
        apart = sketches.differ(a, b)
        near = apart <= _may_differ(n[a] + n[b], num, den)
        yield a[near], b[near], apart[near]


def _edges(table: pa.Table, found: list[tuple[int, int]]) -> pa.Table:
    node = table.column("node").to_numpy()
    pairs = np.sort(node[np.array(found, np.int64).reshape(-1, 2)], axis=1)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _forest(table: pa.Table, num: int, den: int) -> pa.Table:
    """hub, x, y, a, b: the candidates that connect the labels of a pair of blocks, the likeliest first; fewer than it has nodes."""
    sketches, labels, found = Sketches(table.column("sketch").to_pylist()), Labels(table.column("label").to_numpy()), []
    for a, b, apart in _stripes(table, sketches, labels, num, den):
        while len(a):  # each left row takes its best partner, labels unite, until no pair of different labels is left
            order = np.lexsort((b, apart, a))
            first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
            found += [(i, j) for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True) if labels.unite(i, j)]
            label = labels.now()
            still = label[a] != label[b]
            a, b, apart = a[still], b[still], apart[still]
    where = table.select(["hub", "x", "y"]).take(pa.array(np.zeros(len(found), np.int64)))
    edges = _edges(table, found)
    return where.append_column("a", edges.column("a")).append_column("b", edges.column("b"))


def _unsettled(table: pa.Table, num: int, den: int) -> pa.Table:
    """The rows of a pair of blocks that have a candidate under another label."""
    sketches, labels = Sketches(table.column("sketch").to_pylist()), Labels(table.column("label").to_numpy())
    keep = np.zeros(table.num_rows, bool)
    for a, b, _ in _stripes(table, sketches, labels, num, den):
        keep[a] = keep[b] = True
    return table.filter(pa.array(keep))


def _proven(table: pa.Table, num: int, den: int) -> pa.Table:
    """a, b: links that join labels of a pair of blocks, found on whole sets, until no other link joins two."""
    sketches, labels, found = Sketches(table.column("sketch").to_pylist()), Labels(table.column("label").to_numpy()), []
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
    for a, b, apart in _stripes(table, sketches, labels, num, den):
        order = np.lexsort((b, a, apart))
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if labels.root(i) != labels.root(j) and _link(sets[i], sets[j], num, den):
                labels.unite(i, j)
                found.append((i, j))
    return _edges(table, found)


def _link(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


IN_BLOCKS = "hub long, x int, y int, node long, n long, label long, block int, sketch binary"


def _in_blocks(live: DataFrame, num: int, den: int) -> DataFrame:
    """hub, x, y, node, n, block from live (token, node, n, label): the nodes of hubs that join different labels, once for each pair of blocks.

    A block has HUB_BLOCK nodes and HUB_SHINGLES shingles or so, whatever the hub, and a node is copied once for each
    block of its hub. Nodes that are alone in their hub with sizes like theirs are left out.
    """
    hub = F.min_by("node", F.xxhash64("node", F.lit(1)))
    most = live.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub.alias("hub"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    most = stage(most.select("token", "hub", "c"), "hubs")
    rows = join_unevenly(live.select("token", "node", "n"), most, ["token"]).select("hub", "node", "n").distinct()
    band = F.floor(F.log("n") / math.log(den / num)).cast("int")  # sizes that fit are at most one band apart
    rows = stage(rows.withColumn("band", band), "shared")
    bands = rows.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    near = bands.select("hub", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "c").groupBy("hub", "band").agg(F.sum("c").alias("c")).where("c > 1")
    kept = bands.select("hub", "band", F.col("c").alias("own"), "s").join(near.select("hub", "band"), ["hub", "band"])
    blocks = F.greatest(F.ceil(F.sum("own") / HUB_BLOCK), F.ceil(F.sum("s") / HUB_SHINGLES)).cast("int")
    sizes = kept.groupBy("hub").agg(F.collect_set("band").alias("bands"), blocks.alias("blocks"), F.sum("own").alias("c"))  # a band for each factor of den / num
    dealt = join_unevenly(rows, stage(sizes, "sizes"), ["hub"]).where(F.array_contains("bands", F.col("band")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("hub", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "n", "block")


def _hash_ids(column: pa.Array, bits: int) -> np.ndarray:
    if pa.types.is_integer(column.type):
        raw = column.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)
    else:
        raw = np.array([xxhash.xxh3_64_intdigest(str(x)) for x in column.to_pylist()], np.uint64)
    return (mix(raw) & np.uint64(bits - 1)).astype(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, shingles of the nodes in wanted (node, doc_id): a scan picks their texts by a bitmap, so that no other text leaves its task, or by a join where the bitmap would pass MOST_BITS."""
    key = docs.schema["doc_id"].dataType.simpleString()
    n = wanted.count()
    bits = 1 << max(10, (BITS_EACH * max(1, n) - 1).bit_length())
    texts = docs.select(F.col("doc_id").cast(key).alias("doc_id"), "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = list(_sets(batch.column("text")[start : start + 256], k))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    if bits > MOST_BITS:
        ids = wanted.select(F.col("doc_id").alias("id")).distinct()
        picked = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(bounded(whole), "node long, shingles binary")
        return picked.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[_hash_ids(batch.column("doc_id"), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([_narrow(np.packbits(seen))], pa.binary())], ["v"])

    ids = wanted.select("doc_id").repartition(max(1, min(64, n // 100_000)))
    held = docs.sparkSession.sparkContext.broadcast(combine(ids.mapInArrow(bounded(mark), "v binary"), "or"))  # MOST_BITS at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if held.value is None else np.unpackbits(held.value).astype(bool)
        for batch in batches:
            keep = np.flatnonzero(seen[_hash_ids(batch.column("doc_id"), bits)]) if seen is not None else np.zeros(0, np.int64)
            for start in range(0, len(keep), 256):
                yield from whole(iter([batch.take(pa.array(keep[start : start + 256]))]))

    found = texts.mapInArrow(bounded(work), "node long, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                keep.append(_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    return joined.select("a", "b", "xa", "xb").mapInArrow(bounded(work), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node on an edge (a, b): alternating large and small stars until nothing changes. The label is the component's least node."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: all lesser neighbours of u, and u itself, point to the least of them.
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = stage(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links between nodes; nodes without a label are their own."""
    named = labels.select(F.col("node").alias("x"), "label")
    ends = links.join(named.withColumnsRenamed({"x": "a", "label": "la"}), "a", "left").join(named.withColumnsRenamed({"x": "b", "label": "lb"}), "b", "left")
    above = stage(components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "above")
    size = above.groupBy(F.col("node").alias("label")).agg(F.first("label").alias("to"))
    lifted = labels.join(size, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stage(lifted.unionByName(above.join(labels, "node", "left_anti")), "labels")


def _hub_pairs(live: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: each node with the hub of those that share a prefix shingle and the least hash of their sets, if the pair passes the filters."""
    hubs = live.groupBy("token", "least").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("node", "n", "i"), F.xxhash64("node", F.lit(0))).alias("hub")).where("c > 1")
    each = join_unevenly(live, stage(hubs, "hubs"), ["token", "least"]).where("node <> hub.node")
    each = each.select(F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), F.col("hub.i").alias("ia"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    swap = F.col("a") > F.col("b")
    each = each.where(_lengths_fit(num, den)).select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("ia", "ib"), ("b", "a"), ("nb", "na"), ("ib", "ia"))])
    return _suffix_filter(_passing(each, num, den), nodes, num, den)


def grouped(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n (shingles) and label (the least node of its component) of each row of docs; a row without words has no label."""
    held = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))  # MOST_COUNTERS numbers of 4 bytes at most, whatever the corpus
    whole = stage(_prefixes(docs, held, k, num, den), "prefixes")
    held.destroy()
    nodes = stage(whole.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("n", "least", "prefix", "sketch")]), "nodes")
    rows = stage(whole.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "rows")
    discard(whole)
    spread = nodes.select("node", "n", "least", F.posexplode("prefix").alias("i", "token"))
    again = stage(spread.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "again")
    live = stage(join_unevenly(spread, again, ["token"]).select("token", "node", "n", "least", "i"), "live")

    def sets_of(named: DataFrame) -> DataFrame:
        return stage(_sets_of(docs, stage(named.distinct().join(nodes.select("node", "doc_id"), "node"), "wanted"), k), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        links = stage(_verified(pairs, sets, num, den), "links")
        discard(sets)
        return links

    def dealt(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows of blocks with labels and sketches."""
        return rows.join(labels, "node", "left").join(nodes.select("node", "sketch"), "node").select("hub", "x", "y", "node", "n", F.coalesce("label", "node").alias("label"), "block", "sketch").groupBy("hub", "x", "y")

    labels = stage(components(checked(stage(_hub_pairs(live, nodes, num, den), "pairs"))), "labels")
    named = live.join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
    met = stage(_in_blocks(named, num, den), "blocks")
    tried = stage(dealt(met, labels).applyInArrow(lambda t: _forest(t, num, den), "hub long, x int, y int, a long, b long"), "forest")
    if not tried.isEmpty():
        links = checked(stage(tried.select("a", "b").distinct(), "pairs"))
        labels = _merged(labels, links)
        failed = tried.join(links, ["a", "b"], "left_anti").select("hub", "x", "y").distinct()
        left = stage(dealt(met.join(failed, ["hub", "x", "y"], "left_semi"), labels).applyInArrow(lambda t: _unsettled(t, num, den), IN_BLOCKS), "unsettled")
        if not left.isEmpty():
            sets = sets_of(left.select("node"))
            proven = stage(left.join(sets, "node").groupBy("hub", "x", "y").applyInArrow(lambda t: _proven(t, num, den), "a long, b long"), "proven")
            discard(sets)
            if not proven.isEmpty():
                labels = _merged(labels, proven)
    full = nodes.select("node", "c").join(labels, "node", "left").select("node", "c", F.coalesce("label", "node").alias("label"))
    return join_unevenly(rows, stage(full, "labelled"), ["node"], "left").select("doc_id", "text_hash", "n", "label")


def link_components(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    rows = stage(grouped(docs, k, num, den), "grouped")
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    worded = F.col("label").isNotNull()
    named = join_unevenly(rows, stage(least, "least"), ["label"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def oracle() -> str:
    """All pairs that share a shingle, then everything each set reaches."""
    return f"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([array_to_string(w[i : i + {K - 1}], ' ') FOR i IN generate_series(1, greatest(1, len(w) - {K - 1}))])) END AS shingles FROM w),
    nodes AS (SELECT min(r) AS node, shingles, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
    e AS (SELECT node, n, unnest(shingles) AS shingle FROM nodes),
    pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total FROM e a JOIN e b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY a.node, b.node),
    links AS (SELECT a, b FROM pairs WHERE {DEN} * shared >= {NUM} * (total - shared)),
    reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT n.node, s.doc_id FROM s JOIN nodes n ON s.shingles = n.shingles),
    comp AS (SELECT reach.a AS node, min(least.doc_id) AS component_id FROM reach JOIN least ON reach.b = least.node GROUP BY reach.a)
    SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, CASE WHEN n.node IS NULL THEN s.doc_id ELSE c.component_id END AS component_id
    FROM s LEFT JOIN nodes n ON s.shingles = n.shingles LEFT JOIN comp c ON c.node = n.node
    """
