"""Sharding by a K-d tree over document metadata.

The tree starts with one node that holds every document and owes n leaves. A node that owes k leaves is cut along its
widest metadata dimension at the weighted quantile floor(k/2)/k, until every node owes one leaf, so that leaves get
near equal bytes. Weighted quantiles are found by histograms: each pass counts the bytes of every open node in 1,024
bins of its dimension and narrows the interval that holds the cut. Histograms stay on the executors, where a window
over a node's bins picks the one that holds the cut; a few numbers for each open node reach the driver.

What is cut are units: all documents of equal text, or, where those weigh more than an eighth of a leaf, slices of
them by id, so that no group of copies can unbalance a leaf. Equal texts below that bound share a shard; those of
many rows (a third of all may be null, at 8 bytes each) meet their shard by broadcast, not in one task.

Defined cases: a null text has 8 bytes of size and the checksum of no bytes; null metadata sorts first; rows with
equal ids and texts get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unevenly, stage

ROW_BYTES = 8
PASS_BINS = 1024
#: A cut is good enough when it is this part of a leaf from the wanted weight.
TOLERANCE = 0.0005
GROUP_SHARE = 0.125
#: What heavier groups are sliced into, as a part of a leaf.
SLICE_SHARE = 0.005
SLOT_ROWS = 20_000
DIMS = ("size", "source", "lang", "text")
VALUE_BITS, TIE_BITS = 22, 40


def _kd_units(rows: DataFrame, leaf_bytes: float, dims: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """rows with their unit (group, slice), and the units with weight and raw dimensions."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("weight"))
    # At most leaves / GROUP_SHARE groups can be this heavy, so the side is small by construction.
    heavy = groups.where(F.col("weight") > leaf_bytes * GROUP_SHARE).select("g", F.ceil(F.col("weight") / (leaf_bytes * SLICE_SHARE)).cast("int").alias("n"))
    rows = rows.join(F.broadcast(heavy), "g", "left").withColumn("slice", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("n"))).cast("int")).drop("n")
    units = rows.groupBy("g", "slice").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("c"), *[F.min(c).alias(f"v_{name}") for name, c in dims.items()])
    return rows, units


def _keys(units: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Each dimension as one long: its value scaled to 22 bits, then 40 bits of the unit's hash to break ties."""
    ranges = units.agg(*[f(f"v_{d}").alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).first()
    tie = F.xxhash64("g", "slice").bitwiseAND((1 << TIE_BITS) - 1)
    out = units
    for i, d in enumerate(dims):
        lo, hi = ranges[f"min_{d}"] or 0, ranges[f"max_{d}"] or 0
        scaled = F.floor((F.coalesce(F.col(f"v_{d}"), F.lit(lo)) - F.lit(lo)) * F.lit(float((1 << VALUE_BITS) - 1) / max(1, hi - lo))).cast("long")
        out = out.withColumn(f"k{i}", F.shiftleft(scaled, TIE_BITS) + tie)
    return out.select("g", "slice", "weight", "c", *[f"k{i}" for i in range(len(dims))], F.lit(0).alias("node"))


def _cuts(units: DataFrame, plan: DataFrame, dims: int) -> DataFrame:
    """For each open node of plan (node, dim, lo, hi, step, below, want): the first of its bins whose end reaches the wanted weight, at (the weight before it) and w (its own).

    A node has PASS_BINS bins at most, counted by an aggregate; a window over a node's bins finds the one, so a row for
    each node is all that leaves.
    """
    key = F.element_at(F.array(*[f"k{i}" for i in range(dims)]), F.col("dim") + 1)
    inside = units.join(F.broadcast(plan), "node").withColumn("key", key).where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
    bins = inside.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("weight").alias("w"), F.first("below").alias("below"), F.first("want").alias("want"))
    so_far = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("at", F.col("below") + F.coalesce(F.sum("w").over(so_far), F.lit(0)))
    reached = F.when(F.col("at") + F.col("w") >= F.col("want"), F.struct("bin", "at", F.col("w").cast("double").alias("w")))
    last = F.max(F.struct("bin", (F.col("at") + F.col("w")).alias("at"), F.lit(0.0).alias("w")))  # rounding may leave the last bin a hair short
    return placed.groupBy("node").agg(F.coalesce(F.min(reached), last).alias("x")).select("node", "x.*")


def kd_assign(units: DataFrame, leaves: int, dims: int) -> DataFrame:
    """units (weight, k0.., node, and what else tells them) with their final node, 0 to leaves - 1, as column shard.

    All open nodes of a level are cut in the same passes. The driver holds a few numbers for each node, and broadcasts
    the plan of a level: a row for each open node, of which there are fewer than leaves.
    """
    spark, told = units.sparkSession, [c for c in units.columns if c not in ("weight", "node", *(f"k{i}" for i in range(dims)))]
    total = units.agg(F.sum("weight")).first()[0] or 0
    owed, base, fresh = {0: leaves}, {0: 0}, 1
    enough = TOLERANCE * total / max(1, leaves)
    while open_nodes := [n for n, k in owed.items() if k > 1]:
        wanted = spark.createDataFrame([(n,) for n in open_nodes], "node int")
        spans = units.join(F.broadcast(wanted), "node").groupBy("node").agg(F.sum("weight").alias("w"), *[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]).collect()
        cuts = {}
        for r in spans:
            dim = max(range(dims), key=lambda i: (r[f"max{i}"] - r[f"min{i}"], -i))
            left = owed[r["node"]] // 2
            cuts[r["node"]] = {"dim": dim, "lo": r[f"min{dim}"], "hi": r[f"max{dim}"] + 1, "want": r["w"] * left / owed[r["node"]], "below": 0.0, "open": True}
        while still := {n: c for n, c in cuts.items() if c["open"]}:
            for c in still.values():
                c["step"] = max(1, -(-(c["hi"] - c["lo"]) // PASS_BINS))
            plan = spark.createDataFrame([(n, c["dim"], c["lo"], c["hi"], c["step"], c["below"], c["want"]) for n, c in still.items()], "node int, dim int, lo long, hi long, step long, below double, want double")
            for r in _cuts(units, plan, dims).collect():
                c, at, w = still[r["node"]], r["at"], r["w"]
                lo = c["lo"] + r["bin"] * c["step"]
                over, under = at + w - c["want"], c["want"] - at
                if c["step"] == 1 or min(over, under) <= enough:
                    c |= {"cut": lo + c["step"] if over < under else lo, "open": False}
                else:
                    c |= {"lo": lo, "hi": min(c["hi"], lo + c["step"]), "below": at}
        moves, owed_next, base_next = [], {}, {}
        for n, k in owed.items():
            if k == 1 or n not in cuts:  # a leaf, or a node without rows
                owed_next[n], base_next[n] = 1, base[n]
                continue
            left = k // 2
            owed_next |= {fresh: left, fresh + 1: k - left}
            base_next |= {fresh: base[n], fresh + 1: base[n] + left}
            moves.append((n, cuts[n]["dim"], cuts[n]["cut"], fresh))
            fresh += 2
        owed, base = owed_next, base_next
        if not moves:
            break
        step = spark.createDataFrame(moves, "node int, dim int, cut long, child int")
        key = F.element_at(F.array(*[f"k{i}" for i in range(dims)]), F.col("dim") + 1)
        moved = F.when(F.col("child").isNull(), F.col("node")).when(key < F.col("cut"), F.col("child")).otherwise(F.col("child") + 1)
        units = stage(units.join(F.broadcast(step), "node", "left").select(*told, "weight", *[f"k{i}" for i in range(dims)], moved.alias("node")), "kd")
    final = spark.createDataFrame([(n, b) for n, b in base.items()], "node int, shard int")
    return units.join(F.broadcast(final), "node").select(*told, "shard")


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every document in one of n_shards leaves (or as many as target_bytes needs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("h"),
        F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")).alias("d_source"), F.crc32(F.coalesce(F.col("lang"), F.lit("")).cast("binary")).alias("d_lang"),
    )
    rows = stage(raw.withColumn("g", F.xxhash64("h", "text_crc32", "size")).drop("h"), "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = n_shards or max(1, -(-total // (target_bytes or 1 << 30)))
    dims = {"size": F.col("size"), "source": F.col("d_source"), "lang": F.col("d_lang"), "text": F.col("text_crc32")}
    rows, units = _kd_units(rows, max(1.0, total / leaves), dims)
    placed = kd_assign(stage(_keys(stage(units, "units"), tuple(dims)), "keys"), leaves, len(dims))
    rows = stage(join_unevenly(rows, placed, ["g", "slice"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-n // (leaves * SLOT_ROWS))))).alias("part")), "placed")
    # Slots: rows of a shard are numbered in parts, each from where the parts before it end.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c")).select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("i", F.row_number().over(inside)).join(starts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("i") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The shards under the law `bytes`: sizes near equal."""
    return shard(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
