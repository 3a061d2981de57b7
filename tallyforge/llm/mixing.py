"""Mixing sources to target weights, with Efraimidis-Spirakis sampling inside each source.

Every document draws u in (0, 1) from its id and gets the key -ln(u) / w, w its quality weight; the smallest keys win.
A source's target is met by complete epochs first; what is left is filled in key order until the prefix sum of sizes
reaches it. The prefix sum is two-level: keys fall into bins, a window runs over each source's bins, and only rows of
the one bin in which the budget ends are sorted, so that no task ever holds a source.

Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0 and is never
taken; equal keys are ordered by id; repeated rows are drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, stage

MOST_EPOCHS = 3
BINS = 16384
SEED = "mix-1"
LETTER = r"[^A-Za-z\x{80}-\x{10FFFF}]+"


def quality_weight(text: Column) -> Column:
    """0.05 to 1: how much of the text is letters, squared so that symbol junk is rarely drawn twice."""
    share = F.length(F.regexp_replace(text, LETTER, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(0.05) + F.lit(0.95) * share * share, F.lit(0.05))


def sample_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """The exponential key; u has 52 random bits and is never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """source_key, source_size, target from source_key, is_null, source, source_size: weights 1, 2, 3 repeating, water-filled under the caps.

    One row for each source, so its windows hold as many rows as there are sources, whatever the corpus.
    """
    order = Window.orderBy("is_null", F.col("source"))
    w = sources.withColumn("w", (F.row_number().over(order) - 1) % 3 + F.lit(1.0)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(1))
    # The capped sources are those with the smallest cap / w; with the first k of them capped, the others get level * w.
    before = Window.orderBy(F.col("cap") / F.col("w"), "is_null", F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "is_null", F.col("source"), F.col("level")))).over(every)["level"]
    w = w.withColumn("final", final)
    return w.select("source_key", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, bins: int = BINS, also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes. also: named columns of docs that come along."""
    also = [c.alias(f"_also{i}") for i, c in enumerate(also)]
    more = [f"_also{i}" for i in range(len(also))]
    base = docs.select("doc_id", *also, "source", n_words(F.col("text")).alias("size"), sample_key(F.col("doc_id"), quality_weight(F.col("text")) if weight is None else weight).alias("k"))
    base = base.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    meta = stage(base.select("doc_id", *more, "source_key", "size", "k", F.floor(F.col("k") / (F.col("k") + 1) * bins).cast("int").alias("bin")), "mix")
    by_bin = meta.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    sums = stage(by_bin, "bins")
    totals = sums.groupBy("source_key").agg(F.sum("bin_size").alias("source_size")).withColumn("is_null", F.col("source_key") == "n").withColumn("source", F.expr("substring(source_key, 2)"))
    goal = targets(totals)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    so_far = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(so_far), F.lit(0))).join(goal, "source_key")
    ends = reached.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest"))).groupBy("source_key").agg(F.min_by(F.struct("bin", "before"), "bin").alias("end"))
    goal = stage(goal.join(ends, "source_key", "left"), "goal")
    rows = meta.join(goal, "source_key")
    here = F.col("bin") == F.col("end.bin")
    inside = Window.partitionBy("source_key", "bin").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(here).withColumn("p", F.col("end.before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("picked", 2 * F.col("p") + F.col("size") <= 2 * F.col("rest"))
    clear = rows.where(~F.coalesce(here, F.lit(False))).withColumn("picked", F.coalesce(F.col("bin") < F.col("end.bin"), F.lit(False)))
    out = ["doc_id", *more, "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).alias("taken")]
    return clear.select(*out).unionByName(edge.select(*out))


def oracle() -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                 coalesce(0.05::DOUBLE + 0.95::DOUBLE * (length(regexp_replace(text, '{LETTER}', '', 'g'))::DOUBLE / greatest(length(text), 1))
                   * (length(regexp_replace(text, '{LETTER}', '', 'g'))::DOUBLE / greatest(length(text), 1)), 0.05::DOUBLE) AS w,
                 ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS bits FROM documents),
    k AS (SELECT *, -ln((bits + 0.5::DOUBLE) / {float(2**52)!r}::DOUBLE) / w AS k FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
    w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS sw, source_size * {float(MOST_EPOCHS)!r}::DOUBLE AS cap FROM s),
    l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(sw) OVER () - coalesce(sum(sw) OVER b, 0)) AS level
          FROM w WINDOW b AS (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, CASE WHEN source_size = 0 THEN 0::DOUBLE ELSE coalesce(least(cap, (SELECT arg_min(level, cap / sw) FROM l WHERE cap / sw > level) * sw), cap) END AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
    p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
                 coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
    """
