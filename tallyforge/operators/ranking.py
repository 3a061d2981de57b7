"""Row numbers of groups of any size: rows are dealt by ranges of the whole order, numbered in each range, and ranges are counted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place", total: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with their number (from 1) among those of equal `by`, and how many those are. It runs a job: the dealt rows are staged.

    order: sort columns that together tell the rows of a group apart. Splitters are sampled once from the rows
    themselves, over `by` and the whole order, so neither a hot group, nor equal scores, nor sparse ids fill a task;
    what is staged fixes them. A group that spans ranges goes on from the counts of those before: such (group, range)
    pairs are two for each range at most, whatever the table, and are broadcast. by may be empty, nulls are a group,
    and come in the order as Spark sorts them. parts: the number of ranges, else as Spark's shuffle partitions.
    """
    keys = [*map(F.col, by), *order]
    dealt = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    group = Window.partitionBy(*by)
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select(*[F.col(b).alias(f"_s{b}") for b in by], F.col("_part").alias("_s_part"), "_n", before.alias("_from"), F.sum("_n").over(group).alias("_all")).where("_all > _n")
    same = F.col("_part") == F.col("_s_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_s{b}"))
    inside = Window.partitionBy(*by, "_part")
    out = placed.withColumn("_i", F.row_number().over(inside.orderBy("_at")))
    out = out.withColumn("_here", F.count(F.lit(1)).over(inside)) if total else out
    out = out.join(F.broadcast(spans), same, "left").withColumn(name, F.coalesce("_from", F.lit(0)) + F.col("_i"))
    out = out.withColumn(total, F.coalesce("_all", "_here")) if total else out
    return out.select(*rows.columns, name, *([total] if total else []))
