"""Writes to keyed tables, as pure functions of the old table and the new rows. Spark has no key to enforce, so each says what it does with it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN = frozenset({"token", "bot_token", "password", "secret", "api_key", "api_hash", "github_token"})


def visible(df: DataFrame) -> DataFrame:
    """A table without columns that hold credentials, at any depth of structs."""

    def fields(kind: T.StructType, at: str) -> list[Column]:
        out = []
        for f in kind.fields:
            if f.name.lower() in FORBIDDEN:
                continue
            path = f"{at}.`{f.name}`" if at else f"`{f.name}`"
            out.append((F.struct(*fields(f.dataType, path)) if isinstance(f.dataType, T.StructType) else F.col(path)).alias(f.name))
        return out

    return df.select(*fields(df.schema, ""))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns of schema: missing ones are added (with their default, or null), others are kept at the end."""
    have = set(df.columns)
    out = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*out, *[c for c in df.columns if c not in schema.names])


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    o = old.select(F.struct(*old.columns).alias("o"), *[F.col(k).alias(f"_k_{k}") for k in keys])
    n = new.select(F.struct(*new.columns).alias("n"), *[F.col(k).alias(f"_k_{k}") for k in keys])
    return o.join(n, [f"_k_{k}" for k in keys], "full")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """old with new rows put in by key. A key in both takes new's values, or those of `changes` (columns over structs o and n); `where` guards updates."""
    met = F.col("o").isNotNull() & F.col("n").isNotNull()
    met = met & F.coalesce(where, F.lit(False)) if where is not None else met
    out = []
    for c in old.columns:
        given = (changes or {}).get(c, (F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}")) if changes is None else F.col(f"o.{c}"))
        out.append(F.when(met, given).when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in new.columns else F.lit(None)).alias(c))
    return _paired(old, new, keys).select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old lacks are added; the rest is as it was."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def latest_of(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last row of each key; ties go to the greater row."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(F.col(by), *kept)).alias("r")).select(*keys, "r.*")


def swapped(old: DataFrame, wanted: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Compare and set: rows of wanted (keys, expected, value) change column where it is as expected; null counts as a value."""
    joined = old.join(wanted.select(*keys, "expected", "value", F.lit(True).alias("asked")), keys, "left")
    hit = F.coalesce(F.col("asked") & F.col(column).eqNullSafe(F.col("expected")), F.lit(False))
    return joined.select(*[F.when(hit, F.col("value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns], hit.alias("changed"))


def restore_plan(live: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """How a restore would go: rows inserted, updated (with a difference), unchanged, live only, and saved rows without a key."""
    shared = [c for c in saved.columns if c in live.columns and c not in keys]
    bad = " OR ".join(f"{k} IS NULL" for k in keys)
    usable = saved.where(f"NOT ({bad})")
    pairs = _paired(live.select(*keys, *shared), usable.select(*keys, *shared), keys)
    same = F.lit(True)
    for c in shared:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    kind = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "live only").when(same, "unchanged").otherwise("updated")
    counted = pairs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(saved.where(bad).groupBy(F.lit("without key").alias("kind")).agg(F.count(F.lit(1)).alias("rows")))


def lost_columns(target: Iterable[str], saved: DataFrame) -> list[str]:
    """Columns that saved has and the target lacks: restoring would lose them."""
    have = {c.lower() for c in target}
    return [c for c in saved.columns if c.lower() not in have]


def renumbered(questions: DataFrame) -> DataFrame:
    """Positions 1 to n in each quiz, in the order of the old ones."""
    order = Window.partitionBy("quiz_id").orderBy("position", "id")
    return questions.withColumn("position", F.row_number().over(order))


def without_questions(questions: DataFrame, gone: DataFrame) -> DataFrame:
    return renumbered(delete(questions, gone, ["id"]))


def moved(questions: DataFrame, moves: DataFrame) -> DataFrame:
    """questions after moves (id, delta): one step up or down in its quiz. A move past an end does nothing; one move for each quiz at most."""
    rows = renumbered(questions).join(moves.select("id", F.signum("delta").cast("int").alias("step")), "id", "left")
    size = F.count(F.lit(1)).over(Window.partitionBy("quiz_id"))
    rows = rows.withColumn("to", F.when(F.col("step").isNotNull() & (F.col("position") + F.col("step")).between(1, size), F.col("position") + F.col("step")))
    every = Window.partitionBy("quiz_id")
    start = F.max(F.when(F.col("to").isNotNull(), F.col("position"))).over(every)
    end = F.max("to").over(every)
    place = F.when(F.col("position") == start, end).when(F.col("position") == end, start).otherwise(F.col("position"))
    return rows.withColumn("position", place.cast("int")).select(*questions.columns)


def appended(questions: DataFrame, new: DataFrame, per_part: int = 500) -> DataFrame:
    """new rows (quiz_id, n, question) after the last position of their quiz; those past the part's size are marked refused, all of that quiz together."""
    last = questions.groupBy("quiz_id").agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("have"))
    rows = new.join(last, "quiz_id", "left").withColumn("last", F.coalesce("last", F.lit(0))).withColumn("have", F.coalesce("have", F.lit(0)))
    order = Window.partitionBy("quiz_id").orderBy("n")
    size = F.count(F.lit(1)).over(Window.partitionBy("quiz_id"))
    return rows.select("quiz_id", "n", "question", (F.col("last") + F.row_number().over(order)).cast("int").alias("position"), (F.col("have") + size > per_part).alias("refused"))


def fits(question: Column, options: Column, correct_index: Column, least: int = 2, most: int = 12) -> Column:
    """Whether a question may be stored: some text, 2 to 12 options, none blank, and an answer among them."""
    n = F.size(options)
    some = F.coalesce(F.trim(question), F.lit("")) != ""
    return F.coalesce(some & n.between(least, most) & ~F.exists(options, lambda o: F.coalesce(F.trim(o), F.lit("")) == "") & correct_index.between(0, n - 1), F.lit(False))


def section_name(value: Column, label: Column) -> Column:
    """A section's name: its own text, unless that is only a number and a label is there."""
    v, lab = F.trim(value), F.trim(label)
    return F.when((v != "") & ~v.rlike(r"^\p{Nd}+$"), v).when(lab != "", lab).otherwise(F.coalesce(v, F.lit("")))


def claims(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """events (event_key, user_id, sha256, target, at) that may go out: neither their key nor their live (user, sha256, target) is in the ledger, and they are the first of both among themselves."""
    live = ledger.where(F.col("status").isin("sending", "sent", "uncertain"))
    free = events.join(ledger.select("event_key"), "event_key", "left_anti").join(live.select("user_id", "sha256", "target"), ["user_id", "sha256", "target"], "left_anti")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("at", "event_key"))
    one = free.withColumn("n", first("event_key")).where("n = 1")
    return one.withColumn("n", first("user_id", "sha256", "target")).where("n = 1").drop("n")
