"""Snapshots: nesting children in chunks, counts, orphans, rules as tables of violations, redaction, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

PRIVATE = ("user_id", "chat_id", "owner_id", "started_by", "username", "first_name", "last_name")
VOLATILE = ("generated_at", "generated_ts")


#: Children that one array holds at most.
CHUNK = 10_000


def chunked(rows: DataFrame, by: list[str], order: list[str], name: str, size: int = CHUNK) -> DataFrame:
    """by, chunk (from 0), name: the other columns of rows as structs in order, `size` of them in an array, the last one shorter.

    Rows are numbered over ranges of the whole order first (`ranking.numbered`, which stages them), so a group of any
    size is as many rows as it has chunks, and no task gathers more than a chunk at a time.
    """
    rest = [c for c in rows.columns if c not in by]
    placed = numbered(rows, by, [F.asc(c) for c in order], "_place").withColumn("chunk", F.expr(f"(_place - 1) div {size}").cast("int"))
    grouped = placed.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*rest).alias("row")))).alias(name))
    return grouped.withColumn(name, F.transform(name, lambda x: x["row"]))


def nest(parents: DataFrame, children: DataFrame, key: str, ref: str, name: str, *order: str, size: int = CHUNK) -> DataFrame:
    """parents with chunk and an array column of so many of their children, in order: a row for each chunk, at least one; no children are an empty array."""
    grouped = chunked(children, [ref], list(order), name, size).withColumnRenamed(ref, "_ref")
    nested = parents.join(grouped, F.col(key) == F.col("_ref"), "left").drop("_ref")
    return nested.withColumn("chunk", F.coalesce("chunk", F.lit(0))).withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def unnest(nested: DataFrame, name: str, *keys: str) -> DataFrame:
    """The children of all chunks as rows, with the named columns of their parents."""
    return nested.select(*keys, F.explode(name).alias("_row")).select(*keys, "_row.*")


def orphans(children: DataFrame, parents: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Children whose parent is gone."""
    return children.join(parents.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def missing_inventory(quizzes: DataFrame, attempts: DataFrame, sessions: DataFrame, size: int = CHUNK) -> DataFrame:
    """quiz_id, kind (attempt or session), chunk, ids: the records of each quiz that is gone, in order, so many in a row."""
    lost = lambda df, kind: orphans(df, quizzes, "quiz_id").select("quiz_id", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
    rows = chunked(lost(attempts, "attempt").unionByName(lost(sessions, "session")), ["quiz_id", "kind"], ["id"], "ids", size)
    return rows.withColumn("ids", F.transform("ids", lambda x: x["id"]))


def violations(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """rule, record of each violation. checks: rule, rows that break it, and an expression that names a row."""
    out = None
    for rule, rows, record in checks:
        one = rows.select(F.lit(rule).alias("rule"), F.expr(record).cast("string").alias("record"))
        out = one if out is None else out.unionByName(one)
    return out


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def snapshot_checks(quizzes: DataFrame, questions: DataFrame, attempts: DataFrame, answers: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """The rules of a snapshot. declared: quiz ids known to be gone, which records may still name."""
    known = quizzes.select(F.col("id").alias("quiz_id"))
    known = known if declared is None else known.unionByName(declared.select("quiz_id"))
    recorded = answers.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n"))
    return violations([
        ("quiz id missing", quizzes.where(blank("id")), "title"),
        ("quiz id repeated", repeated(quizzes.where(~blank("id")), "id"), "id"),
        ("quiz title missing", quizzes.where(blank("title")), "id"),
        ("position repeated", repeated(questions.where("position IS NOT NULL"), "quiz_id", "position"), "concat(quiz_id, '#', position)"),
        ("question empty", questions.where(blank("question")), "id"),
        ("answer outside options", questions.where("correct_index IS NULL OR correct_index < 0 OR correct_index >= n_options"), "id"),
        ("too few options", questions.where("n_options < 2"), "id"),
        ("attempt of unknown quiz", attempts.join(known, "quiz_id", "left_anti"), "id"),
        ("more answers than questions", attempts.join(recorded, F.col("id") == F.col("attempt_id")).where("total > 0 AND n > total"), "id"),
        ("answer of unknown attempt", orphans(answers, attempts, "attempt_id"), "id"),
        ("answer status unknown", answers.where("status IS NOT NULL AND status NOT IN ('correct', 'wrong', 'skipped', 'timeout')"), "id"),
    ])


def count_mismatches(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """name, declared, actual of tables (name, rows) whose counts differ; a side that is missing is null."""
    both = declared.withColumnRenamed("rows", "declared").join(actual.withColumnRenamed("rows", "actual"), "name", "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("actual")))


def redact(df: DataFrame, drop: bool = False) -> DataFrame:
    """df without people: their columns go, or keep their name and type and turn null; the rows are marked."""
    out = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in PRIVATE else F.col(f.name) for f in df.schema.fields if not (drop and f.name in PRIVATE)]
    return df.select(*out, F.lit(True).alias("redacted"))


def user_refs(users: DataFrame) -> DataFrame:
    """users without people and with a surrogate, u0 on by order of id; what runs again numbers alike."""
    placed = numbered(users, [], [F.asc("user_id")], "_place")
    return placed.select(*[c for c in users.columns if c not in PRIVATE], F.concat(F.lit("u"), (F.col("_place") - 1).cast("string")).alias("user_ref"))


def row_digest(df: DataFrame) -> Column:
    """A digest of a row's canonical JSON, columns in order of name, volatile ones left out."""
    kept = sorted(c for c in df.columns if c not in VOLATILE)
    return F.sha2(F.to_json(F.struct(*kept)), 256)


def content_hash(df: DataFrame) -> DataFrame:
    """rows, digest: the same for the same rows in any order, and of fixed size however many they are."""
    part = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(part.alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("d"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def secret_fields(text: Column, secrets: list[str] = ()) -> Column:
    """What a serialised snapshot must not hold and does: live secrets (by place in the list) and credential fields."""
    found = [F.when(text.contains(s), F.lit(f"secret {i}")) for i, s in enumerate(secrets) if s]
    found += [F.when(text.contains(f'"{k}"'), F.lit(f"field {k}")) for k in ("password", "api_key", "api_hash")]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
