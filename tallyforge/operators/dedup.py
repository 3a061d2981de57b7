"""Question signatures, duplicates across files, parts, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered

PER_PART = 500
#: Words that say nothing of a topic.
GENERIC = [
    "source", "import", "quiz", "test", "questions", "question", "mcq", "mcqs", "file", "doc", "document", "text", "txt", "pdf", "html", "data", "set",
    "part", "paper", "exam", "notes", "sample", "new", "old", "untitled",
]
TOPIC_WORDS = "topic|chapter|ch|unit|lesson|module|अध्याय|टॉपिक|इकाई|पाठ"


def _folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def signature(question: Column, options: Column, correct_index: Column) -> Column:
    """What makes two questions the same: text and options without case and spacing, and the answer."""
    return F.sha2(F.to_json(F.struct(_folded(F.coalesce(question, F.lit(""))).alias("q"), F.transform(options, _folded).alias("o"), F.coalesce(correct_index, F.lit(-1)).alias("i"))), 256)


def cross_file_duplicates(questions: DataFrame) -> DataFrame:
    """sig, file_no, n of repeats (sig, file_no): rows of a file whose signature an earlier file had. Repeats inside one file are kept."""
    first = questions.groupBy("sig").agg(F.min("file_no").alias("first"))
    return questions.join(first, "sig").where(F.col("file_no") > F.col("first")).groupBy("sig", "file_no").agg(F.count(F.lit(1)).alias("n"))


def distinct_files(files: DataFrame) -> DataFrame:
    """file_no, sha256, kept: the first file of each content is kept."""
    first = files.groupBy("sha256").agg(F.min("file_no").alias("first"))
    return files.join(first, "sha256").select("file_no", "sha256", (F.col("file_no") == F.col("first")).alias("kept"))


def parts(questions: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """questions (quiz_id, position, id, ..) with the part that each falls in."""
    placed = numbered(questions, ["quiz_id"], [F.asc("position"), F.asc("id")], "_place")
    return placed.withColumn("part", F.floor((F.col("_place") - 1) / per_part).cast("int") + 1).drop("_place")


def part_ranges(planned: DataFrame) -> DataFrame:
    """quiz_id, part, first, last, n: the questions between which each part runs."""
    return planned.groupBy("quiz_id", "part").agg(F.min_by("id", F.struct("position", "id")).alias("first"), F.max_by("id", F.struct("position", "id")).alias("last"), F.count(F.lit(1)).alias("n"))


def topic_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, rf"(?i)^(?:{TOPIC_WORDS})[\s_\-–—:.#]*0*(\d+)(?![0-9A-Za-z_])", 1), F.lit("")).cast("int")


def topic_key(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[\s_\-–—:.]+", "_"), "^_+|_+$", "")


def topic_words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, "_"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~w.rlike(rf"(?i)^(?:{TOPIC_WORDS})$") & ~w.isin(GENERIC)))


def topic_relation(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """same, different or ambiguous, for two files with caption, number, words and key."""
    shared = F.array_intersect(a["words"], b["words"])
    nested = (F.size(F.array_except(a["words"], b["words"])) == 0) | (F.size(F.array_except(b["words"], a["words"])) == 0)
    some = F.size(shared) > 0
    close = (F.size(shared) >= 2) | (some & nested)
    both_empty = (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0)
    longest = F.array_max(F.transform(shared, F.length))
    return (
        F.when((a["caption"] != "") & (F.lower(a["caption"]) == F.lower(b["caption"])), "same")
        .when(a["number"].isNotNull() & b["number"].isNotNull(), F.when((a["number"] != b["number"]) | (both_empty & ~some), "different").otherwise("same"))
        .when(a["number"].isNotNull() | b["number"].isNotNull(), F.when(close, "same").otherwise("different"))
        .when(~both_empty, "ambiguous")
        .when(a["key"] == b["key"], F.when((F.length(a["key"]) < 3) | a["key"].isin(GENERIC), "ambiguous").otherwise("same"))
        .when((F.size(shared) >= 2) | (some & nested & (longest >= 4)), "same").otherwise("different")
    )


def ordered_sections(questions: DataFrame, timers: DataFrame) -> DataFrame:
    """quiz_id, n, section: named sections by where they first occur, then those that only have a timer."""
    seen = questions.select("quiz_id", F.trim("section").alias("section"), "position").where("section <> ''").groupBy("quiz_id", "section").agg(F.min("position").alias("at"))
    extra = timers.select("quiz_id", F.trim("section").alias("section"), F.lit(2**31 - 1).alias("at")).where("section <> ''")
    every = seen.unionByName(extra).groupBy("quiz_id", "section").agg(F.min("at").alias("at"))
    return every.select("quiz_id", F.row_number().over(Window.partitionBy("quiz_id").orderBy("at", "section")).alias("n"), "section")


def odd_option_counts(questions: DataFrame) -> DataFrame:
    """Questions (doc_id, number, n_options) that differ from a count which more than half of their document has."""
    counts = questions.groupBy("doc_id", "n_options").agg(F.count(F.lit(1)).alias("c"))
    usual = counts.groupBy("doc_id").agg(F.max_by("n_options", F.struct("c", F.lit(0) - F.col("n_options"))).alias("usual"), F.max("c").alias("c"), F.sum("c").alias("all"))
    return questions.join(usual.where(F.col("c") * 2 > F.col("all")), "doc_id").where(F.col("n_options") != F.col("usual")).select("doc_id", "number", "n_options", "usual")


def unused_keys(keys: DataFrame, used: DataFrame) -> DataFrame:
    """Answer-key entries (doc_id, number) that no question took."""
    return keys.join(used.select("doc_id", "number"), ["doc_id", "number"], "left_anti")
