"""Files as tables: texts of a folder, and documents to question, error and removed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import bounded
from . import charsets, dialects, items, marks, pages, papers

IMPORT_NAMES = r"(?i)\.(?:txt|html?|xhtml|json|pdf)$"


def looks_like_html(name: Column, mime: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\.(html|htm|xhtml)$"), F.lit(False)) | F.coalesce(F.lower(mime).isin("text/html", "application/xhtml+xml"), F.lit(False))


def is_text(name: Column, mime: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".txt") | (F.lower(mime) == "text/plain"), F.lit(False))


def is_import(name: Column, mime: Column) -> Column:
    return F.coalesce(name.rlike(IMPORT_NAMES), F.lit(False)) | looks_like_html(name, mime) | is_text(name, mime) | F.coalesce(F.lower(mime).isin("application/pdf", "application/json"), F.lit(False))


PARSERS: dict[str, Callable[[str | None], marks.Parsed]] = {
    "paper": papers.parse, "text": dialects.parse, "cards": dialects.plain_cards, "html": pages.extract, "json": lambda x: items.parse(x or "")[1], "reply": items.from_reply,
}


def parse_documents(docs: DataFrame, grammar: str | Callable[[str | None], marks.Parsed] = "text", *keys: str) -> DataFrame:
    """The keys of docs (doc_id if none are named) and what each text holds: questions, errors, removed, review. A text that breaks its parser is an error row, not a failed job."""
    keys = keys or ("doc_id",)
    how = PARSERS[grammar] if isinstance(grammar, str) else grammar
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    out_type = T._parse_datatype_string(f"{kinds}, {marks.PARSED_SCHEMA}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_type)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                try:
                    found = how(text)
                except Exception as e:  # whatever a parser trips over is told as a row; the job goes on
                    found = marks.Parsed(errors=[marks.Problem(None, f"the parser failed: {type(e).__name__}: {e}")])
                rows.append({k: batch.column(k)[i].as_py() for k in keys} | found.rows())
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return docs.select(*keys, "text").mapInArrow(bounded(work), out_type)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by key to as many tasks as shuffles have, for documents that are put together from few and small rows: parsing them is work, but Spark would join what is small into one task. Files that are scanned need it not."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def question_rows(parsed: DataFrame) -> DataFrame:
    keys = [c for c in parsed.columns if c not in ("questions", "errors", "removed", "review")]
    return parsed.select(*keys, F.explode("questions").alias("q")).select(*keys, "q.*")


def error_rows(parsed: DataFrame) -> DataFrame:
    keys = [c for c in parsed.columns if c not in ("questions", "errors", "removed", "review")]
    return parsed.select(*keys, F.explode("errors").alias("e")).select(*keys, "e.*")


def removed_rows(parsed: DataFrame) -> DataFrame:
    keys = [c for c in parsed.columns if c not in ("questions", "errors", "removed", "review")]
    return parsed.select(*keys, F.explode("removed").alias("r")).select(*keys, "r.*")


def _counts() -> dict[str, Column]:
    """Counts of one parsed document."""
    read = F.transform("questions", lambda q: F.struct(q["section_label"].alias("s"), q["number"].alias("n")))
    numbered = F.filter("errors", lambda e: e["number"].isNotNull())
    failed = F.size(F.array_except(F.transform(numbered, lambda e: F.struct(e["section"].alias("s"), e["number"].alias("n"))), read))
    keyed = F.size(F.filter("questions", lambda q: q["answer_source"] == "answer_key"))
    return {"parsed": F.size("questions"), "failed": failed, "other_errors": F.size("errors") - F.size(numbered), "answer_key": keyed}


def import_report(parsed: DataFrame, *by: str) -> DataFrame:
    """Counts of an import: detected, read, failed and other errors, answers by where they came from."""
    one = parsed.select(*by, *[c.alias(n) for n, c in _counts().items()])
    sums = one.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _counts()])
    return sums.withColumn("total_detected", F.col("parsed") + F.col("failed")).withColumn("answer_inline", F.col("parsed") - F.col("answer_key"))


def file_entries(files: DataFrame, grammar: str | Callable[[str | None], marks.Parsed] = "text", source: str = "file") -> DataFrame:
    """What is kept of each file (name, text, caption, title): its digest, its questions with the file that each is from, what went wrong, and counts.

    A null text has no digest; captions and titles may be null.
    """
    keyed = files.select("name", "caption", "title", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "text")
    parsed = parse_documents(keyed, grammar, "name", "caption", "title", "sha256")
    named = F.transform("questions", lambda q: q.withField("source_ref", F.col("name")))
    told = F.transform("errors", lambda e: F.concat_ws(": ", e["number"].cast("string"), e["message"]))
    report = F.struct(*[c.alias(n) for n, c in _counts().items()])
    return parsed.select("name", "sha256", "caption", F.col("title").alias("default_title"), F.lit(source).alias("source"), named.alias("questions"), told.alias("raw_errors"), F.col("errors").alias("errors_meta"), "review", "removed", report.alias("report"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text, error of each file in a folder: the text is null where the bytes aren't any, and the error says why."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")
    return charsets.decoded(found, "name", how=charsets.plain_text).select("name", "text", "error")
