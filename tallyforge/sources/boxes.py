"""Documents of pages, pages of boxes: questions with the page that each is on. Where the boxes come from is a reader's matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import bounded
from . import layout, marks, papers
from .files import dealt
from .layout import Piece
from .marks import Parsed, Problem

PIECES = "pieces array<struct<x0: double, y0: double, x1: double, y1: double, text: string, size: double>>"
PAGES = f"page int, width double, height double, {PIECES}, error string"
#: A page: its number, width, height, pieces, and why it could not be read.
Page = tuple[int, float, float, list[Piece], str | None]


def read_pdf(raw: bytes) -> list[Page]:
    """Pages of a PDF file by the reader that is installed, if one is; ValueError tells what is wrong with the file."""
    if not raw:
        raise ValueError("the file is empty")
    if raw[:5] != b"%PDF-":
        raise ValueError("no PDF file")
    try:
        import fitz
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    out: list[Page] = []
    with fitz.open(stream=raw, filetype="pdf") as doc:
        if doc.needs_pass:
            raise ValueError("the file is locked")
        for i, page in enumerate(doc, 1):
            try:
                lines = (line for block in page.get_text("dict")["blocks"] for line in block.get("lines", ()))
                pieces = [x for line in lines for x in layout.lines_of([Piece(*s["bbox"], s["text"], s["size"]) for s in line["spans"]])]
                out.append((i, page.rect.width, page.rect.height, pieces, None))
            except (RuntimeError, ValueError, KeyError) as e:
                out.append((i, 0.0, 0.0, [], f"the page can't be read: {e}"))
    return out


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[Page]] = read_pdf) -> DataFrame:
    """name, page, width, height, pieces, error of the files in a folder; a file that can't be read is one row without a page."""
    out_type = T._parse_datatype_string(f"name string, {PAGES}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_type)
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    found = reader(raw.as_py() or b"")
                except ValueError as e:
                    found = [(None, None, None, [], str(e))]
                rows += [{"name": name, "page": n, "width": w, "height": h, "pieces": [vars(p) for p in pieces], "error": e} for n, w, h, pieces, e in found]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, out_type)


def page_lines(pages: list[Page]) -> tuple[list[tuple[int, str]], list[str], list[Problem]]:
    """Lines in reading order with their pages, repeated edges that were taken out, and a problem for each page without text."""
    whole = [p for p in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)) if p[4] is None and p[3]]
    bare, gone = layout.without_edges([(pieces, height) for _, _, height, pieces, _ in whole])
    lines: list[tuple[int, str]] = []
    for (number, width, _, _, _), pieces in zip(whole, bare, strict=True):
        ordered, _ = layout.in_order(pieces, width)
        texts, _ = layout.relabelled([x for p in ordered for x in p.text.split("\n")])
        lines += [(number, x) for x in texts]
    problems = [Problem(None, error or "the page has no text", page=number) for number, _, _, pieces, error in pages if error or not pieces]
    return lines, gone, problems


def parse(pages: list[Page]) -> Parsed:
    """All questions of a document's pages; a question that goes on over a page's end is on the page where it begins."""
    lines, gone, problems = page_lines(pages)
    if not lines:
        return Parsed(errors=problems or [Problem(None, "no pages")])
    out = papers.parse("\n".join(x for _, x in lines), [n for n, _ in lines])
    out.removed = [("header/footer", x) for x in gone] + out.removed
    out.errors = problems + out.errors
    return out


def parse_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and what its pages hold: questions, errors, removed, review. pages: key, page, width, height, pieces and, if there is one, error."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    every = dealt(pages, key).groupBy(key).agg(F.collect_list(F.struct("page", "width", "height", "pieces", error.alias("error"))).alias("pages"))  # a document's pages
    out_type = T._parse_datatype_string(f"{key} {pages.schema[key].dataType.simpleString()}, {marks.PARSED_SCHEMA}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_type)
        for batch in batches:
            rows = []
            for name, found in zip(batch.column(key).to_pylist(), batch.column("pages").to_pylist(), strict=True):
                try:
                    parsed = parse([(p["page"], p["width"], p["height"], [Piece(**x) for x in p["pieces"] or []], p["error"]) for p in found])
                except Exception as e:  # told as a row, as in files.parse_documents
                    parsed = Parsed(errors=[Problem(None, f"the parser failed: {e}")])
                rows.append({key: name} | parsed.rows())
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return every.mapInArrow(bounded(work), out_type)
