"""Bytes to text, in Arrow batches: marks, declared character sets, fallbacks; what is no text is a row with its reason."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import bounded

MOST_BYTES = 12 << 20
#: First bytes of what is no text, and marks of byte order with their sets.
REFUSED = {b"%PDF-": "a PDF file", b"PK\x03\x04": "a ZIP file"}
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
#: Where a page may declare its set, and what is tried where nothing fits.
DECLARED_IN, FALLBACKS = 2048, ("utf-8", "cp1252", "latin-1")
_declared = re.compile(rb"charset\s*=\s*[\"']?\s*([a-z0-9_-]+)")


def marked(raw: bytes) -> str | None:
    """The set that a mark at the head tells."""
    return next((name for mark, name in MARKS.items() if raw.startswith(mark)), None)


def declared(raw: bytes) -> str | None:
    """The set that the head of a page declares, if there is such a set."""
    m = _declared.search(raw[:DECLARED_IN].lower())
    try:
        return codecs.lookup(m[1].decode("ascii")).name if m else None
    except LookupError:
        return None


def _tried(raw: bytes, names: tuple[str | None, ...]) -> tuple[str, str]:
    """Text and set, by the first that fits."""
    for name in filter(None, names):
        try:
            return raw.decode(name), name
        except (UnicodeError, LookupError):  # a set may be no set of characters at all
            continue
    raise ValueError("no text in a known character set")


def page_text(raw: bytes) -> tuple[str, str]:
    """A page's text and character set: by mark, else as declared, else by the usual ones, of which the last fits any bytes. ValueError for what is no page."""
    if not raw:
        raise ValueError("empty")
    if len(raw) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes")
    for head, what in REFUSED.items():
        if raw.startswith(head):
            raise ValueError(what)
    return _tried(raw, (marked(raw), declared(raw), *FALLBACKS))


def plain_text(raw: bytes) -> tuple[str, str]:
    """A text file's text and set: UTF-8, or UTF-16 with a mark; ValueError otherwise."""
    name = marked(raw) or "utf-8"
    try:
        return raw.decode(name), name
    except UnicodeDecodeError as e:
        raise ValueError(str(e)) from None


def decoded(files: DataFrame, *keys: str, content: str = "content", how: Callable[[bytes], tuple[str, str]] = page_text) -> DataFrame:
    """The keys of files, text, charset, error. Null bytes are an error too; one file can't fail the others."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(len(keys)):
                try:
                    rows.append((*how(raw.as_py() or b""), None))
                except ValueError as e:
                    rows.append((None, None, str(e)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array([r[c] for r in rows], pa.string()) for c in range(3))], [*keys, "text", "charset", "error"])

    return files.select(*keys, content).mapInArrow(bounded(work), f"{kinds}, text string, charset string, error string")
