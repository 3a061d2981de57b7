"""Words torn apart in scanned text, joined by what the same document spells whole.

Words are counted for each document, possible joins of each line are looked up among them, and each line is put right
by the few counts that concern it: no task holds a document's words, and none is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEVANAGARI
from ..sources.layout import MOST_PIECES, PIECE_CHARS, respaced

_SCRIPT = f"^[{DEVANAGARI}]+$"


def lexicon(lines: DataFrame, *doc: str) -> DataFrame:
    """doc, word, n: how often each document has each word of the script. Counts combine before the shuffle."""
    words = F.explode(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(_SCRIPT))).alias("word")
    return lines.select(*doc, words).groupBy(*doc, "word").agg(F.count(F.lit(1)).cast("int").alias("n"))


def candidates(text: Column) -> Column:
    """Words of a line, and what two to four neighbours that may be pieces of one spell together; each once."""
    tokens = F.split(text, "[ \n]")
    short = lambda w: (F.length(w) <= PIECE_CHARS) & w.rlike(_SCRIPT)

    def joined(k: int) -> Column:
        at = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
        spans = F.filter(F.transform(at, lambda i: F.slice(tokens, i, k)), lambda s: F.forall(s, short))
        return F.transform(spans, lambda s: F.array_join(s, ""))

    whole = F.filter(tokens, lambda w: w.rlike(_SCRIPT))
    return F.array_distinct(F.concat(whole, *(joined(k) for k in range(2, MOST_PIECES + 1))))


def rejoined(lines: DataFrame, words: DataFrame, *doc: str, line: str = "line") -> DataFrame:
    """doc, line, text, fixes (torn, whole) of lines (doc, line, text), by the counts of words (doc, word, n).

    A line without a torn word stays as it is; a null text has no fixes; documents without words change nothing.
    """
    keys = [*doc, line]
    asked = lines.select(*keys, F.explode(candidates(F.col("text"))).alias("word"))
    known = asked.join(words.where("n > 0"), [*doc, "word"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, text string, fixes array<struct<torn:string,whole:string>>"
    pair = pa.struct([("torn", pa.string()), ("whole", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fixes = [], []
            for text, counts in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                fixed, told = respaced(text, dict(counts or ())) if text is not None else (None, [])
                texts.append(fixed)
                fixes.append([{"torn": a, "whole": b} for a, b in told])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(fixes, pa.list_(pair))], [*keys, "text", "fixes"])

    same = F.lit(True)
    renamed = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "known")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return lines.join(renamed, same, "left").select(*keys, "text", "known").mapInArrow(work, out)
