"""Runs (maximal repetitions) of words in whole texts, by the runs theorem.

Words become numbers, and every text ends in an end mark that is smaller than all words. The suffixes of a text are
sorted by prefix doubling; a batch of texts is sorted at once, each over letters of its own. The longest Lyndon word at
a place ends before the next smaller value of the inverse suffix array; for the inverse order of letters (the end mark
inverted too) the same is asked of the negated array. By the runs theorem the Lyndon roots of every run are among these
words. Each is extended to both sides with the longest common prefix of two suffixes: the array of those of neighbours
in suffix order, and a sparse table for its range minima, of the text and of the text read backwards. Roots whose
surroundings differ within a few words can't reach the exponent asked for; texts without any other root need no tables.

Work is of order n log n in a text's words, in numpy, and so is memory: about 8 (log2 of the longest repeat + log2 n)
bytes a word while the tables of one group of texts stand.

Defined cases: a null or empty text has no word and no run; a text of one word repeated is one run; of equal texts
each has its runs; rows of equal or null id are rows of their own; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded

#: A run has at least so many periods, and so many words.
EXPONENT, LEAST = 4, 6
#: Words of the texts that share tables; a longer text has tables of its own.
GROUP_WORDS = 1 << 18
#: So many words around a root are compared one by one before tables are built.
LOOK = 8
#: Texts from this length on give their words one by one, so that they never stand in a list together.
LONG = 1 << 22
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_words = re.compile(WORD)


def suffix_ranks(letters: np.ndarray, text_of: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """The place of each suffix among all of them, texts in their order; every text ends in letter 0, which is in it once.

    levels, if given, gets the ranks by the first 1, 2, 4 .. letters: equal ones tell equal beginnings.
    """
    n = len(letters)
    key = text_of.astype(np.int64) * (int(letters.max()) + 1) + letters
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.concatenate((fresh[1:], [True]))
    open_, h = order[~alone], 1
    while True:
        if levels is not None:
            levels.append(rank.astype(np.int32))
        if not len(open_):
            return rank
        old = rank[open_]
        key = old * (n + 1) + rank[open_ + h]
        by = np.argsort(key)
        open_, old, key = open_[by], old[by], key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.arange(len(open_))
        rank[open_] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        open_ = open_[~(fresh & np.concatenate((fresh[1:], [True])))]
        h *= 2


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value than each place has, or the array's length; values are positive.

    Steps of 1, 2, 4 .. are taken over tables of minima as long as these are greater, then smaller steps again.
    """
    n = len(values)
    tables = [np.concatenate((values, [-1]))]
    asked, place = np.arange(n), np.arange(1, n + 1)
    stopped: list[np.ndarray] = []
    out = place.copy()
    while len(asked):
        table = tables[-1]
        on = table[place] > values[asked]
        out[asked] = place
        stopped.append(asked[~on])
        step = 1 << (len(tables) - 1)
        asked, place = asked[on], place[on] + step
        out[asked] = place
        if len(asked):
            tables.append(np.minimum(table, np.concatenate((table[step:], np.full(min(step, n + 1), -1)))[: n + 1]))
            place = np.minimum(place, n)
    down = np.zeros(0, np.int64)
    for level in range(len(stopped) - 1, 0, -1):
        down = np.concatenate((down, stopped[level]))
        place = out[down]
        out[down] = np.where(tables[level - 1][np.minimum(place, n)] > values[down], place + (1 << (level - 1)), place)
    return np.minimum(out, n)


class CommonPrefixes:
    """How many letters two suffixes of a text have in common: prefixes of neighbours in suffix order, and their range minima."""

    def __init__(self, letters: np.ndarray, text_of: np.ndarray):
        levels: list[np.ndarray] = []
        self.rank = suffix_ranks(letters, text_of, levels)
        n = len(letters)
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        a, b, common = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(n, np.int32)
        for level in range(len(levels) - 1, -1, -1):
            step = np.where(levels[level][a] == levels[level][b], 1 << level, 0)
            a, b = a + step, b + step
            common[1:] += step.astype(np.int32)
        del levels
        rows = [common]  # rows[k][r]: the least of common[r : r + 2**k]
        longest = int(common.max(initial=0))
        while longest and 1 << len(rows) <= n:
            half, last = 1 << (len(rows) - 1), rows[-1]
            both = np.minimum(last[:-half], last[half:])
            rows.append(np.concatenate((both, np.zeros(n - len(both), np.int32))))
            if not both.any():
                break
        self.table = np.stack(rows)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the suffixes at a and b, which differ."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        none = k >= len(self.table)  # ranges so long that their least is 0
        k = np.where(none, 0, k)
        return np.where(none, 0, np.minimum(self.table[k, low], self.table[k, np.maximum(high - (1 << k), 0)]))


def lyndon_roots(letters: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest Lyndon word at every place, for both orders; ends: where the end mark of each text stands."""
    rank = suffix_ranks(letters, text_of)
    begin, stop = [], []
    for values in (rank + 1, len(rank) - rank):
        end = next_smaller(values)
        at = np.flatnonzero(end <= ends[text_of])  # longer words hold the end mark
        at = at[letters[at] > 0]
        begin.append(at)
        stop.append(end[at])
    return np.concatenate(begin), np.concatenate(stop)


def _promising(letters: np.ndarray, i: np.ndarray, j: np.ndarray, exponent: int) -> np.ndarray:
    """Of the roots [i, j) those that may reach the exponent: half of what is missing has to follow, or to come before."""
    want = np.minimum(-(-(exponent - 1) * (j - i) // 2), LOOK)
    found = np.zeros(len(i), bool)
    for step, shift in ((1, 0), (-1, -1)):
        at, ok = np.arange(len(i)), np.zeros(len(i), bool)
        for t in range(LOOK):
            ok[at[want[at] <= t]] = True
            at = at[want[at] > t]
            a, b = i[at] + shift + step * t, j[at] + shift + step * t
            inside = (a >= 0) & (b < len(letters))
            at, a, b = at[inside], a[inside], b[inside]
            at = at[(letters[a] == letters[b]) & (letters[a] > 0)]
        ok[at] = True
        found |= ok
    return found


def runs_of(texts: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """start, length, period of each text's runs, by start, then period; texts: word numbers from 1 on."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes >= least)
    if not len(full):
        return out
    letters, text_of, starts = _joined([texts[t] for t in full])
    ends = starts + sizes[full]
    i, j = lyndon_roots(letters, text_of, ends)
    ok = (j - i) * exponent <= sizes[full][text_of[i]]
    i, j = i[ok], j[ok]
    ok = _promising(letters, i, j, exponent)
    i, j = i[ok], j[ok]
    owners, group, held = np.unique(text_of[i]), [], 0
    by_text = _split(text_of[i], owners)
    for t in [*owners, None]:
        if t is None or (held and held + sizes[full][t] > GROUP_WORDS):
            if group:
                _extend([(int(full[g]), texts[full[g]], i[by_text[int(g)]] - starts[g], j[by_text[int(g)]] - starts[g]) for g in group], exponent, least, out)
            group, held = [], 0
        if t is not None:
            group.append(t)
            held += sizes[full][t]
    return out


def _split(owner: np.ndarray, owners: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], owners)
    return dict(zip(owners.tolist(), np.split(order, cuts[1:]), strict=True)) if len(owners) else {}


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with an end mark behind each, the text of each place, and where each text begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    end = np.zeros(1, np.int64)
    return np.concatenate([x for t in texts for x in (t, end)]), np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes


def _extend(group: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], exponent: int, least: int, out: list[np.ndarray]) -> None:
    """Extends the roots of a group of texts to runs, which go to out. group: number, words, begins and ends of roots."""
    letters, text_of, starts = _joined([g[1] for g in group])
    ahead = CommonPrefixes(letters, text_of)
    back = CommonPrefixes(_joined([g[1][::-1] for g in group])[0], text_of)
    for (number, words, i, j), at in zip(group, starts, strict=True):
        n = len(words)
        right = ahead.of(i + at, j + at)
        left = np.where(i > 0, back.of(at + np.minimum(n - i, n), at + n - j), 0)  # the letter before i is the (n - i)-th of the text read backwards
        start, length, period = i - left, j - i + left + right, j - i
        ok = length >= np.maximum(least, exponent * period)
        out[number] = np.unique(np.stack((start, period, length), 1)[ok], axis=0)[:, [0, 2, 1]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when of every run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed: the text's words, of every run only the first period, joined by spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: defaultdict[str, int] = defaultdict()
            numbers.default_factory = lambda numbers=numbers: len(numbers) + 1
            texts, words = [], []
            for text in batch.column("text").to_pylist():
                found = _words.findall(text or "") if len(text or "") < LONG else None
                stream = found if found is not None else (m[0] for m in _words.finditer(text))
                texts.append(np.fromiter(map(numbers.__getitem__, stream), np.int64, -1 if found is None else len(found)))
                words.append(found)
            names = None
            runs, collapsed = runs_of(texts, exponent, least), []
            for t, (codes, found) in enumerate(zip(texts, words, strict=True)):
                if found is None:
                    names = names or ["", *numbers]
                    keep = kept_words(len(codes), runs[t])
                    collapsed.append(" ".join(map(names.__getitem__, codes[keep])))
                elif len(runs[t]):
                    collapsed.append(" ".join([found[w] for w in np.flatnonzero(kept_words(len(codes), runs[t]))]))
                else:
                    collapsed.append(" ".join(found))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), listed, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(bounded(work), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with periodic endings in a tenth of the texts: h = crc32 of the id leaves 0 by 10, and from word a on every word is the one p words before.

    a is h / 10 modulo the number of words, p a third to a tenth of what follows. A null id has no hash and keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def ending(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        rest = n - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, rest)), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    told = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, ending(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(told, F.col("text"))).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """What op11 returns: the runs of docs with periodic endings, the strongest of them, and digests of all of them and of the collapsed text."""
    found = periodic_runs(with_periods(docs))
    stronger = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    found = found.withColumn("best", F.aggregate("runs", none, stronger))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
