"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into one Spark column.

Shallow trees are boosted on the labelled rows; every path from a root, whole or cut short, is a conjunctive rule. A
lasso logistic regression over the rules keeps few of them. The kept rules become `when` expressions over the
statistics, which are Spark columns too, so scoring runs inside the JVM with no Python.

Labels are learned from a bounded sample: at most SAMPLE labelled rows or so, drawn by a hash of the id over the whole
table. Every document is scored on its whole text.

Defined cases: null text counts as empty and is scored; ids labelled more than once take their least label, and ids
of several rows teach by one of them; without labelled rows, or with one label only, every score is that label's
share (or 0.5); equal texts score alike; columns other than doc_id and text are ignored or passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out

SAMPLE, SEED = 12_000, 11
THRESHOLD = 0.7
TREES, DEPTH, SHRINK, BINS, LEAST_ROWS = 24, 3, 0.3, 32, 20
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)


def _pieces(text: Column) -> list[Column]:
    """A text, its words and its lines; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return [t, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.split(t, "\n")]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; none is null."""
    return _statistics(*_pieces(text))


def _statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    share = lambda pattern: 1 - F.length(F.regexp_replace(t, pattern, "")) / n
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "chars_a_word": F.length(t) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "upper": share(r"\p{Lu}+"),
        "symbols": share(r"[#$%&*@^_~|<>=+\\{}\[\]/]+"),
        "bangs": share(r"[!?]+"),
        "digits": share(r"[0-9]+"),
        "stops": share(r"[.,;:]+"),
        "words_a_line": n_words / F.size(lines),
    }


@dataclass
class Rules:
    names: list[str]
    #: Each rule: bounds by statistic (index, low or None, high or None; low < x <= high), and its weight.
    rules: list[tuple[list[tuple[int, float | None, float | None]], float]]
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, 0 to 1, from columns of the statistics."""
        z = F.lit(self.bias)
        for bounds, weight in self.rules:
            holds = F.lit(True)
            for i, low, high in bounds:
                c = stats[self.names[i]]
                holds = holds & (c > low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, bounds: dict, depth: int, found: list) -> list:
    """A tree of Newton steps; returns leaves (rows, value) and adds each node's bounds to found."""
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        all_g, all_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            k = len(edges[f])
            if not k:
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, k + 1))[:k] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], f, j)
    if best[1] is None:
        return [(rows, value)]
    f, j = best[1], best[2]
    cut, left = float(edges[f][j]), binned[rows, f] <= j
    low, high = bounds.get(f, (None, None))
    out = []
    for side, b in ((rows[left], {**bounds, f: (low, cut)}), (rows[~left], {**bounds, f: (cut, high)})):
        found.append(b)
        out += _grow(x, binned, edges, g, h, side, b, depth + 1, found)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[dict]:
    """The bounds of every node below a root of TREES boosted trees, each once."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    z, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        for rows, value in _grow(x, binned, edges, p - y, p * (1 - p), np.arange(len(y)), {}, 0, found):
            z[rows] += SHRINK * np.clip(value, -4, 4)
    return list({tuple(sorted(b.items())): b for b in found}.values())


def applies(bounds: dict, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, (low, high) in bounds.items():
        if low is not None:
            out &= x[:, f] > low
        if high is not None:
            out &= x[:, f] <= high
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps from (w, b)."""
    size = 4.0 * len(y) / (np.linalg.norm(np.column_stack([r, np.ones(len(y))]), 2) ** 2)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(400):
        e = (1 / (1 + np.exp(-(r @ vw + vb))) - y) / len(y)
        nw = vw - size * (r.T @ e)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb, nt = vb - size * e.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules(names, [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    check = np.random.default_rng(SEED).random(len(y)) < 0.25
    bounds = tree_rules(x[~check], y[~check])
    r = np.column_stack([applies(b, x) for b in bounds]).astype(np.float64) if bounds else np.zeros((len(y), 0))
    w, b, best = np.zeros(r.shape[1]), 0.0, None
    for penalty in PENALTIES:  # from sparse to dense, each from the one before
        w, b = _lasso(r[~check], y[~check], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean() if check.any() else penalty
        if best is None or loss < best[0] * 0.98:
            best = (loss, penalty)
    w, b = np.zeros(r.shape[1]), 0.0
    for penalty in PENALTIES:
        w, b = _lasso(r, y, penalty, w, b)
        if penalty == best[1]:
            break
    kept = [([(f, *bounds[i][f]) for f in sorted(bounds[i])], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-4)]
    return Rules(names, kept, float(b))


def train(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules for labels.quality, from labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, SAMPLE / max(1, known.count()))
    # SAMPLE rows or so, so this side may be broadcast.
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 24)) < F.lit(share * (1 << 24))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stats = statistics(F.col("text"))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", *[c.alias(n) for n, c in stats.items()])
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", *stats)).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: tuple(r))
    return fit(np.array([r[2:] for r in rows], float).reshape(len(rows), len(stats)), np.array([r["quality"] for r in rows], float), list(stats))


def scored(docs: DataFrame, rules: Rules, *passed: str) -> DataFrame:
    """The passed columns of docs, then score."""
    names = ["_tf_text", "_tf_words", "_tf_lines"]
    stats = _statistics(*map(F.col, names))
    pieces = docs.select(*[f"`{c}`" for c in passed], *[c.alias(n) for c, n in zip(_pieces(F.col("text")), names, strict=True)])
    # One row from a generator: a filter on the score stops there, instead of taking every statistic along into every rule.
    base = pieces.select(*[f"`{c}`" for c in passed], F.inline(F.array(F.struct(*[c.alias(f"_tf_{n}") for n, c in stats.items()]))))
    return base.select(*[f"`{c}`" for c in passed], rules.column({n: F.col(f"_tf_{n}") for n in stats}).alias("score"))


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs, train(docs, labels), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns."""
    names = {c: f"_tf_c{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], "text")
    kept = scored(hidden, train(docs, labels), *names.values()).where(F.col("score") >= THRESHOLD)
    return kept.select(*[F.col(x).alias(c) for c, x in names.items()])
