"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean embedding of its hashed letter n-grams (1 to 3, word ends marked); a softmax layer names the
language. Both layers are trained in numpy by stochastic gradient descent on a bounded sample of labelled rows: at
most SAMPLE rows, the same number for each language, drawn by a hash of the id over the whole table.

Rejection is learned too. Each third drawn row also gives a negative: its letters shuffled, or replaced by random ones,
or most of them by signs. Negatives are one more class of the softmax, which is never named but takes its share of the
probability. A fifth of rows and negatives is kept for calibration: a temperature is fitted to it, and the level lies
midway between the score that all but NEGATIVES of the negatives stay under and the one that all but REJECT of the
rightly named texts reach, or is the latter if it is the lower one. A text that scores less is not accepted.

Prediction reads whole texts, in pieces of PIECE characters. The two layers are multiplied out beforehand, so that a
text costs one count of n-grams and one small product.

Defined cases: null text, or text without a letter, is `und` with score 0 and is rejected; rows without a language
teach nothing; without any labelled row everything is `und`; one language alone is always named; equal texts are named
alike; columns other than doc_id, text and lang are ignored or passed through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, held_out
from .textvec import mix

UND = "und"
BUCKETS, DIM = 4096, 16
SAMPLE, SAMPLE_EACH = 6000, 600
#: Languages that are learned: those of most rows.
MOST_LANGS = 1000
EPOCHS, RATE, MINIBATCH, SEED = 30, 4.0, 32, 7
#: The largest step of one embedding component, so that no minibatch throws the training off.
STEP = 1.0
REJECT, NEGATIVES, NEGATIVE_EACH = 0.002, 0.01, 3
SIGNS = "#$%&*+-/<=>@^_|~0123456789"
PIECE = 1 << 19
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur in a whole text; None if it has no letter. The pieces it is read in don't show."""
    total = np.zeros(BUCKETS, np.int64)
    letter, seen, tail, text = _is_letter(), False, np.zeros(1, np.uint64), text.lower()
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letter[np.minimum(codes, 0x10FFFF)], codes, 0).astype(np.uint64)
        codes = np.concatenate([tail, codes, np.zeros(int(start + PIECE >= len(text)), np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        new = len(tail)
        one = codes[new:][codes[new:] != 0]
        seen = seen or len(one) > 0
        two = codes[new - 1 : -1] * np.uint64(0x1F123BB5) + codes[new:] + np.uint64(1 << 40)
        at = max(new, 2)
        three = (codes[at - 2 : -2] * np.uint64(0x1F123BB5) + codes[at - 1 : -1]) * np.uint64(0x1F123BB5) + codes[at:] + np.uint64(1 << 41)
        grams = np.concatenate([one, two, three[codes[at - 1 : -1] != 0]])
        total += np.bincount((mix(grams) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        tail = codes[-2:]
    return total if seen else None


def negative(text: str) -> str:
    """A text that is no language's, made from a whole one, PIECE characters at a time: letters shuffled, or replaced by random ones, or most by signs. Equal texts give equal negatives."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    kind, letter, out = rng.integers(3), _is_letter(), []
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        at = np.flatnonzero(letter[np.minimum(codes, 0x10FFFF)])
        if kind == 0:
            codes[at] = codes[rng.permutation(at)]
        elif kind == 1:
            codes[at] = rng.integers(ord("a"), ord("z") + 1, len(at))
        else:
            away = at[rng.random(len(at)) < 0.9]
            codes[away] = np.array([*map(ord, SIGNS)], np.uint32)[rng.integers(len(SIGNS), size=len(away))]
        out.append(codes.tobytes().decode("utf-32-le", "surrogatepass"))
    return "".join(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x (languages, then no language): embeddings times softmax layer, over the temperature
    bias: np.ndarray
    level: float
    #: On calibration rows: how many rightly named ones are accepted, how many accepted ones are named wrongly, how many negatives are accepted.
    coverage: float = 1.0
    error: float = 0.0
    let_in: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for start in range(0, len(texts), 256):
            counts = [None if not t else ngram_counts(t) for t in texts[start : start + 256]]
            at = [i for i, c in enumerate(counts) if c is not None]
            if at:
                x = np.array([counts[i] for i in at], np.float64)
                p = _softmax((x / x.sum(axis=1, keepdims=True)) @ self.weights + self.bias)[:, : len(self.langs)]
                for i, row in zip(at, p, strict=True):
                    names[start + i], scores[start + i] = self.langs[int(row.argmax())], row.max()
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: A text's n-grams: which buckets they fall in, and how many in each.
Counts = tuple[np.ndarray, np.ndarray]


def _dense(rows: list[Counts]) -> np.ndarray:
    """Shares of the buckets in each row."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for x, (at, n) in zip(out, rows, strict=True):
        x[at] = n
    return out / out.sum(axis=1, keepdims=True)


def fit(counts: list[Counts], labels: list[str | None]) -> Model:
    """counts of each row; the label of a negative is None. Rows are made dense a minibatch at a time, so the sample takes little of the driver's memory."""
    langs = sorted({x for x in labels if x is not None})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    y = np.array([len(langs) if x is None else langs.index(x) for x in labels])
    rng = np.random.default_rng(SEED)
    calibrate = rng.random(len(y)) < 0.2 if len(y) >= 20 else np.zeros(len(y), bool)
    xt, yt = [c for c, out in zip(counts, calibrate, strict=True) if not out], y[~calibrate]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs) + 1), np.float32), np.zeros(len(langs) + 1, np.float32)
    steps, step = EPOCHS * (-(-len(yt) // MINIBATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(yt))
        for start in range(0, len(order), MINIBATCH):
            at = order[start : start + MINIBATCH]
            rate = RATE * (1 - step / steps)
            xb = _dense([xt[i] for i in at])
            hidden = xb @ embed
            g = _softmax(hidden @ layer + bias)
            g[np.arange(len(at)), yt[at]] -= 1
            g /= len(at)
            back = rate * 20 * (xb.T @ (g @ layer.T))
            layer -= rate * (hidden.T @ g)
            bias -= 0.1 * g.sum(axis=0)
            embed -= back * min(1.0, STEP / max(1e-9, float(np.abs(back).max())))
            step += 1
    checked, yc = ([c for c, out in zip(counts, calibrate, strict=True) if out], y[calibrate]) if calibrate.any() else (xt, yt)
    z = (_dense(checked) @ embed @ layer + bias).astype(np.float64)
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(yc)), yc], 1e-12)).mean()
    heat = min(np.geomspace(0.25, 4, 33), key=loss)
    p = _softmax(z / heat)[:, : len(langs)]
    best, right, junk = p.max(axis=1), p.argmax(axis=1) == yc, yc == len(langs)
    most = float(np.quantile(best[right], REJECT)) if right.any() else 0.0
    least = float(np.quantile(best[junk], 1 - NEGATIVES, method="higher")) if junk.any() else 0.0
    level = (least + most) / 2 if least < most else most
    passed = best >= level
    rates = [float(x.mean()) if len(x) else 0.0 for x in (passed[right], ~right[passed & ~junk], passed[junk])]
    return Model(langs, (embed @ layer).astype(np.float64) / heat, bias.astype(np.float64) / heat, level, *rates)


def train(docs: DataFrame) -> Model:
    """A model of the languages of docs (doc_id, text, lang), from rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.where(F.col("text").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return fit([], [])
    each = min(SAMPLE_EACH, max(1, SAMPLE // len(sizes)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 24)) < F.element_at(share, F.col("lang")) * F.lit(float(1 << 24)))
    # An id that many rows share is drawn with all of them: one of them learns, so the sample stays as large as it is said to be.
    drawn = drawn.groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text", "x.lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, at, counts = [], [], [], []
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if not text:
                    continue
                made = [(lang, text)] if zlib.crc32(str(key).encode()) // 4 % NEGATIVE_EACH else [(lang, text), (None, negative(text))]
                for label, t in made:
                    c = ngram_counts(t)
                    if c is not None:
                        used = np.flatnonzero(c)
                        keys.append(str(key))
                        langs.append(label)
                        at.append(used.astype(np.int16).tobytes())
                        counts.append(c[used].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["k", "lang", "at", "n"])

    rows = sorted(drawn.mapInArrow(bounded(work), "k string, lang string, at binary, n binary").collect(), key=lambda r: (r["k"], r["lang"] or "", bytes(r["n"])))
    return fit([(np.frombuffer(r["at"], np.int16), np.frombuffer(r["n"], np.int32)) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, *passed: str) -> DataFrame:
    """The passed columns of docs, then lang_pred, score and accepted, which no passed column may be named."""
    columns = list(passed)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(batch.num_columns - 1).to_pylist())
            ok = [n != UND and s >= model.level for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ok, pa.bool_())], [*columns, "lang_pred", "score", "accepted"])

    return docs.select(*[f"`{c}`" for c in columns], F.col("text").alias("_tf_text")).mapInArrow(bounded(work), f"{kinds}, lang_pred string, score double, accepted boolean")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    out = identify(docs, train(docs), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told with confidence, with all their columns."""
    names = {c: f"_tf_{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], "text")
    kept = identify(hidden, train(docs), *names.values()).where("accepted")
    return kept.select(*[_restored(x, c) for c, x in names.items()])


def _restored(hidden: str, name: str) -> Column:
    return F.col(hidden).alias(name)
