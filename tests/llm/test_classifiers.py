"""The classifiers of language and quality against plain versions: n-grams counted one by one, a dense trainer, rules read row by row."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest

from tallyforge.llm import langid, quality
from tallyforge.llm.textvec import mix

from .test_operators import DOCS, make_docs

TEXTS = ["", "a", "Ab c", "  x  y ", "über Straße 12 ça!", "日本語 テスト", "a1b2", "éé", "\n\tA\n", "1234", "ﬁn İx", "\U0001f642 ok"]


def plain_counts(text):
    """Letters of the text between marks of word edges, and every one, two and three of them with a letter in the middle."""
    codes = [0]
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    codes += [0] if codes[-1] else []
    k, top = 0x1F123BB5, 2**64
    grams = [c for c in codes if c]
    grams += [(a * k + b + (1 << 40)) % top for a, b in zip(codes, codes[1:], strict=False)]
    grams += [((a * k + b) * k + c + (1 << 41)) % top for a, b, c in zip(codes, codes[1:], codes[2:], strict=False) if b]
    out = np.zeros(langid.BUCKETS, np.int64)
    for g in grams:
        out[int(mix(np.array([g], np.uint64))[0]) % langid.BUCKETS] += 1
    return out if any(codes) else None


@pytest.mark.parametrize("piece", [3, 1 << 19])
def test_ngram_counts(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice("abßé 1\n-Z") for _ in range(rng.randint(0, 60))) for _ in range(100)]:
        got, want = langid.ngram_counts(text), plain_counts(text)
        assert (got is None) == (want is None) and (got is None or (got == want).all()), text


def plain_fit(counts, labels):
    """The same steps on whole rows in double precision: weights, bias and level."""
    langs = sorted({x for x in labels if x is not None})
    y = [len(langs) if x is None else langs.index(x) for x in labels]
    x = [c / c.sum() for c in counts]
    rng = np.random.default_rng(langid.SEED)
    calibrate = rng.random(len(y)) < 0.2
    train = [i for i in range(len(y)) if not calibrate[i]]
    embed = rng.uniform(-1 / langid.DIM, 1 / langid.DIM, (langid.BUCKETS, langid.DIM))
    layer, bias = np.zeros((langid.DIM, len(langs) + 1)), np.zeros(len(langs) + 1)
    steps, step = langid.EPOCHS * math.ceil(len(train) / langid.MINIBATCH), 0

    def softmax(z):
        e = [math.exp(v - max(z)) for v in z]
        return np.array([v / sum(e) for v in e])

    for _ in range(langid.EPOCHS):
        order = rng.permutation(len(train))
        for start in range(0, len(order), langid.MINIBATCH):
            rows = [train[i] for i in order[start : start + langid.MINIBATCH]]
            rate = langid.RATE * (1 - step / steps)
            to_embed, to_layer, to_bias = np.zeros_like(embed), np.zeros_like(layer), np.zeros_like(bias)
            for i in rows:
                hidden = x[i] @ embed
                wrong = softmax(hidden @ layer + bias)
                wrong[y[i]] -= 1
                wrong /= len(rows)
                to_embed += np.outer(x[i], layer @ wrong)
                to_layer += np.outer(hidden, wrong)
                to_bias += wrong
            to_embed *= rate * 20
            layer -= rate * to_layer
            bias -= 0.1 * to_bias
            embed -= to_embed * min(1.0, langid.STEP / max(1e-9, np.abs(to_embed).max()))
            step += 1
    checked = [i for i in range(len(y)) if calibrate[i]]
    z = [x[i] @ embed @ layer + bias for i in checked]
    heat = min(np.geomspace(0.25, 4, 33), key=lambda t: -sum(math.log(max(softmax(v / t)[y[i]], 1e-12)) for v, i in zip(z, checked, strict=True)))
    return embed @ layer / heat, bias / heat


def test_fit_against_a_plain_trainer():
    rng = random.Random(2)
    kinds = {"aa": ["the", "ing", "er"], "bb": ["que", "ção", "os"], None: ["zxq", "qqv", "wkj"]}
    labels = [rng.choice(list(kinds)) for _ in range(90)]
    counts = [langid.ngram_counts(" ".join(rng.choice(kinds[k]) + rng.choice(kinds[k]) for _ in range(12))) for k in labels]
    model = langid.fit([(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts], labels)
    weights, bias = plain_fit(counts, labels)
    assert model.langs == ["aa", "bb"]
    for c in counts:
        x = c / c.sum()
        mine, plain = (np.exp(z) / np.exp(z).sum() for z in (x @ model.weights + model.bias, x @ weights + bias))
        assert np.abs(mine - plain).max() < 0.01 and mine.argmax() == plain.argmax()
    assert 0 < model.level < 1


def plain_statistics(text):
    text = text or ""
    words, lines, n = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n"), max(1, len(text))
    share = lambda ok: sum(map(ok, text)) / n
    n_words = max(1, len(words))
    return {
        "log_chars": math.log1p(len(text)), "chars_a_word": len(text) / n_words, "distinct_words": len(set(words)) / n_words, "distinct_lines": len(set(lines)) / len(lines),
        "upper": share(lambda c: unicodedata.category(c) == "Lu"), "symbols": share(lambda c: c in "#$%&*@^_~|<>=+\\{}[]/"), "bangs": share(lambda c: c in "!?"), "digits": share(lambda c: c in "0123456789"),
        "stops": share(lambda c: c in ".,;:"), "words_a_line": n_words / len(lines),
    }


def test_rules_read_row_by_row(spark):
    """Every document's score by the trained rules, from statistics counted character by character."""
    rng = random.Random(3)
    rows = [r for r in make_docs(n=300) if len(r[1] or "") < 100_000]
    rows += [[5000 + i, t, None, None, None] for i, t in enumerate([*TEXTS, "A!? #$ 1.\n\nA!? #$ 1.", "\\ / [x]"])]
    labels = [(r[0], int(len(set((r[1] or "").split())) > 40) if rng.random() < 0.9 else rng.randint(0, 1), 0) for r in rows if r[0] is not None]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.train(docs, known)
    assert rules.rules
    want = []
    for r in rows:
        stats = plain_statistics(r[1])
        z = rules.bias
        for bounds, weight in rules.rules:
            z += weight * all((low is None or stats[rules.names[i]] > low) and (high is None or stats[rules.names[i]] <= high) for i, low, high in bounds)
        want.append((str(r[0]), 1 / (1 + math.exp(-z))))
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.predict_quality(docs, known).collect())
    assert [k for k, _ in got] == [k for k, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], abs=1e-9)
