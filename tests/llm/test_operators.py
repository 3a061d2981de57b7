"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined cases."""

import hashlib
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import jaccard, langid, licenses, lm, media, mixing, quality, sharding, spm, topk
from tallyforge.llm.textvec import word_hashes

LICENSES = "/usr/share/common-licenses"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["the", "ing", "er", "on", "st"], "bb": ["ção", "que", "ão", "os", "le"], "cc": ["sch", "ung", "ei", "ß", "tz"]}


def make_docs(seed=1, n=120):
    """Nulls in each column, empty and blank texts, exact and near copies, a long text, a hot source."""
    rng, rows = random.Random(seed), []
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join(word(lang) for _ in range(rng.randint(1, 120)))
        rows.append([i, text, lang, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), len(text)])
    base = " ".join(word("aa") for _ in range(150))
    for i in range(25):
        words = base.split(" ")
        words[rng.randrange(150)] = f"w{i}"
        rows.append([n + i, " ".join(words), "aa", "hot", 0])
    for i in range(10):
        rows.append([n + 30 + i, base.upper() if i % 2 else base, "aa", "a", None])
    rows += [[900, None, None, None, None], [901, "", "aa", "a", 0], [902, " \t\n\x0b ", None, "b", 4], [None, "one two", "aa", None, 7], [904, "one\x0ctwo", "bb", "c", 7], [905, "12345 !!", None, "c", 7]]
    rows += [[906, "wort " * 300_000, "cc", "long", 0], [907, "a b c", "aa", "a", 5], [907, "a b c", "aa", "a", 5], [908, "x" * 3_000_000, "aa", "long", 0]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def crowded(docs):
    """Extra columns with names that operators use inside or return."""
    for name in ("size", "g", "k", "node", "score", "shard", "label", "n", "bin", "weight", "slice", "lang_pred", "accepted", "_tf_text"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_sharding(docs, rows):
    got = sharding.shard_documents(crowded(docs), 6).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))


def test_sharding_balance(spark):
    rng = random.Random(5)
    rows = [[i, "copy" * 5 if i % 3 == 0 else "t" * rng.randint(1, 400) + str(i), rng.choice("xy"), "s", 0] for i in range(4000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 24 and max(sizes) < 1.02 * min(sizes)


def kd_brute(units, leaves, dims, node=0):
    """Shard of each unit, by recursive cuts at the weighted quantile of the widest dimension; units: id -> (weight, keys)."""
    if leaves == 1 or not units:
        return dict.fromkeys(units, node)
    dim = max(range(dims), key=lambda i: (max(k[i] for _, k in units.values()) - min(k[i] for _, k in units.values()), -i))
    left = leaves // 2
    want, at, low = sum(w for w, _ in units.values()) * left / leaves, 0, []
    for u in sorted(units, key=lambda u: units[u][1][dim]):
        w = units[u][0]
        if at + w >= want:
            low += [u] if at + w - want < want - at else []
            break
        at, low = at + w, [*low, u]
    rest = {u: x for u, x in units.items() if u not in set(low)}
    return kd_brute({u: units[u] for u in low}, left, dims, node) | kd_brute(rest, leaves - left, dims, node + left)


@pytest.mark.parametrize("leaves", [2, 7, 16])
def test_kd_tree_is_the_brute_one(spark, monkeypatch, leaves):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    monkeypatch.setattr(sharding, "PASS_BINS", 16)
    rng = random.Random(leaves)
    units = {i: (rng.randint(1, 50), tuple(rng.sample(range(10**6), 3))) for i in range(300)}
    df = spark.createDataFrame([(i, 0, w, *k, 0) for i, (w, k) in units.items()], "g long, slice int, weight long, k0 long, k1 long, k2 long, node int")
    assert {r["g"]: r["shard"] for r in sharding.kd_assign(df, leaves, 3).collect()} == kd_brute(units, leaves, 3)


def test_sharding_many_leaves(spark):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 1 + id % 7) AS text", "'x' AS lang", "cast(id % 11 AS string) AS source", "0L AS n_chars")
    sizes = [r["b"] for r in sharding.shard(rows, 2000).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 2000 and max(sizes) < 1.6 * sum(sizes) / 2000


def test_sharding_keeps_copies_and_meets_bytes(spark):
    rows = [[i, f"text {i % 500} " * 5, "x", "s", 0] for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), target_bytes=20_000).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert len({r["shard"] for r in got}) == -(-sum(r["size"] for r in got) // 20_000)


def test_language_id(docs, rows):
    got = langid.predict_languages(crowded(docs)).collect()
    truth = {r[0]: (r[2], r[1]) for r in rows}
    assert len(got) == len(rows)
    scored = [(r["lang_pred"], truth[r["doc_id"]][0]) for r in got if truth[r["doc_id"]][0] and r["lang_pred"] != "und" and len(truth[r["doc_id"]][1]) > 200 and r["doc_id"] != 908]
    assert sum(a == b for a, b in scored) / len(scored) > 0.95
    for r in got:
        text = truth[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2)
    kept = langid.keep_identified(crowded(docs))
    assert kept.columns == crowded(docs).columns and 0 < kept.count() < len(rows)


def test_language_id_counts_pieces_as_the_whole(monkeypatch):
    text = "Ça va très bien, " * 50
    for t in (text, "a", " a", "a ", "ab" * 300, "  ..a..  " * 40, "ΣΑΣ ΟΔΟΣ " * 20):
        whole = langid.ngram_counts(t)
        for size in (1, 2, 3, 37, 64):
            with monkeypatch.context() as m:
                m.setattr(langid, "PIECE", size)
                assert (langid.ngram_counts(t) == whole).all()


def test_language_id_rejects_what_is_no_language(spark):
    """Calibration rows stay, made-up junk goes; nothing of it was trained on."""
    rng = random.Random(21)
    text = lambda lang: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90)))
    rows = [[i, text(lang := rng.choice(list(SYLLABLES))), lang, "s", 0] for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert model.coverage >= 0.99 and model.error <= 0.01 and model.let_in <= 0.05
    fresh = [text(lang) for lang in SYLLABLES for _ in range(100)]
    kept = np.mean([s >= model.level for s in model.predict(fresh)[1]])
    junk = ["".join(rng.choice("qwxzvkjbpf ") for _ in range(300)) for _ in range(100)] + ["#$% 12 @@ x " * 20] * 10 + ["".join(rng.sample(t, len(t))) for t in fresh[:100]]
    let_in = np.mean([s >= model.level for s in model.predict(junk)[1]])
    assert kept >= 0.99 and let_in <= 0.1
    assert langid.negative(fresh[0]) == langid.negative(fresh[0]) != fresh[0] and langid.negative("") == ""


def test_language_id_without_labels(docs, none):
    assert {r["lang_pred"] for r in langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict_languages(none).count() == 0


def test_quality(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        good = rng.random() < 0.7
        body = [rng.choice(["word", "other", "lorem", "ipsum", "dolor"]) + str(rng.randint(0, 99)) for _ in range(60)]
        rows.append([i, " ".join(body) if good else rng.choice([" ".join(body[:2] * 30), " ".join(b.upper() + "!!" for b in body)]), "x", "s", 0])
        labels.append([i, int(good), 0])
    rows += [[1000, None, None, None, None], [1001, "", None, None, None]]
    got = quality.predict_quality(crowded(spark.createDataFrame(rows, DOCS)), spark.createDataFrame([*labels, [0, None, 0], [None, 1, 0], [5, labels[5][1], 0]], "doc_id long, quality int, toxic int")).collect()
    truth = {x[0]: x[1] for x in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 602 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_without_labels(docs, spark):
    got = quality.predict_quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {round(r["score"], 6) for r in got} == {0.5}


def test_compiled_rules_equal_numpy(docs):
    stats = quality.statistics(F.col("text"))
    x = np.array([list(r) for r in docs.select(*[c.alias(n) for n, c in stats.items()]).collect()], float)
    y = (x[:, 2] > np.median(x[:, 2])).astype(float)
    rules = quality.fit(x, y, list(stats))
    z = rules.bias + sum(w * quality.applies({f: (lo, hi) for f, lo, hi in b}, x) for b, w in rules.rules)
    got = [r["score"] for r in quality.scored(docs, rules).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-z)))) and rules.rules


def test_sentencepiece(docs, rows):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    tokens = spm.encode(crowded(docs))
    got = Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in tokens.collect())
    assert got == Counter((r[0], None if r[1] is None else tuple(m.encode(r[1]))) for r in rows)
    assert Counter(tuple(r) for r in spm.decode(tokens).collect()) == Counter((r[0], r[1]) for r in rows)
    assert all(r["round_trip"] for r in spm.encode_digests(docs).where("doc_id <> 900").collect())


def test_sentencepiece_odd_texts():
    import sentencepiece

    m, p, rng = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL), spm.Pieces(spm.MODEL), random.Random(8)
    texts = ["▁x", "  ", " a  b   c", "\n\n a\n", "a\x00b", "<s> <0x0A> </s>", "日本語 テキスト 🙂🙂", "x" * 200, "é́", " \n \n  \n", "▁\n▁", "ａｂｃ", "\r\n\t", "…", "ſtraße"]
    texts += ["".join(rng.choice("ab cde the\ningßé▁🙂  ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, p.encode(texts), strict=True):
        assert ids.tolist() == m.encode(text), text
        assert p.decode(ids) == text.replace("▁", " ")


def test_media(docs, rows):
    got = media.media_columns(crowded(docs)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        data = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want[r[0], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r["payload_sha256"] for r in got}) == len({r["media_sha256"] for r in got})


def test_media_keys(spark):
    """Ids of any form come back; the empty one is not null."""
    keys = ["", None, "a/b", "none", "x\u0000y", "ü%20.png", "id-1"]
    got = media.media_columns(spark.createDataFrame([(k, "t") for k in keys], "doc_id string, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(keys)


def test_media_feature(docs):
    """The stored form read chunk by chunk, and the feature counted sample by sample."""
    for text in (None, "", "abc", "Ça " * 900):
        data, n = media.payload(text)
        stored = media.to_png(data, n)
        at, chunks = 8, []
        while at < len(stored):
            size = int.from_bytes(stored[at : at + 4], "big")
            chunks.append((stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]))
            assert zlib.crc32(stored[at + 4 : at + 8 + size]) == int.from_bytes(stored[at + 8 + size : at + 12 + size], "big")
            at += 12 + size
        assert [c[0] for c in chunks] == [b"IHDR", b"tEXt", b"IDAT", b"IEND"]
        width, height = (int.from_bytes(chunks[0][1][i : i + 4], "big") for i in (0, 4))
        lines = zlib.decompress(chunks[2][1])
        assert width == 64 and all(lines[i * 65] == 0 for i in range(height))
        image = np.frombuffer(b"".join(lines[i * 65 + 1 : i * 65 + 65] for i in range(height)), np.uint8).reshape(height, width)
        assert image.tobytes() == data
        flat = list(data)
        hist = [sum(1 for x in flat if x // 32 == i) for i in range(8)]
        assert media.feature(image) == f"h={len(flat) // 64};min={min(flat)};max={max(flat)};sum={sum(flat)};sq={sum(x * x for x in flat)};hist=" + ",".join(map(str, hist))


def test_media_ranges_and_retries(spark, docs, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/m"
    assert media.write_archives(docs, folder) == len(rows)
    for size in (1000, 1 << 30):
        assert media.read_archives(spark, folder, size).count() == len(rows)
    reader, calls, real = media.ArchiveReader(folder, 1 << 30), Counter(), media.read_member

    def flaky(source, offset, *rest):
        calls[offset] += 1
        if calls[offset] == 1:
            raise OSError("lost")
        return real(source, offset, *rest)

    monkeypatch.setattr(media, "read_member", flaky)
    monkeypatch.setattr(media, "WAIT_S", 0)
    found = sum(b.num_rows for p in reader.partitions()[:1] for b in reader.read(p))
    assert found and set(calls.values()) == {2}
    monkeypatch.setattr(media, "read_member", lambda *a: (_ for _ in ()).throw(ValueError("gone")))
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_lm(docs, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in lm.score(crowded(docs), block_bytes=20_000).collect()}
    texts = [[ascii_lower(w) for w in words(r[1])] for r in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    total = sum(one.values())
    for r, t in zip(rows, texts, strict=True):
        mine1, mine2, out = Counter(t), Counter(zip(t, t[1:], strict=False)), 0.0
        rest = max(1, total - len(t))
        for i, w in enumerate(t):
            c = one[w] - mine1[w]
            alone = math.log((c if c else lm.ALPHA) / rest)
            pair = two[t[i - 1], w] - mine2[t[i - 1], w] if i else 0
            out += math.log(pair / (one[t[i - 1]] - mine1[t[i - 1]])) if pair else alone + (math.log(lm.ALPHA) if i else 0)
        found = got[r[0], len(t)]
        assert found["log_score"] is None if not t else abs(found["log_score"] - out) < 1e-6 * max(1, len(t))
        assert found["mean_log_score"] is None if not t else abs(found["mean_log_score"] - out / len(t)) < 1e-6


def test_lm_counts_pass_32_bits():
    import pyarrow as pa

    h = np.array([5, 9], np.uint64)
    parts = pa.table({"g": [1, 2], "part": [1 << 32] * 2, "hashes": [lm.pack(h)] * 2, "counts": [lm.narrow(np.array([3_000_000_000, 1]))] * 2})
    back = lm._count(parts)
    assert [lm.widened(x).tolist() for x in back.column("totals").to_pylist()] == [[6_000_000_000, 2]] * 2
    doc = np.array([0, 0, 1])
    assert lm._looked_up(np.array([5, 5, 9], np.uint64), 1, [(1 << 32, lm.narrow(np.array([6_000_000_000, 2])))], doc).tolist() == [5_999_999_998, 5_999_999_998, 1]


def test_packed_hashes():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2**64 - 1), (2, 5), (3, 2**64 - 1), (5000, 2**64 - 1), (5000, 2**50)):
        h = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (lm.unpack(lm.pack(h)) == h).all()


def test_word_hashes(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows if r[0] not in (906, 908)]
    for block in (50, 1 << 20):
        hashes, at = word_hashes(pa.array(texts, pa.string())[0:], block)
        seen, flat = {}, [ascii_lower(w) for t in texts for w in words(t)]
        assert np.diff(at).tolist() == [len(words(t)) for t in texts]
        for w, h in zip(flat, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "PROBES", 30)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 8)) * np.exp(rng.normal(size=(600, 1)))
    vectors[100:150] = vectors[100]
    vectors[300:420] = vectors[300] + rng.normal(size=(120, 8)) * 0.02
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [0.0] * 8), (1250, [3.0, 4.0]), (1251, [1.0, 1.0]), (1300, []), (550, rows[550][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)), F.col("id") % 50 == 0).collect()
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, x in whole.items():
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(y) == len(x))[:5]
            want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_large_components(spark):
    """No finite vector is left out, whatever its size; products beyond 53 and 63 bits are exact."""
    kind = "vec_id long, embedding array<double>"

    def products(rows):
        q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
        for i in q:
            if i % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i)[:5]
                yield from ((i, r + 1, j, -s) for r, (s, j) in enumerate(best))

    for rows in (
        [(50, [9e6, 1.0]), (2, [9e6, 0.0]), (1, [1.0, 1.0]), (100, [1.0, 0.0]), (3, [-9e6, 9e6]), (4, [1.1e7, 1.0]), (150, [2.0, -5e6]), (200, [0.0, 0.0])],
        [(50, [9e6, 1.0]), (2, [9e6, 0.0]), (1, [1.0, 1.0]), (100, [1.0, 0.0])],
        [(100, [1.0, 0.0]), (200, [0.0, 0.0]), (6, [1.2e14, 9e17]), (7, [1.2e14 + 1, -9e17]), (8, [-1.3e14, 1e30])],
    ):
        got = topk.top_k(spark.createDataFrame(rows, kind), F.col("id") % 50 == 0).collect()
        assert Counter(map(tuple, got)) == Counter(products(rows))
    top, low = 2**63 - 1, -(2**63)
    nearest = lambda rows: [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, kind), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert nearest([(50, [1e20]), (1, [1e20]), (2, [1.0]), (3, [-1e20])]) == [(50, 1, 1, top), (50, 2, 2, top), (50, 3, 3, low)]
    huge = [(50, [1e300, 0.0]), (9, [1e308, 1.0]), (4, [1e300, -1e308]), (7, [0.0, 5.0]), (8, [-1e300, 1.0]), (100, [0.0, 1.0])]
    assert nearest(huge) == [(50, 1, 4, top), (50, 2, 9, top), (50, 3, 7, 0), (50, 4, 100, 0), (50, 5, 8, low), (100, 1, 7, 256 * 256 * 5), (100, 2, 8, 256 * 256), (100, 3, 9, 256 * 256), (100, 4, 50, 0), (100, 5, 4, low)]


def shingle_set(text, k=3):
    w = words(ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, num=90, k=3):
    sets = [shingle_set(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = r[0] if least[root(i)] is None else min(least[root(i)], r[0])
    return Counter((r[0], len(sets[i]), least[root(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard(docs, rows):
    assert Counter(tuple(r) for r in jaccard.link_components(crowded(docs)).collect()) == brute_components(rows)


def test_jaccard_chains(spark):
    """Copies that drift word by word: far ends link only through what lies between."""
    rng, rows = random.Random(4), []
    for g in range(3):
        text = [f"g{g}w{rng.randint(0, 400)}" for _ in range(90)]
        for i in range(40):
            rows.append([1000 * g + (i * 7) % 40, " ".join(text), "x", "s", 0])
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(90)] = f"n{rng.randint(0, 10**6)}"
    got = jaccard.link_components(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def outsider_groups(n_words=60, copies=300, seed=11):
    """Copies of one text with one word changed in each, so that few link with each other, and strangers that hold parts of it."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(n_words)]
    rows = []
    for i in range(copies):
        text = list(base)
        text[rng.randrange(n_words)] = f"c{i}"
        rows.append([10 + i, " ".join(text), "x", "s", 0])
    for i in range(40):
        at = rng.randrange(n_words - 20)
        rows.append([1000 + i, " ".join(base[at : at + 20] + [f"s{i}w{j}" for j in range(20)]), "x", "s", 0])
    return rows


@pytest.mark.parametrize("n_words, num", [(60, 90), (60, 80), (200, 90)])
def test_jaccard_pairs_stay_few(spark, monkeypatch, n_words, num):
    """No round makes more pairs than a few for each node, even where the hub is no near copy of the group."""
    made, real = [], jaccard.stage

    def counted(df, name):
        out = real(df, name)
        if name in ("pairs", "links", "proven", "edges"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    rows = outsider_groups(n_words)
    got = jaccard.link_components(spark.createDataFrame(rows, DOCS), num=num).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, num)
    assert max(n for _, n in made) <= 2 * len(rows), made


def test_jaccard_in_small_blocks(spark, docs, rows, monkeypatch):
    """Blocks of a few nodes: pairs between blocks count as those inside."""
    monkeypatch.setattr(jaccard, "HUB_BLOCK", 7)
    monkeypatch.setattr(jaccard, "HUB_SHINGLES", 2000)
    monkeypatch.setattr(jaccard, "STRIPE", 3)
    some = rows[:160] + outsider_groups(copies=60)
    got = jaccard.link_components(spark.createDataFrame(some, DOCS)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(some)


def test_jaccard_many_ids(docs, rows, monkeypatch):
    """Ids beyond the bitmap are joined."""
    monkeypatch.setattr(jaccard, "MOST_BITS", 1)
    assert Counter(tuple(r) for r in jaccard.link_components(docs).collect()) == brute_components(rows)


def test_sketches_never_overstate():
    rng = np.random.default_rng(3)
    sets = []
    for n in (10, 2900, 3200, 26_000, 30_000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(n * 0.95)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))]
    found = jaccard.Sketches([jaccard._sketch(s) for s in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = found.differ(*np.array(pairs).T)
    for (i, j), d in zip(pairs, got, strict=True):
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert d <= apart and (i != j or d == 0)
        assert apart < 100 or d > 0.05 * min(apart, 8 * min(found.size[i], found.size[j]))


def test_jaccard_long(spark):
    rng, rows = random.Random(9), []
    for g in range(3):
        text = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(9000 + 40 * g)]
        for i in range(4):
            rows.append([10 * g + i, " ".join(text), "x", "s", 0])
            for _ in range(120 if i % 2 else 400):
                text[rng.randrange(len(text))] = f"n{rng.randint(0, 10**9)}"
    assert Counter(tuple(r) for r in jaccard.link_components(spark.createDataFrame(rows, DOCS)).collect()) == brute_components(rows)


def test_mixing(docs, rows):
    got = mixing.mix(crowded(docs)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in got)
    by_target = defaultdict(list)
    for r in got:
        by_target[r["target"], r["source_size"]].append(r)
    for (target, _), group in by_target.items():
        assert abs(sum(r["taken"] for r in group) - target) <= max(r["size"] for r in group)
    total = sum(r["size"] for r in got)
    assert abs(sum(t for t, _ in by_target) - total) < 1e-6 * total
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("text, name", [
    (licenses.KNOWN[0][1].replace("MIT License\n", "MIT License\n\nCopyright (c) 2020 Someone\n© Another"), "MIT"),
    ("  released under the mit LICENCE  ", "MIT"),
    (licenses.KNOWN[5][1].replace(",", " ,").upper(), "BSD-3-Clause"),
    ("Some text.", None), ("", None), (None, None), (licenses.KNOWN[0][1] + " More.", None),
])
def test_licenses(spark, text, name):
    got = licenses.scan_licenses(crowded(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert [r["license_id"] for r in got] == [name]


def test_licenses_wrapped(spark):
    """A wrap puts any word first on a line: that of a clause stays, whatever the width."""
    wrapped = [(name, textwrap.fill(part, width, break_long_words=False), width) for name, part in licenses.KNOWN for width in (12, 20, *range(30, 121))]
    rows = [(i, "Copyright (c) 2020 Someone\n\n" + text if i % 2 else text.upper()) for i, (_, text, _) in enumerate(wrapped)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [w for i, w in enumerate(wrapped) if got[i] != w[0]] == []


@pytest.mark.parametrize("line, notice", [
    ("Copyright (c) 2020 Someone", True), ("copyright 1999-2003, A. B.", True), ("Copyright © Someone", True), (" * Copyright by Someone", True), ("Copyright: The Foo Authors", True), ("(C) 2001 Someone", True),
    ("© Another", True), ("All rights reserved.", True), ("Copyright [yyyy] [name of copyright owner]", True), ("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,", False), ("copyright notice, this list", False),
    ("copyright owner.", False), ("copyrighted works", False), ("copyright, and", False), ("(c) You must retain", False),
])
def test_license_notices(spark, line, notice):
    row = spark.createDataFrame([(f"One\n{line}\ntwo",)], "text string").select(licenses.canonical(F.col("text"))).first()
    assert (row[0] == "one two") == notice


@pytest.mark.skipif(not os.path.isdir(LICENSES), reason="no licence texts here")
def test_license_texts(spark):
    """Whole texts as they lie on this machine, and in capitals or with words added."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {spdx: open(f"{LICENSES}/{file}", encoding="utf-8").read() for file, spdx in names.items() if os.path.exists(f"{LICENSES}/{file}")}
    rows = [(spdx, text) for spdx, text in texts.items()] + [(spdx, text.upper()) for spdx, text in texts.items()] + [(None, text + "More") for text in texts.values()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["doc_id"] for r in got)


@pytest.mark.parametrize("lines", [["Copyright (c) 2020 Someone", "copyright holders be liable", "COPYRIGHT\tby A", "copyright: x", "(c) you must", "(C) 2001", "(c)", "copyright"], ["All rights reserved.", "all rights reserveds", "# © B", "/* copyright 1999", "copyright the software", "copyright the Foo", "copyright\x0bx", "copyright -x", ""]])
def test_license_twin(spark, lines):
    """The twin's rule for notices is the operator's."""
    con, texts = duckdb.connect(), [*lines, *[f"one\n{x}\ntwo" for x in lines]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "text string").select(licenses.canonical(F.col("text"))).collect()]
    assert got == [con.execute(f"SELECT {licenses._sql_canonical('x')} FROM (SELECT ?::VARCHAR AS x)", [x]).fetchone()[0] for x in texts]


def test_license_lines(spark):
    got = licenses.scan_licenses(spark.createDataFrame([(1, "Text.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT licence"), (1, "x")], "doc_id long, text string")).collect()
    assert sorted(r["notices"] for r in got) == ["", "CC-BY-NC-4.0,MIT"]


@pytest.mark.parametrize("run", [
    sharding.shard_documents, langid.predict_languages, spm.encode, lambda d: spm.decode(spm.encode(d)), lambda d: quality.predict_quality(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic")), lambda d: quality.keep_good(d, d.selectExpr("doc_id", "1 AS quality")), spm.encode_digests, media.media_columns, lm.score, jaccard.link_components, mixing.mix, licenses.scan_licenses, langid.keep_identified,
])
def test_empty_table(none, run):
    assert run(none).collect() == []


def test_empty_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], T.StructType.fromDDL("vec_id long, embedding array<float>")), F.col("id") % 50 == 0).collect() == []


def test_sample_of_one_id(spark):
    """An id that thousands of rows share gives one row of the sample."""
    rng = random.Random(8)
    hot = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [[hot if i % 2 else 10_000 + i, " ".join(rng.choice(SYLLABLES["aa" if i % 3 else "cc"]) for _ in range(6)), "aa" if i % 3 else "cc", "s", 0] for i in range(6000)]
    seen = []
    was = langid.fit
    langid.fit = lambda counts, labels: seen.append(len(labels)) or was(counts, labels)
    try:
        model = langid.train(spark.createDataFrame(rows, DOCS))
    finally:
        langid.fit = was
    assert seen[0] <= 2.2 * 2 * langid.SAMPLE_EACH and set(model.langs) == {"aa", "cc"}


def test_most_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [[i, "ab cd ef", f"l{i % 5 if i < 20 else i % 2}", "s", 0] for i in range(60)]
    assert langid.train(spark.createDataFrame(rows, DOCS)).langs == ["l0", "l1"]


def test_sharding_of_many_nulls(spark):
    """A third of all rows are null: their text stays one group, and every row gets its shard."""
    rows = [[i, None if i % 3 == 0 else f"text {i} " + "w " * (i % 50), "en", "s", 0] for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 6)
    assert got.count() == 6000 and got.where("size = 8").select("shard").distinct().count() == 1
    assert got.groupBy("shard").agg((F.max("slot") + 1 - F.count(F.lit(1))).alias("gap")).where("gap <> 0").isEmpty()
