"""The pipeline's stages against brute-force versions of their decisions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tallyforge.llm import langid, mixing, quality, spm

from .test_operators import DOCS, brute_components, make_docs, words


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(make_docs(), DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = p.language(spark, docs, sf)
    model = langid.train(docs)
    accepted = Counter()
    for r in docs.collect():
        name, score = (x[0] for x in model.predict([r["text"]]))
        accepted[r["doc_id"]] += name != "und" and score >= model.level
    assert kept.columns == columns and Counter(r["doc_id"] for r in kept.collect()) == +accepted
    good = p.good(spark, docs, sf)
    ids = {r["doc_id"] for r in quality.predict_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == ids
    one = p.one_of_each(spark, docs, sf)
    want = {k[0] for k in brute_components([list(r) for r in docs.collect()], 80, 5) if k[0] is not None and k[2] == k[0]}
    got = [r["doc_id"] for r in one.where("doc_id IS NOT NULL").collect()]
    assert one.columns == columns and sorted(got) == sorted(want)
    mix = p.mixed(spark, docs, sf)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    seen = Counter(r["doc_id"] for r in mix.collect())
    sizes = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    repeats = Counter(r["doc_id"] for r in docs.collect())
    assert mix.columns == columns and {k: n * sizes[k] // repeats[k] for k, n in seen.items()} == taken


def test_run(spark, sf):
    out = p.run(spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids"] and rows
    m = spm.pieces()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import numpy as np

    assert all(m.decode(np.array(r["ids"], np.int32)) == texts[r["doc_id"]].replace("▁", " ") for r in rows)


def near_copies(rows):
    """The ids that stay where texts are near copies from 0.8 on, of 5-word shingles; least id of each group."""
    sets = []
    for _, text in rows:
        w = words(text.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    groups = [{i} for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for x in groups[j]:
                    groups[x] = groups[i]
    return sorted({min(rows[i][0] for i in g) for g in groups})


def test_near_copies_from_five_words(spark):
    """Copies with 1 to 9 of 120 words changed: their similarity falls from 0.92 to about 0.5, and at 3 words and 0.9 most would stay."""
    rng, rows = random.Random(5), []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(120)]
        rows.append((100 * g, " ".join(base)))
        for i in range(1, 10):
            text = list(base)
            for at in rng.sample(range(120), i):
                text[at] = f"n{rng.randint(0, 10**6)}"
            rows.append((100 * g + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in p.one_of_each(spark, docs, "").collect())
    assert got == near_copies(rows) and len(got) < len(rows)


def clashing(docs):
    """Extra columns named like those that a stage may use inside, in both cases of letters."""
    for name in ("_tf_id", "_tf_n", "_tf_i", "_tf_hash", "_tf_many", "_TF_TIMES", "_tf_turn", "_tf_size", "_tf_text", "label", "n", "node", "size", "score", "taken", "c", "d"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.mark.parametrize("name, step", p.STAGES)
def test_stage_with_clashing_names(spark, sf, name, step):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = clashing(docs)
    plain, got = step(spark, docs, sf), step(spark, more, sf)
    if name != "SentencePiece encoding":
        assert got.columns == more.columns
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == Counter(r["doc_id"] for r in plain.select("doc_id").collect())


@pytest.mark.parametrize("name, step", p.STAGES)
def test_stage_without_rows(spark, sf, name, step):
    none = spark.createDataFrame([], DOCS)
    assert step(spark, none, sf).collect() == []


def test_run_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_one_of_each_with_equal_ids(spark):
    """Rows of one id and different texts are told apart; repeated rows are one; what has no word stays."""
    far, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, far), (1, near), (1, near), (2, near + " end"), (3, None), (3, " "), (3, " "), (None, far + " end"), (None, "only here now and then"), (None, "only here now and then")]
    got = p.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, far), (1, near), (3, None), (3, " "), (3, " "), (None, "only here now and then")])


def test_mixed_rows_of_one_id(spark):
    """Rows of one id and equal word counts get their own counts: source s1 is far above its target, s2 and s3 below."""
    rows = [(1, "two words", "s1"), (1, "two others", "s2"), (1, "two more", "s3"), (2, "w " * 2000, "s1"), (2, "w " * 2000, "s1"), (3, "one two", "s2"), (4, "one two", "s3"), (1, "two words", None), (5, None, "s2"), (6, " ", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = Counter(tuple(r) for r in p.mixed(spark, docs, "").collect())
    want = Counter()
    for r in mixing.mix(docs, also=(F.col("source"), F.col("text"))).where("size > 0").collect():
        want[r["doc_id"], r["_also1"], r["_also0"]] += r["taken"] / r["size"]
    counts = Counter(rows)
    assert seen == Counter({k: counts[k] * round(n / counts[k] + 1e-9) for k, n in want.items() if round(n / counts[k] + 1e-9)})
    assert seen[1, "two words", "s1"] <= 1 and seen[1, "two others", "s2"] == 3


def test_mixed_with_a_map(spark):
    docs = spark.createDataFrame([(1, "a b", "s", {"k": 1})], "doc_id long, text string, source string, more map<string, int>")
    assert p.mixed(spark, docs, "").first()["more"] == {"k": 1}
