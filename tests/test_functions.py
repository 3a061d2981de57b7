"""Column expressions against plain Python, on the cases that differ between engines."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge import plans
from tallyforge.functions import payloads as P
from tallyforge.functions import scores as S
from tallyforge.functions import text as X
from tallyforge.operators import access, dedup, tables


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 1.005, 1.115, 0.285, 2.5, -0.125, -2.675, 0.0, 100.0] + [rng.choice([1, -1]) * rng.randint(0, 10**6) / 1000 for _ in range(500)] + [rng.randint(0, 400) / 8 for _ in range(100)]
    assert column(spark, values, "double", S.round2) == [round(v, 2) for v in values]


def test_scores(spark):
    assert column(spark, ["x", None, "-1", "0.25"], "string", S.negative_of) == [0.0, 0.0, 0.0, 0.25]
    assert column(spark, [None, 0.0, 0.25, 1 / 3, 0.334, 0.5, 0.2, 1.0, 0.4, 0.125], "double", S.negative_label) == ["", "", "1/4", "1/3", "1/3", "1/2", "1/5", "1", "0.4", "0.12"]
    assert column(spark, [2.0, 1.666, -0.5, None], "double", S.format_score) == ["2", "1.67", "-0.50", "0"]
    assert column(spark, [0.0, 59.5, 60.0, 61.0, 3600.0, 0.5, 1.5, None], "double", S.format_duration) == ["0s", "1m 0s", "1m 0s", "1m 1s", "1h 0m 0s", "0s", "2s", "0s"]
    assert column(spark, [0, 45, 60, 61, 90, 3600], "int", S.timer_label) == ["No timer", "45 sec", "1 min", "1 min 1 sec", "90 sec", "60 min"]


def test_names(spark):
    rows = spark.createDataFrame([("u", "F", 1), (None, "F", 2), ("", "", 3), ("u", None, 4)], "u string, f string, i int")
    pick = lambda f: [r[0] for r in rows.select(f(F.col("u"), F.col("f"), F.col("i"))).collect()]
    assert pick(S.stats_name) == ["@u", "F", "User 3", "@u"]
    assert pick(S.group_name) == ["F", "F", "User 3", "@u"]
    assert pick(S.user_label) == ["F (@u) · ID 1", "F · ID 2", "User 3 · ID 3", "@u · ID 4"]


def test_timers(spark):
    told = ["45", "45 sec", "2 min", "2m 30s", "1:30", "90 सेकंड", "3 मिनट", "0", "No  Timer", "4", "3601", "soon", None, "कोई नहीं"]
    assert column(spark, told, "string", X.parse_timer) == [45, 45, 120, 150, 90, 90, 180, 0, 0, None, None, None, None, 0]


def test_utf16_and_chunks(spark):
    texts = ["", "abc", "a𝑥", "🙂🙂", "é"]
    assert column(spark, texts, "string", X.utf16_length) == [P.units(t) for t in texts] == [0, 3, 3, 4, 1]
    rng = random.Random(2)
    for _ in range(300):
        text, limit = "".join(rng.choice("ab 🙂\n") for _ in range(rng.randint(0, 200))), rng.randint(2, 40)
        pieces = P.chunks(text, limit)
        assert "".join(pieces) == text and all(P.units(p) <= limit for p in pieces)
    with pytest.raises(ValueError):
        P.chunks("a", 0)


def test_payloads_never_pass_limits():
    rng = random.Random(3)
    for n in range(2, 13):
        for _ in range(30):
            options = [rng.choice("abc🙂\n") * rng.choice([1, 5, 99, 100, 101]) + str(i) for i in range(n)]
            if rng.random() < 0.2:
                options[0] = options[-1]
            perm = rng.sample(range(n), n)
            p = P.payload("q" * rng.choice([1, 280, 300, 301, 5000]), options, rng.randrange(n), perm, 3, 9, rng.choice([None, 4, 77]), "e" * rng.choice([0, 200, 201]), rng.choice(["", "Tag"]))
            assert 1 <= P.units(p.question) <= 300 and all(1 <= P.units(o) <= 100 and "\n" not in o for o in p.options) and len(p.options) == n
            assert p.explanation is None or P.units(p.explanation) <= 200
            assert perm[p.correct] in range(n) and (not p.compact or p.chunks)
    with pytest.raises(ValueError):
        P.payload("q", ["a"], 0, [0], 0, 1)


def test_presentation():
    p = P.presented(P.payload("Why?", ["a", "b"], 1, [1, 0], 3, 9), "Why?", ["a", "b"], 3, 9, {"numbering": "roman", "heading": "{number} of {total}", "option_labels": ["i.", "ii."]})
    assert p.question == "IV of 9\nWhy?" and p.options == ["i. b", "ii. a"] and p.correct == 0
    assert [P.numeral(n, "roman") for n in (1, 4, 9, 40, 1994, 3999, 4000)] == ["I", "IV", "IX", "XL", "MCMXCIV", "MMMCMXCIX", "4000"]
    assert P.settings_errors("presentation", {"heading": "{evil}"}) == ["heading"] and P.settings_errors("presentation", {"x": 1}) == ["unknown field"]
    assert P.settings_errors("import", {"option_labels": ["A", "A)"]}) == ["overlap"] and P.settings_errors("import", {}) == [] and P.settings_errors("import", {"correct_markers": [], "answer_prefixes": []})


def test_permutations(spark):
    rng = random.Random(4)
    rows = [(rng.sample(range(n), n), rng.randrange(n)) for n in range(2, 13) for _ in range(5)]
    df = spark.createDataFrame(rows, "p array<int>, c int")
    assert all(r[0] == r[1] for r in df.select(X.original_choice(F.col("p"), X.display_correct(F.col("p"), F.col("c"))), "c").collect())
    assert column(spark, [[1, 2, 3]], "array<int>", lambda c: X.seeded_order(c, F.lit(1), F.lit(False))) == [[1, 2, 3]]


def test_tokens(spark):
    tokens = ["A", "l", "क", "ञ", "अ", "Ⓑ", "ⓒ", "③", "12", "13", "M", "", None]
    assert column(spark, tokens, "string", X.token_index) == [0, 11, 0, 9, 0, 1, 2, 2, 11, None, None, None, None]
    from tallyforge.sources.marks import token_index

    assert [token_index(t) for t in tokens] == [0, 11, 0, 9, 0, 1, 2, 2, 11, None, None, None, None]


def test_question_types(spark):
    from tallyforge.sources.marks import type_of

    questions = ["Which is NOT here?", "Match the following", "Assertion (A): x", "Arrange them", "कथन पढ़ें", "सूची-I देखें", "What is it?"]
    assert column(spark, questions, "string", X.question_type) == [type_of(q) for q in questions] == ["negative", "matching", "assertion_reason", "ordering", "statement", "list_matching", "mcq"]
    assert type_of("x", ["सत्य", "असत्य।"]) == "true_false"


def test_devanagari(spark):
    assert column(spark, ["िकताब", "हिंदी", "किताब"], "string", X.repair_vowel_signs) == ["किताब", "हिंदी", "किताब"]
    assert column(spark, ["रािस्थाि में निकल्प, सही (विकल्प)"], "string", X.invalid_words) == [["रािस्थाि", "निकल्प"]]
    assert column(spark, ["", "abc", "\ue001" * 5 + "abc"], "string", X.text_quality) == ["empty", None, "glyphs"]


def test_invisible_marks(spark):
    assert column(spark, ["\ufeff a\u200b\u00a0b\r\nc\t\rd "], "string", X.clean_lines) == ["a b\nc\nd"]


def test_clean_text(spark):
    assert column(spark, ["[3/10] What  is\n\n it? @someone https://x.y", "https://x.y", "", None], "string", lambda c: X.clean_text(c, links=True, handles=True, removed=["IS"])) == ["What\nit?", "https://x.y", "", ""]
    assert column(spark, ["Tag: body", "body"], "string", lambda c: X.with_tag(c, "Tag")) == ["Tag\n\nbody", "Tag\n\nbody"]


def test_access_rules(spark):
    assert column(spark, [" Batch", "x", None], "string", access.normalize_tier) == ["batch", "free", "free"]
    assert column(spark, ["[1, \"-2\", \"x\", 3.5]", "oops", None], "string", access.number_list) == [[1, -2], [], []]
    rows = spark.createDataFrame([(100.0, 90.0, None), (0.0, 0.0, None), (5.0, 0.0, False), (5.0, 0.0, None)], "v double, c double, a boolean")
    assert [r[0] for r in rows.select(access.has_access(F.col("v"), F.col("c"), F.lit(400.0), F.col("a"), 320.0)).collect()] == [True, False, False, True]


def test_signatures(spark):
    rows = spark.createDataFrame([("  What  IS it ", ["A ", "b"], 1), ("what is it", ["a", " B"], 1), ("what is it", ["a", "b"], 0)], "q string, o array<string>, i int")
    sig = [r[0] for r in rows.select(dedup.signature(F.col("q"), F.col("o"), F.col("i"))).collect()]
    assert sig[0] == sig[1] != sig[2]


def test_topics(spark):
    rel = lambda a, b, ca="", cb="": _relation(spark, a, b, ca, cb)
    assert rel("Topic 02 History", "Topic 02 History") == "same" and rel("Topic 02 History", "Topic 03 History") == "different"
    assert rel("Ancient India", "Ancient India full") == "same" and rel("Physics", "Chemistry") == "different" and rel("quiz", "test") == "ambiguous"
    assert rel("a", "b", "Same caption", "same CAPTION") == "same"


def _relation(spark, a, b, ca, cb):
    def side(name, caption):
        key = dedup.topic_key(F.lit(name))
        return {"caption": F.lit(caption), "number": dedup.topic_number(F.lit(name)), "key": key, "words": dedup.topic_words(key)}

    return spark.range(1).select(dedup.topic_relation(side(a, ca), side(b, cb))).first()[0]


def test_question_rules(spark):
    rows = spark.createDataFrame([("q", ["a", "b"], 1), ("", ["a", "b"], 1), ("q", ["a"], 0), ("q", ["a", " "], 0), ("q", ["a", "b"], 2), ("q", None, 0), (None, ["a", "b"], 0)], "q string, o array<string>, i int")
    assert [r[0] for r in rows.select(tables.fits(F.col("q"), F.col("o"), F.col("i"))).collect()] == [True] + [False] * 6
    rows = spark.createDataFrame([("Algebra", "x"), ("2", "Part B"), ("0", None), (None, None), (" ", "L")], "v string, l string")
    assert [r[0] for r in rows.select(tables.section_name(F.col("v"), F.col("l"))).collect()] == ["Algebra", "Part B", "0", "", "L"]


def cleaned(text):
    out = re.sub(r"^\s*(?:\[\s*\d+\s*/\s*\d+\s*\])\s*", "", text)
    out = re.sub(r"(?<!\w)@[A-Za-z0-9_]{3,32}\b", "", re.sub(r"(?i)(?:https?://|t\.me/)\S+", "", out))
    return "\n".join(x for x in (re.sub(r"[ \t]{2,}", " ", line).strip() for line in out.splitlines()) if x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_whole_pages_are_cleaned(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: f"[{r['page_id']}/9] {r['url']}\n\n  by   @user{r['page_id']} {r['html']}" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in plans.queries()["smart_cleaned"](spark, sf).collect()}
    assert got == {k: cleaned(v) for k, v in pages.items()} and max(map(len, got.values())) > 200


def test_late_links_and_handles_go(spark):
    texts = ["word " * 5000 + "see https://a.b/c?d and @some_one  now\nt.me/x y", "é@abc @abc\u0301 x@abc" + " " * 300 + "@abc.", "https://a.b\u00a0c\u2003@abcd"]
    assert column(spark, texts, "string", lambda c: X.clean_text(c, links=True, handles=True)) == [cleaned(t) for t in texts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_all_rows_have_timers(spark):
    sf = "/root/testdata/sf0.001"
    assert plans.queries()["timers"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
