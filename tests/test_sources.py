"""Parsers on hand-written papers, cards, pages and items."""

import json
import random
import re
import sqlite3
from collections import Counter

import pytest

from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tallyforge.operators import lexicon
from tallyforge.sources import boxes, charsets, files, items, layout, marks, pages, papers
from tallyforge.sources import dialects
from tallyforge.sources import sqlite as lite


def read(text):
    p = papers.parse(text)
    return [(q.number, q.question, q.options, q.correct_index) for q in p.questions], [(e.number, e.message) for e in p.errors]


ONE = ([(1, "Two and two?", ["three", "four", "five"], 1)], [])


@pytest.mark.parametrize("options", ["(A) three\n(B) four\n(C) five", "A) three\nB) four\nC) five", "a. three\nb. four\nc. five", "(1) three\n(2) four\n(3) five", "① three\n② four\n③ five", "(क) three\n(ख) four\n(ग) five", "(अ) three\n(ब) four\n(स) five", "(A) three (B) four (C) five"])
@pytest.mark.parametrize("answer", ["Answer: B", "उत्तर: (ख)", "Ans - 2", "सही उत्तर: ब", "Correct Answer: (B) four", "Answer: four"])
def test_option_and_answer_styles(options, answer):
    assert read(f"1. Two and two?\n{options}\n{answer}") == ONE


@pytest.mark.parametrize("start", ["1.", "1)", "(1)", "Q1.", "Q.1", "Question 1:", "प्रश्न 1.", "[प्रश्न 1]"])
def test_question_starts(start):
    assert read(f"{start} Two and two?\n(A) three\n(B) four\n(C) five\nAnswer: B") == ONE


@pytest.mark.parametrize("key", ["Answer Key\n1-A, 2-B", "Answer Key\n1-A\n2-B", "उत्तर कुंजी\n1. A\n2. B", "1. उत्तर: A\n2. उत्तर: B", "Answers\n1\nA\n2\nB", "1-A 2-B"])
def test_keys(key):
    got, errors = read(f"1. One?\n(A) a\n(B) b\n2. Two?\n(A) c\n(B) d\n{key}")
    assert [(n, i) for n, _, _, i in got] == [(1, 0), (2, 1)] and not errors


@pytest.mark.parametrize("text, message", [
    ("1. One?\n(A) a\n(B) b\nAnswer: A\nAnswer: B", "different answers"), ("1. One?\n(A) a\n(B) b\nAnswer: A and B", "more than one"), ("1. One?\n(A) a\n(B) b", "no answer"),
    ("1. One?\n(A) a\n(B) b\nAnswer: C", "beyond"), ("1. One?\n(A) a\n(B) b\nAnswer: A\nAnswer Key\n1-B", "differ"), ("1. One?\n(A) a\n(B) b\nAnswer: A b", "another option"),
])
def test_answers_are_never_guessed(text, message):
    got, errors = read(text)
    assert not got and any(message in m for _, m in errors)


def test_gaps_duplicates_and_sections():
    body = "\n(A) a\n(B) b\nAnswer: A\n"
    assert (3, "the number is missing") in read(f"1. x{body}2. y{body}4. z{body}")[1]
    p = papers.parse(f"Section A\n1. x{body}2. y{body}Section B\n1. z{body}2. w{body}")
    assert [(q.section_label, q.number) for q in p.questions] == [("Section A", 1), ("Section A", 2), ("Section B", 1), ("Section B", 2)] and not p.errors


def test_statements_stay_in_the_stem():
    got, errors = read("7. Consider:\n1. first\n2. second\n3. third\n(A) only 1\n(B) 1 and 2\nAnswer: B\n8. Next?\n(A) a\n(B) b\nAnswer: A\nExplanation:\n1. because\n2. so\n9. Last?\n(A) a\n(B) b\nAnswer: B")
    assert [n for n, *_ in got] == [7, 8, 9] and not errors and "3. third" in got[0][1]


def test_passage_and_noise():
    body = "\n(A) a\n(B) b\nAnswer: A\n"
    p = papers.parse(f"1. x{body}Directions (Q. 2-3): read the passage\nSome text.\n2. y{body}3. z{body}Page 4 of 9\nJoin our telegram channel @things\n4. w{body}")
    assert [bool(q.pre_text) for q in p.questions] == [False, True, True, False] and not p.errors
    assert {k for k, _ in p.removed} == {"page-number", "promotion"}


def test_large_generated_paper():
    rng = random.Random(7)
    for placing in ("inline", "key", "both", "sections"):
        lines, want, keys = [], [], []
        for s in range(3):
            lines.append(f"Section {'ABC'[s]}")
            for n in range(1, 101):
                k = rng.randrange(4)
                want.append((s, n, k))
                lines += [f"{n}. Question {s} {n}?", "(A) a", "(B) b", "(C) c", "(D) d"]
                if placing in ("inline", "both"):
                    lines.append(f"Answer: {'ABCD'[k]}")
                keys.append(f"{n}-{'ABCD'[k]}")
            if placing == "sections":
                lines += ["Answer Key", ", ".join(keys)]
                keys = []
        if placing == "key":
            lines += [x for s in range(3) for x in ["Answer Key", ", ".join(keys[100 * s : 100 * s + 100])]]
        p = papers.parse("\n".join(lines))
        assert [(q.section, q.number, q.correct_index) for q in p.questions] == want and not p.errors, placing


def test_conservation_and_empty():
    assert [e.message for e in papers.parse("  ").errors] == ["empty text"] and papers.parse(None).errors
    for seed in range(40):
        rng = random.Random(seed)
        words = ["1.", "2.", "(A)", "(B)", "Answer: A", "text", "Answer Key", "1-A", "Section B", "\n", "\n", "Explanation:", "Q3"]
        p = papers.parse(" ".join(rng.choice(words) for _ in range(80)))
        assert not any("neither" in e.message or "missing" in e.message and "text" in e.message for e in p.errors)


def test_options_of_text():
    assert marks.options_at_end("Why?\nA-III, B-II\n(A) one\n(B) two") == ("Why?\nA-III, B-II", ["one", "two"])
    assert marks.options_only("(A) one (B) two (C) three") == ["one", "two", "three"] and marks.options_only("one") is None
    assert dialects.typed_options("A) one\nB) two") == ["one", "two"] and dialects.typed_options("A-III\nB-I") == ["A-III", "B-I"]
    with pytest.raises(marks.Unreadable):
        dialects.typed_options("one")


def test_dialects():
    cards = "Why so?\nA) one\nB) two ✅\nC) three\nD) four\nEx: because\n\nAnd then?\nA) x\nB) y\nC) z ✅\nD) w\nEx:"
    assert [(q.question, q.correct_index, q.explanation) for q in dialects.parse(cards).questions] == [("Why so?", 1, "because"), ("And then?", 2, "")]
    ticked = "1. Why?\nA) one\nB) ✅ two\nC) three\nD) four\n2. How?\n✅ A) x\nB) y\nC) z\nD) w"
    assert [(q.number, q.correct_index, q.options[0]) for q in dialects.parse(ticked).questions] == [(1, 1, "one"), (2, 0, "x")]
    topics = "1. First\n-----\nQ1. a?\n(1) x\n(2) y\nAnswer: (2)\n2. Second\n-----\nQ1. b?\n(a) x\n(b) y\nउत्तर: (a)"
    assert [(q.section_label, q.number, q.correct_index) for q in dialects.parse(topics).questions] == [("1. First", 1, 1), ("2. Second", 1, 0)]
    plain = "What?\nA. one\nB. two ✅\nC. three\nD. four\nNext?\nA. x\nB. y\nC. z\nD. w"
    got = dialects.plain_cards(plain)
    assert [q.correct_index for q in got.questions] == [1] and [e.number for e in got.errors] == [2]
    sheet = "=====\nTopic 1: Law\n=====\n[Case 1: a story]\nThe story.\nप्रश्न 1. Who?\n(A) he\n(B) she\nउत्तर: (B)\n-----\nप्रश्न 2. What?\n(A) it\n(B) that\nउत्तर: (A)"
    got = dialects.parse(sheet)
    assert [(q.number, q.correct_index, q.section_label) for q in got.questions] == [(1, 1, "Topic 1: Law"), (2, 0, "Topic 1: Law")] and "The story." in got.questions[0].pre_text


def test_custom_grammar():
    got = dialects.custom("Q: Why?\nA) one\nB) two ✅\nC) three\nD) four\nEx: so\nmore\nQ: How?\nA) a\nB) b\nC) c\nD) d\nAnswer: 3\nQ: Bad?\nA) a\nC) c", {})
    assert [(q.number, q.correct_index, q.explanation) for q in got.questions] == [(1, 1, "so\nmore"), (2, 2, "")] and [e.number for e in got.errors] == [3]
    with pytest.raises(ValueError):
        dialects.custom("x", {"option_labels": ["A", "A"]})


def test_typed_and_forwarded():
    q = dialects.typed("What is it?\n(A) one\n(B) two\nAnswer: (B) since\nExplanation: yes")
    assert (q.correct_index, q.explanation) == (1, "since\nyes") and dialects.typed("What?\n(A) one\n(B) two").correct_index == -1 and dialects.typed("no options") is None
    with pytest.raises(marks.Unreadable):
        dialects.typed("What?\n(A) one\n(B) two\nAnswer: D")
    assert [x.number for x in dialects.forwarded("1. a?\n(A) x\n(B) y\nAnswer: A\n2. b?\n(A) x\n(B) y\nAnswer: B")] == [1, 2] and dialects.forwarded("5. a?\n(A) x\n(B) y")[0].correct_index == -1


def test_items():
    title, p = items.parse(json.dumps({"title": "T", "questions": [
        {"question": "a", "options": ["", "x", "y"], "correct_index": 2}, {"question": "b", "options": ["x", "y"], "correct": "B"}, {"q": "c", "choices": ["x", "y"], "answer_index": "1"},
        {"question": "d", "options": ["x", "y"], "correct_index": True}, {"question": "", "options": []}, 5, {"question": "e", "options": ["", "y", "z"], "correct_index": 0}, {"question": "f", "options": "x"}, {"number": "9", "question": "g", "options": ["x"], "correct_index": 0}]}))
    assert title == "T" and [(q.question, q.options, q.correct_index) for q in p.questions] == [("a", ["x", "y"], 1), ("b", ["x", "y"], 1), ("c", ["x", "y"], 0)]
    assert [e.number for e in p.errors] == [4, 5, 6, 7, 8, 9]
    assert len(items.parse(json.dumps({"quizzes": [{"title": "U", "questions": []}, {}]}))[1].errors) == 1 and items.parse("{")[1].errors
    assert items.array_in("text ```json\n[1]\n``` more") == [1] and items.array_in("so: [1, 2] ok") == [1, 2] and items.array_in("none") is None
    assert len(items.from_reply("1. a?\n(A) x\n(B) y\nAnswer: A").questions) == 1


def test_pages():
    def q(html):
        p = pages.extract(html)
        return [(x.number, x.question, x.options, x.correct_index) for x in p.questions], [e.number for e in p.errors], [x.flags for x in p.questions]

    block = lambda n, mark: f'<div class="question">{n}. Why {n}?<div class="option">A) x</div><div class="option{mark}">B) y</div></div>'
    got, errors, _ = q(f"<h2>Part</h2>{block(1, ' correct')}{block(2, '')}{block(3, ' correct')}")
    assert got == [(1, "Why 1?", ["x", "y"], 1), (3, "Why 3?", ["x", "y"], 1)] and errors == [2]
    weak = '<div class="question">1. Why?<div class="option">x</div><div class="option" style="color: green">y</div></div>'
    assert q(weak * 2)[2][0]
    many = '<div class="question">1. Why?<div class="option correct">x</div><div class="option correct">y</div></div>'
    assert q(many)[0] == [] and q(many)[1] == [1]
    radios = "<p>1. Why?</p><p><input type=radio name=a> x</p><p><input type=radio name=a checked> y</p><p>2. How?</p><p><input type=radio name=b checked> z</p><p><input type=radio name=b> w</p>"
    assert [(n, o, i) for n, _, o, i in q(f"<div>{radios}</div>")[0]] == [(1, ["x", "y"], 1), (2, ["z", "w"], 0)]
    assert [n for n, *_ in q("<p>1. One?<br>(A) x<br>(B) y<br>Answer: A</p>")[0]] == [1]
    assert pages.extract("<div><<<p class='question'>").errors and pages.extract(None).errors


@pytest.mark.parametrize(("raw", "want"), [
    ("\ufeffé".encode(), ("é", "utf-8-sig")), ("é".encode("utf-16"), ("é", "utf-16")), (b"\xfe\xff\x00\xe9", ("é", "utf-16")), ("é".encode(), ("é", "utf-8")), (b'<meta charset="latin-1">\xe9', ('<meta charset="latin-1">é', "iso8859-1")),
    (b"<meta charset=nonsense>\xe9", ("<meta charset=nonsense>é", "cp1252")), (b"<meta charset=hex>ab", ("<meta charset=hex>ab", "utf-8")), (b"\x81", ("\x81", "latin-1")), (b"\xff\xfea", ("ÿþa", "cp1252")),
    ("<meta charset='koi8-r'>".encode() + "да".encode("koi8-r"), ("<meta charset='koi8-r'>да", "koi8-r")),
])
def test_page_bytes(raw, want):
    assert charsets.page_text(raw) == want


@pytest.mark.parametrize(("raw", "why"), [(b"", "empty"), (b"%PDF-1.4", "PDF"), (b"PK\x03\x04x", "ZIP")])
def test_page_bytes_refused(raw, why):
    with pytest.raises(ValueError, match=why):
        charsets.page_text(raw)


def test_text_bytes():
    assert charsets.plain_text("\ufeffé".encode()) == ("é", "utf-8-sig") and charsets.plain_text("é".encode("utf-16")) == ("é", "utf-16")
    with pytest.raises(ValueError):
        charsets.plain_text(b"\xff\xff\xe9")


def test_decoded(spark, monkeypatch):
    files_of = spark.createDataFrame([(1, bytearray("é".encode())), (2, None), (3, bytearray(b"%PDF-"))], "id long, content binary")
    assert sorted(tuple(r) for r in charsets.decoded(files_of, "id").collect()) == [(1, "é", "utf-8", None), (2, None, None, "empty"), (3, None, None, "a PDF file")]
    assert charsets.decoded(files_of.limit(0), "id").count() == 0


def test_any_parser_error_is_a_row(spark):
    def broken(text):
        raise {"t": TypeError, "a": AttributeError, "o": OverflowError, "r": RecursionError}[text](text)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate("taor")], "doc_id long, text string")
    told = sorted(r["message"] for r in files.error_rows(files.parse_documents(docs, broken)).collect())
    assert told == [f"the parser failed: {e}" for e in ("AttributeError: a", "OverflowError: o", "RecursionError: r", "TypeError: t")]


def test_documents_as_tables(spark):
    docs = spark.createDataFrame([(1, "1. a?\n(A) x\n(B) y\nAnswer: A\n2. b?\n(A) x\n(B) y\nPage 3"), (2, None), (3, "")], "doc_id long, text string")
    parsed = files.parse_documents(docs, "paper")
    assert [(r["doc_id"], r["number"]) for r in files.question_rows(parsed).collect()] == [(1, 1)]
    assert sorted((r["doc_id"], r["number"]) for r in files.error_rows(parsed).where("number IS NOT NULL").collect()) == [(1, 2)] and files.error_rows(parsed).count() == 3
    assert [r["kind"] for r in files.removed_rows(parsed).collect()] == ["page-number"]
    assert files.parse_documents(docs.limit(0), "html").count() == 0


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x REAL, y TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, None if i % 3 else str(i)) for i in range(1, 101)])
        con.execute("CREATE TABLE none (id INTEGER)")
        con.execute("CREATE TABLE keyed (k TEXT, n INTEGER, x REAL, PRIMARY KEY (k, n)) WITHOUT ROWID")
        con.executemany("INSERT INTO keyed VALUES (?, ?, ?)", [(f"k{i % 7}'", i, None if i % 5 == 0 else i / 4) for i in range(200)])
    db = str(tmp_path / "a.db")
    df = lite.read_sqlite(spark, db, "t")
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("y", "string")] and df.count() == 100 and df.selectExpr("sum(x)", "count(y)").first()[:] == (2525.0, 33)
    assert lite.read_sqlite(spark, db, "none").count() == 0
    keyed = lite.read_sqlite(spark, db, "keyed", parts=3)
    want = spark.createDataFrame([(f"k{i % 7}'", i, None if i % 5 == 0 else i / 4) for i in range(200)], "k string, n long, x double")
    for where in ("true", "n > 17 AND n <= 60", "k = 'k3\\''", "x IS NULL", "x IS NOT NULL AND NOT (n = 3)", "n IN (1, 2, 500)", "k LIKE 'k1%'", "k LIKE '%1%'", "x >= 10.5 OR n = 2", "n % 2 = 0", "x < 3", "k > 'k4'", "n <=> 4"):
        assert sorted(map(str, keyed.where(where).collect())) == sorted(map(str, want.where(where).collect())), where
    some = lite.read_sqlite(spark, db, "keyed", ["x", "n"])
    assert some.columns == ["x", "n"] and some.agg({"n": "sum"}).first()[0] == sum(range(200))
    with pytest.raises(Exception, match="no table"):
        lite.read_sqlite(spark, db, "absent").count()


def test_sqlite_filters_are_pushed(spark, tmp_path):
    """The plan leaves to Spark what the database can't answer, the reader asks it the rest, and each task reads its range of keys."""
    rows = spark.range(100).select(F.col("id"), (F.col("id") * 2).cast("string").alias("s"))
    lite.write_sqlite(rows, str(tmp_path / "b.db"), "t", ["id"], rowid=False)
    df = lite.read_sqlite(spark, str(tmp_path / "b.db"), "t").where("id > 40 AND id < 45 AND s LIKE '%2'")
    assert [r["id"] for r in df.collect()] == [41]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" in plan and "40" not in plan and "45" not in plan  # what is left to Spark
    reader = lite.SqliteReader(str(tmp_path / "b.db"), "t", 4, df.schema)
    left = list(reader.pushFilters([D.GreaterThan(("id",), 40), D.StringContains(("s",), "2"), D.EqualTo(("s",), 5), D.Not(D.In(("id",), (41, 42)))]))
    assert len(left) == 2
    ranges = reader.partitions()
    assert [(r.low, r.high) for r in ranges] == [(None, 25), (25, 50), (50, 75), (75, None)]
    assert [len(list(reader.read(r))) for r in ranges] == [0, 7, 25, 25]
    assert reader.sql("k", ranges[1])[0].count("?") == 5


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xe9\xe9")
    assert sorted((r["name"][-5:], r["text"], r["error"] is None) for r in files.read_texts(spark, str(tmp_path)).collect()) == [("a.txt", "é", True), ("b.txt", None, False)]


def boxed(lines, page, x=40.0, top=60.0):
    return (page, 600.0, 800.0, [layout.Piece(x, top + 20 * i, x + 5 * len(t), top + 20 * i + 10, t) for i, t in enumerate(lines)], None)


def test_questions_of_pages():
    """Page numbers of questions and errors; a question that goes on over the page's end; repeated edges go."""
    edge = [layout.Piece(40, 5, 100, 15, "My paper")]
    one = boxed(["1. first?", "(A) a", "(B) b", "Answer: A", "2. second?", "(A) c"], 1)
    two = boxed(["(B) d", "Answer: B", "3. third?", "(A) e", "(B) f"], 2)
    pages = [(n, w, h, edge + p, e) for n, w, h, p, e in (two, one)] + [(3, 600.0, 800.0, [], None), (4, 0.0, 0.0, [], "broken")]
    got = boxes.parse(pages)
    assert [(q.number, q.page, q.options) for q in got.questions] == [(1, 1, ["a", "b"]), (2, 1, ["c", "d"])]
    assert [(e.number, e.page, e.message) for e in got.errors] == [(None, 3, "the page has no text"), (None, 4, "broken"), (3, 2, "no answer")]
    assert ("header/footer", "My paper") in got.removed and boxes.parse([]).errors[0].message == "no pages"


def test_two_columns_of_a_page():
    left = ["1. first?", "(A) a", "(B) b", "Answer: A"]
    right = ["2. second?", "(A) c", "(B) d", "Answer: B"]
    page = (1, 600.0, 800.0, boxed(left, 1)[3] + boxed(right, 1, x=340.0)[3], None)
    assert [(q.number, q.correct_index) for q in boxes.parse([page]).questions] == [(1, 0), (2, 1)]


def test_read_pages(spark, tmp_path):
    """A reader's pages, and why a file has none."""
    (tmp_path / "a.pdf").write_bytes(b"%PDF-x")
    (tmp_path / "b.pdf").write_bytes(b"plain")

    def reader(raw):
        if raw[:5] != b"%PDF-":
            raise ValueError("no PDF file")
        return [(1, 600.0, 800.0, [layout.Piece(1, 2, 3, 4, "x")], None)]

    got = sorted((r["name"][-5:], r["page"], [p["text"] for p in r["pieces"]], r["error"]) for r in boxes.read_pages(spark, str(tmp_path), reader).collect())
    assert got == [("a.pdf", 1, ["x"], None), ("b.pdf", None, [], "no PDF file")]
    for raw, message in ((b"", "empty"), (b"plain", "no PDF")):
        with pytest.raises(ValueError, match=message):
            boxes.read_pdf(raw)


def test_long_text_after_an_input_is_whole():
    long = "word " * 200
    html = f"<div class='question'><p>1. Which?</p><input type='radio' name='a' checked>{long}<br><input type='radio' name='a'>short</div>"
    assert pages.extract(html).questions[0].options == [long.strip(), "short"]


def test_pages_with_too_many_elements(monkeypatch):
    monkeypatch.setattr(pages.Builder, "__init__", lambda self, real=pages.Builder.__init__: real(self, 3))
    assert [e.message for e in pages.extract("<p>1</p>" * 9).errors] == ["too many elements"]


def test_lexicon(spark):
    """As one document at a time by plain counts; words of other documents don't count."""
    words, torn = ["राजस्थान", "कर्नाटक", "है"], ["रा जस्था न", "कर्ना टक", "है"]
    rng, rows = random.Random(6), []
    for doc in (1, 2, None):
        for line in range(12):
            rows.append((doc, line, " ".join(rng.choice(rng.choice([words, torn])) for _ in range(rng.randint(0, 6)))))
    rows += [(3, 0, "रा जस्था न"), (3, 1, None), (3, 2, ""), (4, 0, "abc  कि ताब ि")]
    lines = spark.createDataFrame(rows, "doc long, line int, text string")
    got = {(r["doc"], r["line"]): (r["text"], [tuple(f) for f in r["fixes"]]) for r in lexicon.rejoined(lines, lexicon.lexicon(lines, "doc"), "doc").collect()}
    for doc, line, text in rows:
        counts = Counter(w for d, _, t in rows if d == doc and d is not None for w in (t or "").split() if re.fullmatch("[ऀ-ॿ]+", w))
        fixed, fixes = layout.respaced(text, counts) if text is not None else (None, [])
        assert got[doc, line] == (fixed, fixes)
    assert len(got) == len(rows) and any(f for _, f in got.values())


def test_file_entries(spark):
    rows = [("a.txt", "1. One?\n(A) x\n(B) y\nAnswer: B\n2. Two?\n(A) x\n(B) y", None, "A"), ("b.txt", None, "c", None)]
    found = {r["name"]: r for r in files.file_entries(spark.createDataFrame(rows, "name string, text string, caption string, title string"), "paper", "upload").collect()}
    a, b = found["a.txt"], found["b.txt"]
    assert [(q["number"], q["source_ref"]) for q in a["questions"]] == [(1, "a.txt")] and a["raw_errors"] == ["2: no answer"] and a["report"]["failed"] == 1 and a["source"] == "upload" and a["default_title"] == "A"
    assert b["sha256"] is None and b["raw_errors"] == ["empty text"] and b["caption"] == "c" and not b["questions"]


def test_batches_of_parsers_are_bounded(spark):
    """Long texts reach Python a few at a time, whatever the session's batches were."""
    from tallyforge.shared import ARROW_BYTES, BATCH_BYTES
    from tallyforge.sources import charsets, files

    was = spark.conf.get(ARROW_BYTES)
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    try:
        for made in (lambda: files.parse_documents(docs, "html"), lambda: charsets.decoded(docs.selectExpr("doc_id", "encode(text, 'UTF-8') AS content"), "doc_id")):
            spark.conf.set(ARROW_BYTES, "64m")
            assert made().count() == 1
            assert int(spark.conf.get(ARROW_BYTES)) == BATCH_BYTES
    finally:
        spark.conf.set(ARROW_BYTES, was)


def test_gutter_asks_each_piece_once():
    """A page's pieces are not counted anew for each place of its middle, and the place is the one that counting gives."""
    asked = Counter()

    class Box(layout.Piece):
        def __getattribute__(self, name):
            asked[name] += name in ("x0", "x1")
            return super().__getattribute__(name)

    rng = random.Random(6)
    for n in (0, 1, 9, 300):
        pieces = [Box(x0 := rng.choice([rng.uniform(0, 600), float(rng.randint(90, 210) * 2)]), 0.0, x0 + rng.choice([0, 2, 4, 4.5, 100, 300, -50]), 9.0, "x") for _ in range(n)]
        asked.clear()
        got = layout.gutter(pieces, 600.0)
        assert asked["x0"] + asked["x1"] <= 2 * n
        assert got == min(range(180, 421, 2), key=lambda x: (sum(p.x0 < x - 2 and p.x1 > x + 2 for p in pieces), abs(x - 300.0)))


def test_lines_are_taken_apart_once(monkeypatch):
    """A line of a paper is asked for its options by several steps, but they are looked for once."""
    seen, split = Counter(), marks.split_options
    monkeypatch.setattr(marks, "split_options", lambda line: seen.update([line]) or split(line))
    told = papers.parse("\n".join(f"{n}. Which one is {n * 7919}?\n(A) a{n}\n(B) b{n}\n(C) c{n}\n(D) d{n}\nAnswer: B" for n in range(1, 40)))
    assert len(told.questions) == 39 and not told.errors
    assert seen and max(seen.values()) == 1
    marks.expanded("(A) one (B) two").clear()  # what is given out is the caller's own
    assert marks.expanded("(A) one (B) two") == ["(A) one", "(B) two"]


def test_elements_of_pages_are_read_once(monkeypatch):
    """Of a page with many questions each option's text is put together once, and each block's options are looked for once."""
    made, looked, whole, found = Counter(), Counter(), pages.Element._text, pages._from_classes
    monkeypatch.setattr(pages.Element, "_text", lambda e, skip, item: made.update([id(e)]) or whole(e, skip, item))
    monkeypatch.setattr(pages, "_from_classes", lambda box: looked.update([id(box)]) or found(box))
    kept = []  # elements live on, so that no two have one id
    monkeypatch.setattr(pages, "tree", lambda html, tree=pages.tree: kept.append(tree(html)) or kept[-1])
    block = '<div class="question" id="q{0}"><p>{0}. Which is {0}?</p><div class="option">A) a{0}</div><div class="option correct" aria-checked="">B) b{0}</div><div class="explanation">Seen at {0}</div></div>'
    told = pages.extract("<html><body>" + "".join(block.format(n) for n in range(1, 60)) + "</body></html>")
    assert [(q.number, q.options, q.correct_index, q.explanation) for q in told.questions] == [(n, [f"a{n}", f"b{n}"], 1, f"Seen at {n}") for n in range(1, 60)]
    assert max(looked.values()) == 1 and max(made.values()) <= 2  # once more without its options


def test_innermost_elements(monkeypatch):
    """Those in which no other of the found lies, each way up taken once."""
    rng, steps, above = random.Random(7), Counter(), pages.Element.above
    root = pages.tree("<div>" * 30 + "".join("<p><b>x</b></p>" + "</div>" * (n % 2) for n in range(40)))
    every = list(root.walk())
    brute = lambda found: [e for e in found if not any(o is not e and pages._contains(e, o) for o in found)]
    for n in (0, 1, 5, 40, len(every)):
        found = rng.sample(every, n)
        assert [*map(id, pages._innermost(found))] == [*map(id, brute(found))]
    monkeypatch.setattr(pages.Element, "above", lambda e: (steps.update(["n"]) or x for x in above(e)))
    pages._innermost(every)
    assert steps["n"] <= 2 * len(every)
