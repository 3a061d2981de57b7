"""The rest of the inventory: look-ups, question rules, more grammars and layouts as round trips, results as text."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..adapters import Tables
from ..functions import payloads as P
from ..functions import render as R
from ..functions import scores as S
from ..functions import text as X
from ..operators import lexicon as L2
from ..operators import settings, stats, tables
from ..shared import fresh_dir
from ..sources import charsets, dialects, files, papers, sqlite
from ..sources import layout as L
from ..sources import marks as M
from .registry import query
from .sources import _READ, _TEN, _letter, _options, _parts, _read, _rendered


@query("OP-039 OP-040 OP-042 OP-352", "SELECT a.id, a.user_id, u.username, a.status FROM attempts a LEFT JOIN users u ON u.user_id = a.user_id WHERE a.id IN (5, 77, 401) OR (a.status = 'active' AND a.id % 1000 = 9)")
def looked_up(t: Tables) -> DataFrame:
    found = t.attempts.where(F.col("id").isin(5, 77, 401) | ((F.col("status") == "active") & (F.col("id") % 1000 == 9)))
    return found.join(t.users, "user_id", "left").select("id", "user_id", "username", "status")


@query("OP-011 OP-357", "SELECT c_nationkey AS chat_id, min(c_mktsegment) AS batch_name, row_number() OVER (ORDER BY c_nationkey) AS n FROM customer GROUP BY c_nationkey")
def authorised_chats(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    chats = t.customer.groupBy(F.col("c_nationkey").alias("chat_id")).agg(F.min("c_mktsegment").alias("batch_name"))
    return chats.withColumn("n", F.row_number().over(Window.orderBy("chat_id")))  # one row for each chat of one admin


@query("OP-046 OP-047 OP-283", """
    SELECT p_partkey, p_partkey % 5 <> 0 AND p_size % 4 < 3 AND p_partkey % 7 <> 0 AS fits, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Part ' || p_size END AS section FROM part""")
def question_rules(t: Tables) -> DataFrame:
    c = F.col
    options = F.when(c("p_partkey") % 5 == 0, F.array("p_type")).when(c("p_partkey") % 7 == 0, F.array("p_type", F.lit(" "), "p_brand")).otherwise(F.array("p_type", "p_brand", "p_name"))
    section = tables.section_name(F.when(c("p_partkey") % 2 == 0, c("p_type")).otherwise(c("p_size").cast("string")), F.concat(F.lit("Part "), c("p_size").cast("string")))
    return t.part.select("p_partkey", tables.fits(c("p_name"), options, (c("p_size") % 4).cast("int")).alias("fits"), section.alias("section"))


@query("OP-181 OP-182 OP-183 OP-203", """
    SELECT p_partkey, 'किताब ' || p_name AS repaired, lower(regexp_replace(p_name, ' +', ' ', 'g')) || ' x' AS compared, lower(replace(p_name, ' ', '')) || 'ii' AS key FROM part""")
def text_keys(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", X.repair_vowel_signs(F.concat(F.lit("िकताब "), name)).alias("repaired"), X.compared(F.concat(F.upper(name), F.lit(" ; X."))).alias("compared"), X.label_key(F.concat(F.upper(name), F.lit(" - (II)"))).alias("key"))


@query("OP-014", "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'utf-16' ELSE 'utf-8' END AS charset FROM documents")
def decoded_texts(t: Tables) -> DataFrame:
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    files_of = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return charsets.decoded(files_of, "doc_id", how=charsets.plain_text).select("doc_id", "text", "charset")


@query("OP-015", """
    SELECT page_id, CASE page_id % 6 WHEN 2 THEN '<meta charset="iso-8859-1">' || regexp_replace(html, '[^\x00-\xFF]', '?', 'g') WHEN 3 THEN '<p>“' || regexp_replace(html, '[^\x00-\x7E]', '?', 'g') WHEN 5 THEN NULL ELSE html END AS text,
           CASE page_id % 6 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'iso8859-1' WHEN 3 THEN 'cp1252' WHEN 4 THEN 'utf-8' END AS charset,
           CASE WHEN page_id % 6 = 5 THEN CASE WHEN page_id % 12 = 5 THEN 'a ZIP file' ELSE 'a PDF file' END END AS error
    FROM pages""")
def page_bytes(t: Tables) -> DataFrame:
    """Pages as bytes: with marks of UTF-8 and UTF-16, with a declared set, in a set of Windows that nothing tells, plain, and behind the heads of other formats."""
    mark = lambda x: F.unhex(F.lit(x))
    latin = F.concat(F.encode(F.lit('<meta charset="iso-8859-1">'), "ISO-8859-1"), F.encode(F.regexp_replace("html", "[^\\x00-\\xFF]", "?"), "ISO-8859-1"))
    windows = F.concat(F.encode(F.lit("<p>"), "UTF-8"), mark("93"), F.encode(F.regexp_replace("html", "[^\\x00-\\x7E]", "?"), "UTF-8"))
    plain, rest = F.encode("html", "UTF-8"), F.col("page_id") % 6
    other = F.concat(F.when(F.col("page_id") % 12 == 5, mark("504B0304")).otherwise(F.encode(F.lit("%PDF-"), "UTF-8")), plain)
    content = F.when(rest == 0, F.concat(mark("EFBBBF"), plain)).when(rest == 1, F.concat(mark("FFFE"), F.encode("html", "UTF-16LE"))).when(rest == 2, latin).when(rest == 3, windows).when(rest == 4, plain).otherwise(other)
    return charsets.decoded(t.pages.select("page_id", content.alias("content")), "page_id")


@query("OP-001", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8 AND n_name LIKE '%I%'")
def sqlite_filtered(t: Tables) -> DataFrame:
    """Nations as a database; it answers the comparisons, Spark the pattern. The plan shows what was pushed."""
    folder = fresh_dir(t.spark, "sqlite").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    sqlite.write_sqlite(t.nation.select(*[F.col(c).cast("long" if c.endswith("key") else "string") for c in t.nation.columns]), f"{folder}/nation.db", "nation", ["n_nationkey"])
    found = sqlite.read_sqlite(t.spark, f"{folder}/nation.db", "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return found.where("n_regionkey = 2 AND n_nationkey > 8 AND n_name LIKE '%I%'").select(F.col("n_nationkey").cast("int"), "n_name")


# ----------------------------------------------------- grammars, round trips


@query("OP-082 OP-219", f"SELECT doc_id, number, CASE WHEN number BETWEEN 4 AND 6 THEN 'Directions (Q. 4-6): read the passage' || chr(10) || 'A tale of ' || doc_id ELSE '' END AS pre_text FROM ({_TEN}) t")
def passages(t: Tables) -> DataFrame:
    p = _parts()
    head = F.when(p["n"] == "4", F.concat(F.lit("Directions (Q. 4-6): read the passage\nA tale of "), F.expr("p_partkey div 10").cast("string"), F.lit("\n"))).otherwise("")
    block = F.concat(head, p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.lit("\nAnswer: "), _letter(p["k"]))
    return files.question_rows(files.parse_documents(_rendered(t, block), "paper")).select("doc_id", "number", "pre_text")


@query("OP-117", _READ.format("", _TEN))
def ocr_labels(t: Tables) -> DataFrame:
    """(B) read as (8) and (C) as (0): repaired where the sequence proves it."""
    p = _parts()
    options = F.concat(*[x for i, mark in enumerate("A80D") for x in (F.lit(f"\n({mark}) "), p["o"][i])])
    docs = _rendered(t, F.concat(p["n"], F.lit(". "), p["q"], options, F.lit("\nAnswer: "), _letter(p["k"])))
    return _read(files.parse_documents(docs, lambda text: papers.parse("\n".join(L.relabelled((text or "").split("\n"))[0]))))


@query("OP-113 OP-196 OP-385", _READ.format("", _TEN))
def html_sequences(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.lit('<p><input type="radio" name="q'), p["n"], F.lit('"'), F.when(p["k"] == i, " checked").otherwise(""), F.lit(f">{'ABCD'[i]}) "), p["o"][i], F.lit("</p>"))])
    return _read(files.parse_documents(_rendered(t, F.concat(F.lit("<p>"), p["n"], F.lit(". "), p["q"], F.lit("</p>"), options), "<html><body><div>"), "html"))


@query("OP-197 OP-391 OP-392", _READ.format(", explanation", _TEN))
def html_told_answers(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.lit("<li>"), p["o"][i], F.lit("</li>"))])
    block = F.concat(F.lit('<div class="mcq"><b>'), p["n"], F.lit(". "), p["q"], F.lit("</b><ul>"), options, F.lit("</ul><p>Answer: "), _letter(p["k"]), F.lit("</p><p>Explanation: "), p["e"], F.lit("</p></div>"))
    return _read(files.parse_documents(_rendered(t, block), "html"), "explanation")


@query("OP-226 OP-227", f"SELECT doc_id, number, question, options, correct_index, 'Topic 1: Things' AS section_label FROM ({_TEN}) t")
def teaching_sheets(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(F.lit("प्रश्न "), p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.lit("\nउत्तर: ("), _letter(p["k"]), F.lit(")\n-----"))
    return _read(files.parse_documents(_rendered(t, block, "=====\nTopic 1: Things\n=====\n"), "text"), "section_label")


@query("OP-229", _READ.format(", explanation", _TEN))
def custom_grammar(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(F.lit("Q: "), p["q"], _options(p, "?)"), F.lit("\nAnswer: "), (p["k"] + 1).cast("string"), F.lit("\nEx: "), p["e"])
    return _read(files.parse_documents(_rendered(t, block), lambda text: dialects.custom(text or "", {})), "explanation")


def _one_question(t: Tables) -> DataFrame:
    p = _parts()
    return files.dealt(t.part, "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.concat(p["q"], F.lit("\nA-III, B-I"), _options(p, "(?)"), F.lit("\nAnswer: ("), _letter(p["k"]), F.lit(") as\nExplanation: "), p["e"]).alias("text"))


@query("OP-230 OP-212 OP-233", """
    SELECT p_partkey AS doc_id, 'Which is ' || p_name || ' ' || p_partkey || '?' || chr(10) || 'A-III, B-I' AS question, [p_type, p_brand, 'size ' || p_size, p_name] AS options, (p_size % 4)::INTEGER AS correct_index,
           'as' || chr(10) || 'Seen at ' || p_partkey AS explanation FROM part""")
def typed_questions(t: Tables) -> DataFrame:
    read = files.parse_documents(_one_question(t), lambda text: M.Parsed(questions=[dialects.typed(text)]))
    return files.question_rows(read).select("doc_id", "question", "options", "correct_index", "explanation")


@query("OP-231 OP-402 OP-403 OP-404", "SELECT p_partkey AS doc_id, 1 AS number, (p_size % 4)::INTEGER AS correct_index FROM part")
def forwarded_questions(t: Tables) -> DataFrame:
    numbered = _one_question(t).select("doc_id", F.concat(F.lit("1. "), "text").alias("text"))
    read = files.parse_documents(numbered, lambda text: M.Parsed(questions=dialects.forwarded((text or "").replace(") as\n", ")\n"))))
    return files.question_rows(read).select("doc_id", "number", "correct_index")


@query("OP-232 OP-213", "SELECT p_partkey AS doc_id, [p_type, p_brand, 'size ' || p_size, p_name] AS options FROM part")
def typed_options(t: Tables) -> DataFrame:
    p = _parts()

    @F.pandas_udf("array<string>")
    def read(text: pd.Series) -> pd.Series:
        return text.map(dialects.typed_options)

    plain = F.array_join(p["o"], "\n")
    return t.part.select(F.col("p_partkey").alias("doc_id"), read(F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(_options(p, "(?)"))).alias("options"))


@query("OP-234", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [(p_size % 4)::INTEGER] WHEN 1 THEN [(p_size % 4)::INTEGER, 3] END AS correct FROM part")
def poll_answers(t: Tables) -> DataFrame:
    """Right options of a received poll: the list, else the one, else unknown."""
    one = (F.col("p_size") % 4).cast("int")
    many, single = F.when(F.col("p_partkey") % 3 == 1, F.array(one, F.lit(3))), F.when(F.col("p_partkey") % 3 == 0, one)
    return t.part.select("p_partkey", F.coalesce(F.when(F.size(many) > 0, many), F.when(single.isNotNull(), F.array(single))).alias("correct"))


# --------------------------------------------------------------- layouts


@query("OP-256 OP-261", "SELECT p_partkey // 8 AS page, p_partkey AS line, p_type || ' ' || p_brand AS text FROM part UNION ALL SELECT p_partkey // 8, p_partkey, p_name FROM part")
def lines_of_spans(t: Tables) -> DataFrame:
    """Three spans a line: the first two a word apart, the third in another cell."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            spans = [L.Piece(0, 0, 40, 10, r.p_type), L.Piece(43, 0, 90, 10, r.p_brand), L.Piece(300, 0, 380, 10, r.p_name)]
            out += [(r.page, r.p_partkey, x.text) for x in L.lines_of(spans)]
        return pd.DataFrame(out, columns=["page", "line", "text"])

    return t.part.select(F.expr("p_partkey div 8").alias("page"), "p_partkey", "p_type", "p_brand", "p_name").groupBy("page").applyInPandas(work, "page long, line long, text string")


@query("OP-259 OP-130", "SELECT p_partkey // 8 AS page, string_agg(p_name, '|' ORDER BY p_partkey) || '|' || 'Answer: A|Answer: B' AS text, true AS columns FROM part GROUP BY 1")
def page_columns(t: Tables) -> DataFrame:
    """Four lines left, four right and an answer line in each column: read down, left first."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows.sort_values("p_partkey").p_name.tolist()
        names = names + [""] * (8 - len(names))
        left = [L.Piece(20, 20.0 * i, 220, 20.0 * i + 10, x) for i, x in enumerate(names[:4])] + [L.Piece(20, 90, 220, 100, "Answer: A")]
        right = [L.Piece(320, 20.0 * i, 520, 20.0 * i + 10, x) for i, x in enumerate(names[4:])] + [L.Piece(320, 90, 520, 100, "Answer: B")]
        ordered, two = L.in_order([*right, *left], 600)
        texts = [x.text for x in ordered]
        told = [x for x in texts if not x.startswith("Answer")] + [x for x in texts if x.startswith("Answer")]
        return pd.DataFrame({"page": [rows.page.iloc[0]], "text": ["|".join(told)], "columns": [two]})

    return t.part.select(F.expr("p_partkey div 8").alias("page"), "p_partkey", "p_name").groupBy("page").applyInPandas(work, "page long, text string, columns boolean")


@query("OP-260 OP-394 OP-190", "SELECT p_partkey, 'Answer: ' || CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN '?' ELSE 'A' END AS text, 'राजस्थान ' || p_name AS joined FROM part")
def readings(t: Tables) -> DataFrame:
    """Two readings of an answer: a digit against a letter, two letters, the same letter; and a word torn apart."""

    @F.pandas_udf("text string, joined string")
    def work(key: pd.Series, name: pd.Series) -> pd.DataFrame:
        out = []
        for k, n in zip(key, name, strict=True):
            main, other = ("8", "B") if k % 3 == 0 else ("A", "B") if k % 3 == 1 else ("A", "A")
            got, _ = L.reconciled([L.Piece(0, 0, 90, 10, f"Answer: {main}")], [L.Piece(0, 1, 90, 11, f"Answer: {other}")])
            out.append((got[0].text, L.respaced(f"रा जस्था न {n}", {"राजस्थान": 2})[0]))
        return pd.DataFrame(out, columns=["text", "joined"])

    return t.part.select("p_partkey", work("p_partkey", "p_name").alias("r")).select("p_partkey", "r.text", "r.joined")


_WORDS = {0: ("राजस्थान", "रा जस्था न"), 1: ("कर्नाटक", "कर्ना टक"), 2: ("झारखंड", "झार खं ड")}
_SPELLED = ["CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN '{w[i]}'" for k, w in _WORDS.items()) + " END || ' ' || p_name" for i in (0, 1)]


@query("OP-190 OP-138", f"""
    WITH p AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS line, p_name FROM part), w AS (SELECT *, line = 1 OR (line = 2 AND doc_id % 2 = 0) AS whole FROM p),
    c AS (SELECT doc_id, count(*) AS n FROM w WHERE whole GROUP BY doc_id)
    SELECT doc_id, line, CASE WHEN whole OR (line = 5 AND n >= 2) THEN {_SPELLED[0]} WHEN line = 5 THEN {_SPELLED[1]} ELSE p_name END AS text FROM w LEFT JOIN c USING (doc_id)""")
def torn_words(t: Tables) -> DataFrame:
    """Ten lines a document. A word that two lines spell whole is put together in a third; where one line does, it stays torn."""
    d, line = F.expr("p_partkey div 10"), F.col("p_partkey") % 10
    said = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, w in _WORDS.items() for x in (k, w[i])]), (d % 3).cast("int"))
    whole = (line == 1) | ((line == 2) & (d % 2 == 0))
    text = F.when(whole, F.concat(said(0), F.lit(" "), "p_name")).when(line == 5, F.concat(said(1), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    lines = t.part.select(d.alias("doc_id"), line.alias("line"), text.alias("text"))
    return L2.rejoined(lines, L2.lexicon(lines, "doc_id"), "doc_id").select("doc_id", "line", "text")


# ------------------------------------------------------- templates and text


@query("OP-172 OP-173 OP-174 OP-396 OP-397 OP-398", """
    SELECT id, 'Q' || CASE WHEN position % 3 = 0 THEN 'III' WHEN position % 3 = 1 THEN 'I' ELSE 'II' END || ' / 9' || chr(10) || question AS question, 'i. one' AS first FROM questions""")
def presented_payloads(t: Tables) -> DataFrame:
    @F.pandas_udf("question string, first string")
    def build(question: pd.Series, place: pd.Series) -> pd.DataFrame:
        out = []
        for q, i in zip(question, place, strict=True):
            index, options = (int(i) - 1) % 3, ["one", "two"]
            p = P.presented(P.payload(q, options, 1, [0, 1], index, 9), q, options, index, 9, {"heading": "Q{number} / {total}", "numbering": "roman", "option_labels": ["i.", "ii."]})
            out.append((p.question, p.options[0]))
        return pd.DataFrame(out, columns=["question", "first"])

    return t.questions.select("id", build("question", "position").alias("p")).select("id", "p.question", "p.first")


@query("OP-030 OP-408", """
    SELECT doc_id, count(*)::INTEGER AS questions, count(*) AS answers, string_agg('(' || substr('ABCD', p_size % 4 + 1, 1) || ') ' || CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN 'size ' || p_size ELSE p_name END, '|' ORDER BY p_partkey) AS right
    FROM (SELECT p_partkey // 10 AS doc_id, * FROM part) p GROUP BY doc_id""")
def previews(t: Tables) -> DataFrame:
    p = _parts()
    parsed = files.parse_documents(_rendered(t, F.concat(p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.lit("\nAnswer: "), _letter(p["k"]))), "paper")

    @F.pandas_udf("string")
    def told(rows: pd.Series) -> pd.Series:
        import json

        return rows.map(lambda x: R.preview("T", json.loads(x), [], []))

    text = told(F.to_json("questions"))
    shown = parsed.select("doc_id", text.alias("text"))
    count = lambda word: F.regexp_count("text", F.lit(word))
    right = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: x.startswith("Correct Answer: ")), lambda x: F.substr(x, F.lit(17))), "|")
    return shown.select("doc_id", count("प्रश्न ").alias("questions"), count("Correct Answer:").cast("long").alias("answers"), right.alias("right"))


_NET = "correct - wrong * coalesce(negative_mark, 0)"


@query("OP-338 OP-336 OP-337", f"""
    WITH b AS (SELECT *, {_NET} AS net, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY {_NET} DESC, duration_sec, id) AS rn FROM attempts WHERE status = 'finished'),
    r AS (SELECT quiz_id, user_id, row_number() OVER (PARTITION BY quiz_id ORDER BY net DESC, duration_sec, id) AS rank, count(*) OVER (PARTITION BY quiz_id) AS n FROM b WHERE rn = 1)
    SELECT a.id, 'Total: ' || total || chr(10) || 'Correct: ' || correct || ' ✅' || chr(10) || 'Wrong: ' || wrong || ' ❌' || chr(10) || 'Score: ' || correct || '/' || total
        || CASE WHEN a.status = 'finished' AND r.n > 1 THEN chr(10) || 'Rank: ' || r.rank || ' / ' || r.n ELSE '' END AS text
    FROM attempts a LEFT JOIN r ON r.quiz_id = a.quiz_id AND r.user_id = a.user_id WHERE a.status IN ('finished', 'stopped')""")
def result_texts(t: Tables) -> DataFrame:
    rows = stats.done(t.attempts).join(stats.ranks(t.attempts), ["quiz_id", "user_id"], "left")
    s = lambda c: F.col(c).cast("string")
    rank = F.when((F.col("status") == "finished") & (F.col("participants") > 1), F.concat(F.lit("\nRank: "), s("rank"), F.lit(" / "), s("participants"))).otherwise("")
    text = F.concat(F.lit("Total: "), s("total"), F.lit("\nCorrect: "), s("correct"), F.lit(" ✅\nWrong: "), s("wrong"), F.lit(" ❌\nScore: "), s("correct"), F.lit("/"), s("total"), rank)
    return rows.select("id", text.alias("text"))


@query("OP-031 OP-340 OP-346", """
    SELECT id, correct + wrong AS attempted, greatest(0, total - correct - wrong - skipped) AS unattempted, CASE WHEN duration_sec >= 60 THEN (duration_sec::BIGINT // 60) || 'm ' || (duration_sec::BIGINT % 60) || 's' ELSE duration_sec::BIGINT || 's' END AS time_taken FROM attempts""")
def report_data(t: Tables) -> DataFrame:
    c = F.col
    whole = F.rint("duration_sec").cast("long")
    taken = F.when(whole >= 60, F.format_string("%dm %ds", F.expr("cast(rint(duration_sec) as bigint) div 60"), whole % 60)).otherwise(F.format_string("%ds", whole))
    return t.attempts.select("id", (c("correct") + c("wrong")).alias("attempted"), S.unanswered(c("total"), c("correct"), c("wrong"), c("skipped")).alias("unattempted"), taken.alias("time_taken"))


@query("OP-350", "SELECT doc_id, 'file ' || doc_id || '.txt' AS name, sha256(text) AS sha256, length(text) AS chars FROM documents")
def file_entries(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


# ------------------------------------------------------------------ tables


@query("OP-287", """
    SELECT event_id FROM (SELECT event_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY answered_ts, event_id) AS n FROM group_events WHERE user_id NOT IN (SELECT started_by FROM group_sessions WHERE status = 'active')) x WHERE n = 1""")
def session_starts(t: Tables) -> DataFrame:
    """A session begins for a starter unless one runs; of several the first does."""
    from ..operators.sessions import first_wins

    busy = t.group_sessions.where("status = 'active'").select(F.col("started_by").alias("user_id"))
    free = t.group_events.join(busy, "user_id", "left_anti").select("user_id", "answered_ts", "event_id")
    return first_wins(free, ["user_id"], "answered_ts", "event_id").select("event_id")


@query("OP-306 OP-271", "SELECT user_id, username, 0.5::DOUBLE AS default_mark, NULL::INTEGER AS part_no, 'first_name,is_banned' AS lost FROM users")
def migrated_users(t: Tables) -> DataFrame:
    grown = tables.evolve(t.users.select("user_id", "username"), T.StructType.fromDDL("user_id long, username string, default_mark double, part_no int"), {"default_mark": 0.5})
    return grown.withColumn("lost", F.lit(",".join(tables.lost_columns(["USER_ID", "username"], t.users))))


@query("OP-335 OP-355 OP-370", "SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 0.0::DOUBLE ELSE 9.0::DOUBLE END AS verified_ts FROM events GROUP BY user_id")
def revoked_members(t: Tables) -> DataFrame:
    """Members lose their verification when an event says that they left."""
    members = t.events.select("user_id").distinct().withColumn("verified_ts", F.lit(9.0))
    left = t.events.where("event_type = 'error'").select("user_id").distinct().withColumn("verified_ts", F.lit(0.0))
    return tables.upsert(members, left, ["user_id"])


@query("OP-406 OP-365", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'creating' WHEN 'P' THEN 'creating' ELSE 'other' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'attempts' ELSE 'group_sessions' END AS control FROM orders")
def migrated_states(t: Tables) -> DataFrame:
    old = F.when(F.col("o_orderstatus") == "F", "await_options").when(F.col("o_orderstatus") == "P", "await_correct").otherwise("other")
    control = F.element_at(F.create_map(F.lit("p"), F.lit("attempts"), F.lit("g"), F.lit("group_sessions")), F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("g"))
    return t.orders.select("o_orderkey", settings.migrated_state(old).alias("state"), control.alias("control"))
