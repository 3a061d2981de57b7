"""Parsers over documents rendered from the driver's tables: what is read back must be what was rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..sources import boxes, files
from .registry import query

_TEN = """SELECT p_partkey // 10 AS doc_id, (p_partkey % 10 + 1)::INTEGER AS number, 'Which is ' || p_name || ' ' || p_partkey || '?' AS question,
    [p_type, p_brand, 'size ' || p_size, p_name] AS options, (p_size % 4)::INTEGER AS correct_index, 'Seen at ' || p_partkey AS explanation FROM part"""
_READ = "SELECT doc_id, number, question, options, correct_index{} FROM ({}) t"


def _letter(i: Column) -> Column:
    return F.substr(F.lit("ABCDL"), i + 1, F.lit(1))


def _rendered(t: Tables, block: Column, head: str = "", foot: Column | None = None) -> DataFrame:
    """Ten parts a document: doc_id, text."""
    rows = t.part.select(F.expr("p_partkey div 10").alias("doc_id"), (F.col("p_partkey") % 10 + 1).cast("int").alias("n"), block.alias("b"), (foot if foot is not None else F.lit("")).alias("f"))
    docs = files.dealt(rows, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "b", "f"))).alias("x"))
    return docs.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda s: s["b"]), "\n"), F.array_join(F.transform("x", lambda s: s["f"]), "")).alias("text"))


def _parts() -> dict[str, Column]:
    c = F.col
    s = lambda x: c(x).cast("string")
    return {
        "n": (c("p_partkey") % 10 + 1).cast("string"), "q": F.concat(F.lit("Which is "), c("p_name"), F.lit(" "), s("p_partkey"), F.lit("?")),
        "o": F.array("p_type", "p_brand", F.concat(F.lit("size "), s("p_size")), "p_name"), "k": c("p_size") % 4, "e": F.concat(F.lit("Seen at "), s("p_partkey")),
    }


def _options(p: dict[str, Column], form: str) -> Column:
    before, after = form.split("?")
    return F.concat(*[x for i in range(4) for x in (F.lit(f"\n{before}{'ABCD'[i]}{after} "), p["o"][i])])


def _read(parsed: DataFrame, *more: str) -> DataFrame:
    return files.question_rows(parsed).select("doc_id", "number", "question", "options", "correct_index", *more)


@query("OP-207 OP-020 OP-115 OP-112 OP-187 OP-217 OP-218 OP-378 OP-379 OP-380 OP-381 OP-382 OP-222", _READ.format(", explanation", _TEN))
def papers_inline(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.lit("\nAnswer: "), _letter(p["k"]), F.lit("\nExplanation: "), p["e"])
    return _read(files.parse_documents(_rendered(t, block, "Model paper\nPage 1 of 9\nJoin our telegram channel\n"), "paper"), "explanation")


@query("OP-214 OP-215 OP-216 OP-081 OP-383", _READ.format("", _TEN))
def papers_keyed(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(F.lit("Q."), p["n"], F.lit(") "), p["q"], _options(p, "?)"))
    foot = F.concat(F.when(p["n"] == "1", "\nAnswer Key\n").otherwise(", "), p["n"], F.lit("-"), _letter(p["k"]))
    return _read(files.parse_documents(_rendered(t, block, foot=foot), "paper"))


@query("OP-208 OP-209 OP-210 OP-377 OP-376", _READ.format("", _TEN))
def papers_one_line(t: Tables) -> DataFrame:
    p = _parts()
    line = F.concat(*[x for i in range(4) for x in (F.lit(f" ({'ABCD'[i]}) "), p["o"][i])])
    return _read(files.parse_documents(_rendered(t, F.concat(p["n"], F.lit(". "), p["q"], F.lit("\n"), F.trim(line), F.lit("\nउत्तर: ("), _letter(p["k"]), F.lit(")"))), "paper"))


@query("OP-223 OP-224 OP-235", _READ.format(", explanation", _TEN))
def ticked_cards(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.lit(f"\n{'ABCD'[i]}) "), p["o"][i], F.when(p["k"] == i, " ✅").otherwise(""))])
    return _read(files.parse_documents(_rendered(t, F.concat(p["n"], F.lit(". "), p["q"], options, F.lit("\nEx: "), p["e"], F.lit("\n"))), "text"), "explanation")


@query("OP-228 OP-236", _READ.format("", _TEN))
def plain_cards(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.lit(f"\n{'ABCD'[i]}. "), F.when(p["k"] == i, "✅ ").otherwise(""), p["o"][i])])
    return _read(files.parse_documents(_rendered(t, F.concat(p["q"], options)), "cards"))


@query("OP-225", f"SELECT doc_id, CASE WHEN number > 5 THEN number - 5 ELSE number END AS number, question, options, correct_index, CASE WHEN number > 5 THEN '2. Topic two' ELSE '1. Topic one' END AS section_label FROM ({_TEN}) t")
def topic_papers(t: Tables) -> DataFrame:
    p = _parts()
    n = F.col("p_partkey") % 10
    options = F.concat(*[x for i in range(4) for x in (F.lit(f"\n({i + 1}) "), p["o"][i])])
    head = F.when(n == 0, "1. Topic one\n-----\n").when(n == 5, "2. Topic two\n-----\n").otherwise("")
    block = F.concat(head, F.lit("Q"), (n % 5 + 1).cast("string"), F.lit(". "), p["q"], options, F.lit("\nAnswer: ("), (p["k"] + 1).cast("string"), F.lit(")"))
    return _read(files.parse_documents(_rendered(t, block), "text"), "section_label")


@query("OP-021 OP-195 OP-400 OP-401 OP-237 OP-022", f"SELECT doc_id, number, question, options, correct_index FROM ({_TEN}) t WHERE number <> 7")
def json_items(t: Tables) -> DataFrame:
    p = _parts()
    told = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"'), _letter(p["k"]), F.lit('"'))).when(F.col("p_size") % 3 == 1, (p["k"] + 1).cast("string")).otherwise(F.concat(F.lit('"'), (p["k"] + 2).cast("string"), F.lit('"')))
    # One blank option comes first, so numbers and written numbers are one higher and must move back.
    told = F.when((F.col("p_size") % 3 == 0), F.concat(F.lit('"'), F.substr(F.lit("BCDE"), p["k"] + 1, F.lit(1)), F.lit('"'))).otherwise(told)
    item = F.concat(F.lit('{"number": "'), p["n"], F.lit('", "question": '), F.to_json(F.array(p["q"])).substr(F.lit(2), F.length(F.to_json(F.array(p["q"]))) - 2), F.lit(', "options": '), F.to_json(F.concat(F.array(F.lit(" ")), p["o"])),
                    F.lit(', "correct_index": '), F.when(p["n"] == "7", "true").otherwise(told), F.lit("}"))
    docs = _rendered(t, F.concat(F.when(p["n"] == "1", "[").otherwise(","), item))
    return _read(files.parse_documents(docs.select("doc_id", F.concat("text", F.lit("]")).alias("text")), "json"))


@query("OP-239 OP-242 OP-244 OP-248 OP-252 OP-253 OP-254 OP-247 OP-390", _READ.format(", explanation", _TEN))
def html_classes(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.when(p["k"] == i, '<div class="option correct">').otherwise('<div class="option">'), F.lit(f"{'ABCD'[i]}) "), p["o"][i], F.lit("</div>"))])
    block = F.concat(F.lit('<div class="question"><p>'), p["n"], F.lit(". "), p["q"], F.lit("</p>"), options, F.lit('<div class="explanation">'), p["e"], F.lit("</div></div>"))
    return _read(files.parse_documents(_rendered(t, block, "<html><body><h1>Test</h1>"), "html"), "explanation")


@query("OP-243 OP-249 OP-251 OP-387 OP-388 OP-386 OP-389", _READ.format("", _TEN))
def html_inputs(t: Tables) -> DataFrame:
    p = _parts()
    options = F.concat(*[x for i in range(4) for x in (F.lit('<li><label><input type="radio" name="q'), p["n"], F.lit('"'), F.when(p["k"] == i, " checked").otherwise(""), F.lit(">"), p["o"][i], F.lit("</label></li>"))])
    block = F.concat(F.lit("<div><p>"), p["n"], F.lit(". "), p["q"], F.lit("</p><ul>"), options, F.lit("</ul></div>"))
    return _read(files.parse_documents(_rendered(t, block, "<html><body>"), "html"))


@query("OP-245 OP-250 OP-246", _READ.format("", _TEN))
def html_rows(t: Tables) -> DataFrame:
    p = _parts()
    cells = F.concat(*[x for i in range(4) for x in (F.when(p["k"] == i, '<td class="right">').otherwise("<td>"), p["o"][i], F.lit("</td>"))])
    block = F.concat(F.lit("<tr><td>"), p["n"], F.lit(". "), p["q"], F.lit("</td>"), cells, F.lit("</tr>"))
    return _read(files.parse_documents(_rendered(t, block, "<table><tr><th>Q</th><th>A</th><th>B</th><th>C</th><th>D</th></tr>"), "html"))


@query("OP-095 OP-347 OP-409", """
    SELECT p_partkey // 10 AS doc_id, count(*) FILTER (p_partkey % 10 <> 4) AS parsed, count(*) FILTER (p_partkey % 10 = 4) AS failed, 0::BIGINT AS other_errors, 0::BIGINT AS answer_key, count(*) AS total_detected, count(*) FILTER (p_partkey % 10 <> 4) AS answer_inline FROM part GROUP BY 1""")
def import_reports(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.when(p["n"] == "5", "").otherwise(F.concat(F.lit("\nAnswer: "), _letter(p["k"]))))
    return files.import_report(files.parse_documents(_rendered(t, block), "paper"), "doc_id")


@query("OP-350", """
    WITH d AS (SELECT p_partkey // 10 AS doc_id, string_agg((p_partkey % 10 + 1) || '. Which is ' || p_name || ' ' || p_partkey || '?' || chr(10) || '(A) ' || p_type || chr(10) || '(B) ' || p_brand || chr(10) || '(C) size ' || p_size || chr(10) || '(D) ' || p_name
                 || CASE WHEN p_partkey % 10 = 4 THEN '' ELSE chr(10) || 'Answer: ' || substr('ABCD', p_size % 4 + 1, 1) END, chr(10) ORDER BY p_partkey) AS text,
               count(*) FILTER (p_partkey % 10 <> 4)::INTEGER AS parsed, count(*) FILTER (p_partkey % 10 = 4)::INTEGER AS failed FROM part GROUP BY 1)
    SELECT 'file ' || doc_id || '.txt' AS name, sha256(text) AS sha256, 'Part ' || doc_id AS default_title, parsed, failed, CASE WHEN failed > 0 THEN ['5: no answer'] ELSE []::VARCHAR[] END AS raw_errors, parsed AS from_it FROM d""")
def file_records(t: Tables) -> DataFrame:
    p = _parts()
    block = F.concat(p["n"], F.lit(". "), p["q"], _options(p, "(?)"), F.when(p["n"] == "5", "").otherwise(F.concat(F.lit("\nAnswer: "), _letter(p["k"]))))
    number = F.col("doc_id").cast("string")
    found = _rendered(t, block).select(F.concat(F.lit("file "), number, F.lit(".txt")).alias("name"), "text", F.lit(None).cast("string").alias("caption"), F.concat(F.lit("Part "), number).alias("title"))
    from_it = F.size(F.filter("questions", lambda q: q["source_ref"] == F.col("name")))
    return files.file_entries(found, "paper").select("name", "sha256", "default_title", "report.parsed", "report.failed", "raw_errors", from_it.alias("from_it"))


@query("OP-240 OP-241", "SELECT page_id AS doc_id, 0 AS questions, 1 AS errors, 0 AS removed FROM pages")
def page_texts(t: Tables) -> DataFrame:
    """Pages of the driver hold no questions: each is read as text, and every one must give an error row rather than a failure."""
    parsed = files.parse_documents(t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "html")
    return parsed.select("doc_id", F.size("questions").alias("questions"), F.size("errors").alias("errors"), F.size("removed").alias("removed"))


@query("OP-016 OP-017 OP-018", """
    SELECT page_id, regexp_matches(lower(url), '\\.(html|htm|xhtml)$') AS html, url LIKE '%.txt' AS txt, regexp_matches(lower(url), '\\.(txt|html?|xhtml|json|pdf)$') AS importable FROM pages""")
def source_kinds(t: Tables) -> DataFrame:
    url, none = F.col("url"), F.lit(None).cast("string")
    return t.pages.select("page_id", files.looks_like_html(url, none).alias("html"), files.is_text(url, none).alias("txt"), files.is_import(url, none).alias("importable"))


def _boxed(t: Tables) -> DataFrame:
    """Ten parts a document: five on each of two pages, under a title and over a page number, and an empty third page."""
    p = _parts()
    place = F.col("p_partkey") % 10
    doc, page = F.expr("p_partkey div 10").alias("doc_id"), (F.floor(place / 5) + 1).cast("int").alias("page")
    told = F.array(F.concat(p["n"], F.lit(". "), p["q"]), *[F.concat(F.lit(f"({'ABCD'[i]}) "), p["o"][i]) for i in range(4)], F.concat(F.lit("Answer: "), _letter(p["k"])))
    box = lambda x, y, text: F.struct(x.alias("x0"), y.alias("y0"), (x + F.length(text) * 5.0).alias("x1"), (y + 10.0).alias("y1"), text.alias("text"), F.lit(10.0).alias("size"))
    lines = t.part.select(doc, page, place.alias("i"), F.posexplode(told).alias("j", "text"))
    body = lines.select("doc_id", "page", box(F.lit(40.0), 60.0 + (F.col("i") % 5 * 6 + F.col("j")) * 20.0, F.col("text")).alias("b"))
    edges = t.part.select(doc, page).distinct().select("doc_id", "page", F.explode(F.array(box(F.lit(40.0), F.lit(5.0), F.lit("Model paper")), box(F.lit(280.0), F.lit(780.0), F.concat(F.lit("Page "), F.col("page").cast("string"))))).alias("b"))
    full = files.dealt(body.unionByName(edges), "doc_id").groupBy("doc_id", "page").agg(F.collect_list("b").alias("pieces"))
    empty = t.part.select(doc).distinct().select("doc_id", F.lit(3).alias("page"), F.array().cast(boxes.PIECES.split(" ", 1)[1]).alias("pieces"))
    return full.unionByName(empty).select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "pieces")


@query("OP-019 OP-221 OP-255 OP-384", _READ.format(", page", _TEN.replace(" FROM part", ", ((p_partkey % 10) // 5 + 1)::INTEGER AS page FROM part")))
def papers_of_boxes(t: Tables) -> DataFrame:
    return _read(boxes.parse_pages(_boxed(t)), "page")


@query("OP-255", "SELECT DISTINCT p_partkey // 10 AS doc_id, 3::INTEGER AS page, 'the page has no text' AS message FROM part")
def page_problems(t: Tables) -> DataFrame:
    return files.error_rows(boxes.parse_pages(_boxed(t))).where("page = 3").select("doc_id", "page", "message")
