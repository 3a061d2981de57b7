"""Text functions over the driver's documents, pages and names: queries and their DuckDB twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions import payloads as P
from ..functions import scores as S
from ..functions import text as X
from ..operators import access, dedup
from .registry import query

_WS = r"[\s\x{A0}\x{0B}]"


@query("OP-180 OP-159 OP-189", """
    SELECT doc_id, array_to_string([trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) FOR x IN string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), ' '), chr(10))], chr(10)) AS text,
           length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM documents""")
def cleaned_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_lines(F.col("text")).alias("text"), X.utf16_length(F.col("text")).cast("long").alias("units"))


@query("OP-191 OP-099 OP-192 OP-220", """
    WITH w AS (SELECT doc_id, [x FOR x IN [trim(y, '.,;:!?()[]{}"''।॥|-–—‘’“”') FOR y IN regexp_split_to_array(text, '\\s+')] IF x <> ''] AS words FROM documents)
    SELECT doc_id, len(words)::INTEGER AS words, list_distinct(words).len()::INTEGER AS distinct_words, 0 AS invalid, len([x FOR x IN words IF regexp_matches(x, '[\\x{900}-\\x{97F}]')])::INTEGER AS devanagari FROM w""")
def document_words(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", X.words(F.col("text")).alias("w"))  # once, for all that is counted
    known = F.size(F.filter("w", lambda w: w.rlike(f"[{X.DEVANAGARI}]")))
    return found.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"), F.size(X.invalid_among(F.col("w"))).alias("invalid"), known.alias("devanagari"))


@query("OP-100", """
    WITH b AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS body FROM documents)
    SELECT doc_id, CASE WHEN body = '' THEN 'empty' WHEN 50 * length(regexp_replace(body, '[^\\x{E000}-\\x{F8FF}\\x{FFFD}]', '', 'g')) > length(body) THEN 'glyphs' END AS problem FROM b""")
def text_problems(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.text_quality(F.col("text")).alias("problem"))


@query("OP-193 OP-238 OP-162 OP-163", """
    WITH l AS (SELECT page_id, string_split('[' || page_id || '/9] ' || url || chr(10) || chr(10) || '  by   @user' || page_id || ' ' || html, chr(10)) AS lines FROM pages),
    c AS (SELECT page_id, [trim(regexp_replace(regexp_replace(regexp_replace(x, '(?:https?://|t\\.me/)\\S+', '', 'gi'), '(^|\\W)@[A-Za-z0-9_]{3,32}\\b', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g')) FOR x IN list_concat([regexp_replace(lines[1], '^\\[\\s*\\d+\\s*/\\s*\\d+\\s*\\]', '')], lines[2:])] AS lines FROM l)
    SELECT page_id, array_to_string([x FOR x IN lines IF x <> ''], chr(10)) AS text FROM c""")
def smart_cleaned(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("/9] "), F.col("url"), F.lit("\n\n  by   @user"), F.col("page_id").cast("string"), F.lit(" "), F.col("html"))
    return t.pages.select("page_id", X.clean_text(raw, links=True, handles=True).alias("text"))


@query("OP-098", """
    WITH c AS (SELECT item_id, unnest(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) AS ch FROM benchmark) SELECT item_id, ch, count(*)::INTEGER AS n FROM c GROUP BY ALL""")
def character_bags(t: Tables) -> DataFrame:
    return X.character_bags(t.benchmark, "item_id", "text")


@query("OP-101", """
    WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT source, doc_id, regexp_replace(regexp_replace(lower(trim(line)), '\\s+', ' ', 'g'), '\\d+', '#', 'g') AS key FROM l),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1), c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k GROUP BY ALL)
    SELECT c.source, c.key, c.n FROM c JOIN p USING (source) WHERE c.n >= greatest(2, ceil(p.pages / 20.0))""")
def repeated_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    pages = t.documents.groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    counts = lines.groupBy("source", X.line_key(F.col("line")).alias("key")).agg(F.countDistinct("doc_id").alias("n"))
    return counts.join(pages, "source").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 20))).select("source", "key", "n")


@query("OP-138", """
    SELECT a.turn, a.conv_id, list_sort([x FOR x IN list_distinct(string_split(a.text, ' ')) IF NOT list_contains(string_split(b.text, ' '), x)]).len()::INTEGER AS n
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def uncertain_words(t: Tables) -> DataFrame:
    a, b = t.conversations, t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).select("turn", "conv_id", F.size(F.array_except(F.split("text", " "), F.split("other", " "))).alias("n"))


def _timers(lines: DataFrame) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    n, k = q.cast("string"), F.col("l_linenumber") % 6
    told = F.when(k == 0, F.concat(n, F.lit(" सेकंड"))).when(k == 1, F.concat(n, F.lit(" Min"))).when(k == 2, F.concat(n, F.lit("m 30s"))).when(k == 3, F.concat(n, F.lit(":05"))).when(k == 4, "No  Timer").otherwise(F.concat(n, F.lit(" hours")))
    return lines.select("l_orderkey", "l_linenumber", q.alias("q"), X.parse_timer(told).alias("seconds"), S.timer_label(q).alias("label"))


@query("OP-024 OP-156 OP-211", """
    WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q, l_linenumber % 6 AS k FROM lineitem),
    v AS (SELECT *, CASE k WHEN 0 THEN q WHEN 1 THEN q * 60 WHEN 2 THEN q * 60 + 30 WHEN 3 THEN q * 60 + 5 WHEN 4 THEN 0 END AS raw FROM s)
    SELECT l_orderkey, l_linenumber, q, CASE WHEN k = 5 THEN NULL WHEN raw = 0 THEN 0 WHEN raw BETWEEN 5 AND 3600 THEN raw END AS seconds,
        CASE WHEN q < 60 OR q = 90 THEN q || ' sec' WHEN q % 60 = 0 THEN (q // 60) || ' min' ELSE (q // 60) || ' min ' || (q % 60) || ' sec' END AS label FROM v""")
def timers(t: Tables) -> DataFrame:
    return _timers(t.lineitem)


@query("OP-206 OP-149 OP-367", """
    SELECT c_custkey, list_sort(list_distinct([c_custkey, -c_nationkey::BIGINT, 7])) AS ids, [c_custkey, -5] AS chats FROM customer""")
def number_lists(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    raw = F.concat(s("c_custkey"), F.lit("; x,-"), s("c_nationkey"), F.lit(",7 ;7,,"))
    return t.customer.select("c_custkey", access.id_set(raw).alias("ids"), access.number_list(F.concat(F.lit('["a",'), s("c_custkey"), F.lit(',"-5",1.5]'))).alias("chats"))


@query("OP-148 OP-147 OP-368", """
    SELECT id, CASE WHEN lower(trim(section)) = 'economy' THEN 45 WHEN lower(trim(section)) = 'promo' THEN position ELSE 30 END AS timer FROM questions""")
def question_timers(t: Tables) -> DataFrame:
    told = X.section_timers(F.lit('{"Economy ": 45, " ": 9}'))
    stored = F.map_concat(told, F.create_map(F.lit("promo"), F.col("position")))  # a time out of range can be in a map that was stored before, it is only never added
    timers = F.coalesce(X.with_timer(told, F.lit("PROMO"), F.col("position")), stored)
    return t.questions.select("id", X.question_timer(timers, F.col("section"), F.lit(30)).alias("timer"))


@query("OP-184 OP-185 OP-186", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 12 WHEN 1 THEN p_size % 12 WHEN 2 THEN p_size % 12 END::INTEGER AS index, substr('ABCDEFGHIJKL', p_size % 12 + 1, 1) AS label FROM part""")
def option_tokens(t: Tables) -> DataFrame:
    i, k = F.col("p_size") % 12, F.col("p_partkey") % 4
    at = lambda s: F.substr(F.lit(s), i + 1, F.lit(1))
    token = F.when(k == 0, at(X.LETTERS.lower())).when(k == 1, F.when(i % 2 == 0, at(X.HINDI)).otherwise(at(X.CIRCLED_NUMBER))).when(k == 2, (i + 1).cast("string")).otherwise(F.lit("Z"))
    return t.part.select("p_partkey", X.token_index(token).alias("index"), X.option_label(i).alias("label"))


@query("OP-166 OP-167 OP-168 OP-127 OP-126", """
    WITH p AS (SELECT p_partkey, p_size % 4 AS c, [(i + p_partkey) % 4 FOR i IN [0, 1, 2, 3]] AS perm, ['a', 'b', 'c', 'd'] AS opts FROM part)
    SELECT p_partkey, list_position(perm, c)::INTEGER - 1 AS shown, c::INTEGER AS back, array_to_string([opts[i + 1] FOR i IN perm], '') AS options FROM p""")
def permutations(t: Tables) -> DataFrame:
    perm = F.transform(F.array(*map(F.lit, range(4))), lambda i: ((i + F.col("p_partkey")) % 4).cast("int"))
    shown = X.display_correct(perm, (F.col("p_size") % 4).cast("int"))
    return t.part.select("p_partkey", shown.alias("shown"), X.original_choice(perm, shown).alias("back"), F.array_join(X.permuted(F.array(*map(F.lit, "abcd")), perm), "").alias("options"))


@query("OP-126 OP-127", "SELECT o_custkey, list(o_orderkey ORDER BY md5('7:' || o_orderkey), o_orderkey) AS mixed, list(o_orderkey ORDER BY o_orderkey) AS plain FROM orders GROUP BY o_custkey")
def seeded_orders(t: Tables) -> DataFrame:
    ids = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return ids.select("o_custkey", X.seeded_order(F.col("ids"), F.lit(7), F.lit(True)).alias("mixed"), X.seeded_order(F.col("ids"), F.lit(7), F.lit(False)).alias("plain"))


@query("OP-175 OP-176 OP-177", """
    SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 AND o_orderkey % 3 > 0 THEN o_orderkey::VARCHAR END AS quiz, 'https://t.me/b?start=quiz_' || o_orderkey AS link, 'https://t.me/b?startgroup=quiz_' || o_orderkey AS group_link FROM orders""")
def start_links(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    arg = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("quiz-"), k)).otherwise(F.concat(F.lit(" quiz_"), k, F.lit(" ")))
    return t.orders.select("o_orderkey", X.start_payload(arg).alias("quiz"), X.deep_link(F.lit("b"), k).alias("link"), X.deep_link(F.lit("b"), k, True).alias("group_link"))


@query("OP-157 OP-158", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS utc, strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M IST') AS local FROM orders")
def local_times(t: Tables) -> DataFrame:
    utc, local = X.utc_and_local(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", utc.alias("utc"), local.alias("local"))


@query("OP-202", "SELECT user_id, coalesce(nullif(trim(first_name), '') || ' (@' || nullif(trim(username), '') || ')', nullif(trim(first_name), ''), '@' || nullif(trim(username), ''), 'User ' || user_id) || ' · ID ' || user_id AS label FROM users")
def user_labels(t: Tables) -> DataFrame:
    return t.users.select("user_id", S.user_label(F.col("username"), F.col("first_name"), F.col("user_id")).alias("label"))


@query("OP-164 OP-199 OP-194 OP-405 OP-407", """
    SELECT id, CASE WHEN source_number > 0 AND source_number <> position THEN source_number END AS src, CASE WHEN source_number > 0 THEN source_number ELSE position END AS number,
           CASE WHEN coalesce(section, '') <> '' THEN section || ' – Q' || position ELSE 'Q' || position END AS ref FROM questions""")
def question_numbers(t: Tables) -> DataFrame:
    from ..operators.reports import number_of

    c = F.col
    ref = F.when(F.coalesce("section", F.lit("")) != "", F.concat("section", F.lit(" – Q"), c("position").cast("string"))).otherwise(F.concat(F.lit("Q"), c("position").cast("string")))
    return t.questions.select("id", X.source_number(c("source_number"), c("position") - 1).alias("src"), number_of(c("source_number"), c("position")).alias("number"), ref.alias("ref"))


@query("OP-188 OP-399", """
    SELECT item_id, CASE WHEN regexp_matches(text, '(?i)assertion') THEN 'assertion_reason' WHEN regexp_matches(text, '(?i)arrange|ascending|descending|chronological|sequence|order') THEN 'ordering'
        WHEN regexp_matches(text, '(?i)statement') THEN 'statement' WHEN regexp_matches(text, '(?i)\\b(except|not|incorrect|false|wrong)\\b') THEN 'negative' ELSE 'mcq' END AS qtype FROM benchmark""")
def question_types(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.question_type(F.col("text")).alias("qtype"))


@query("OP-205 OP-267", """
    SELECT c_custkey, 'token=*** and *** ' || c_name AS masked, CASE WHEN c_custkey % 2 = 0 THEN 'field password' ELSE '' END AS found FROM customer""")
def secrets(t: Tables) -> DataFrame:
    from ..operators.snapshot import secret_fields

    text = F.concat(F.lit("token=abc"), F.col("c_custkey").cast("string"), F.lit(" and 123456789:ABCDEFGHIJKLMNOPQRSTUVWX "), F.col("c_name"))
    doc = F.when(F.col("c_custkey") % 2 == 0, '{"password": 1}').otherwise('{"passwords": 1}')
    return t.customer.select("c_custkey", X.mask_secrets(text).alias("masked"), F.array_join(secret_fields(doc), ",").alias("found"))


@query("OP-134 OP-135 OP-136", """
    WITH n AS (SELECT p_partkey, p_type, p_size % 5 AS k FROM part), b AS (SELECT a.p_partkey, CASE WHEN a.k <> b.k THEN 'different' WHEN lower(a.p_type) <> lower(b.p_type) THEN 'different' ELSE 'same' END AS relation FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1)
    SELECT * FROM b""")
def topic_relations(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Topic 0"), (F.col("p_size") % 5).cast("string"), F.lit(" "), F.col("p_type"))
    key = dedup.topic_key(name)
    rows = t.part.select("p_partkey", F.struct(F.lit("").alias("caption"), dedup.topic_number(name).alias("number"), key.alias("key"), dedup.topic_words(key).alias("words")).alias("i"))
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("i").alias("j"))
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("caption", "number", "key", "words")}
    return rows.join(other, "p_partkey").select("p_partkey", dedup.topic_relation(side("i"), side("j")).alias("relation"))


_LAST = lambda sign: f"CASE WHEN contains(piece, {sign}) THEN length(piece) - strpos(reverse(piece), {sign}) ELSE -1 END"


@query("OP-161 OP-160", f"""
    WITH RECURSIVE r AS (
        SELECT doc_id, text, 0::BIGINT AS begun, 0::BIGINT AS size, 0 AS n FROM documents WHERE text IS NOT NULL
        UNION ALL
        SELECT doc_id, text, begun, CASE WHEN length(text) - begun <= 300 THEN length(text) - begun WHEN line > 100 THEN line + 1 WHEN space > 100 THEN space + 1 ELSE 300 END, n + 1
        FROM (SELECT *, {_LAST("chr(10)")} AS line, {_LAST("' '")} AS space FROM (SELECT doc_id, text, begun + size AS begun, n, substr(text, begun + size + 1, 300) AS piece FROM r WHERE n = 0 OR begun + size < length(text)) x) y
    )
    SELECT doc_id, list(size ORDER BY n) AS sizes, true AS whole FROM r WHERE n > 0 GROUP BY doc_id""")
def message_chunks(t: Tables) -> DataFrame:
    """The lengths of a text's messages, and whether they are the text together."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: P.chunks(x, 300))

    parts = t.documents.where("text IS NOT NULL").select("doc_id", "text", split("text").alias("parts"))
    return parts.select("doc_id", F.transform("parts", lambda p: F.length(p).cast("long")).alias("sizes"), (F.array_join("parts", "") == F.col("text")).alias("whole"))


@query("OP-169 OP-170 OP-171 OP-165", """
    SELECT id, CASE WHEN source_number > 0 AND source_number <> position THEN '[Q' || source_number || ' · ' || position || '/99] ' ELSE '[' || position || '/99] ' END || question AS question,
           (CASE WHEN correct_index = 0 THEN 3 ELSE correct_index - 1 END)::INTEGER AS correct, 4 AS options, false AS compact FROM questions""")
def poll_payloads(t: Tables) -> DataFrame:
    @F.pandas_udf(P.PAYLOAD)
    def build(question: pd.Series, correct: pd.Series, index: pd.Series, number: pd.Series) -> pd.DataFrame:
        told = [None if pd.isna(n) else int(n) for n in number]
        rows = [P.as_row(P.payload(q, ["one", "two", "three", "four"], int(c), [1, 2, 3, 0], int(i), 99, n)) for q, c, i, n in zip(question, correct, index, told, strict=True)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in P.PAYLOAD.split(", ")])

    rows = t.questions.select("id", build("question", "correct_index", F.col("position") - 1, "source_number").alias("p"))
    return rows.select("id", "p.question", "p.correct", F.size("p.options").alias("options"), "p.compact")
