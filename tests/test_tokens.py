"""Lines as tokens, shapes of tokens, and that long lines cost no more than their length."""

import time

import pytest

from tallyforge.sources import marks, papers
from tallyforge.sources.tokens import ANY_WORD, Line, Shape, named, word


def kinds(text):
    return "".join("w" if k in ANY_WORD else k for k in Line(text).kinds)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12. Which", "1. x"), ("007 2024 12345 1234567890", "2 2 3 4"), ("(A) b Ⓐ क व word", "(L) L C H V x"), ("", ""), ("Question No. 3)", "w w. 1)"), ("सही  उत्तर: B", "w: L"),
        ("correct\tanswer - (2)", "w - (1)"), ("Ansari said", "wx x"), ("3-B✅", "1-L\x00"), ("x3", "x1"), ("प्रश्नसंख्या 5", "ww 1"),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_tokens_cover_the_text():
    text = "  प्रश्न - पत्र  No. 4:\t(A) x\n\n✓ é́ 3.5 "
    read = Line(text)
    assert read.begins[0] == 0 and read.ends[-1] == len(text) and read.begins[1:] == read.ends[:-1]


def test_words_are_the_longest():
    assert Shape(word("key") + "$").match("Answer   Keys") and not Shape(word("answer") + "$").match("Answer Keys")
    assert Shape(f"{word('answer')}  :  {named('tok', 'L')}").match("correct ANSWER : b")["tok"] == "b"


@pytest.mark.parametrize("answer", ["Ans. B", "Ans.: (B)", "Answer - Option B", "सही उत्तर (ख)", "उत्तर: २"[:-1] + "2", "Right Answer = [b]"])
def test_answers(answer):
    found = papers.parse(f"1. Which?\n(A) x\n(B) y\n{answer}")
    assert [q.correct_index for q in found.questions] == [1] and not found.errors


def test_options_and_answer_on_one_line():
    assert marks.expanded("(A) one (B) two (C) three Correct Answer: B") == ["(A) one", "(B) two", "(C) three Correct", "Answer: B"]
    assert marks.expanded("Pick: (A) one (B) two (C) three") == ["Pick:", "(A) one", "(B) two", "(C) three"]
    assert marks.expanded("A) one B) two") == ["A) one", "B) two"] and marks.expanded("A) note: one") == ["A) note: one"]


@pytest.mark.parametrize("filler", ["word 3 ", "3-B, ", "(A) x ", "Answer ", "प्रश्न 3 "])
def test_long_lines(filler):
    """Two million characters on one line, in time that grows as they do."""
    took = []
    for size in (500_000, 2_000_000):
        line = filler * (size // len(filler))
        began = time.process_time()
        found = papers.parse(f"1. Which?\n{line}\n(A) x\n(B) y\nAnswer: A")
        took.append(time.process_time() - began)
        assert len(found.questions) + len(found.errors) >= 1
    assert took[1] < 30 and took[1] < 12 * max(took[0], 0.2)
