"""Lines of papers as tokens: one pass over a line finds listed words, numbers, labels and signs; rules are shapes of tokens.

A line becomes a string with one character for each token, its kinds: what follows costs no more than a search in that
string, however long the line is. Listed words are found by one automaton over all lists, in any case of letters; a
space in a listed word stands for any white space or none, and a full stop behind one is a sign of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, wraps
from itertools import product
from typing import TypeVar

import ahocorasick

from ..functions.text import CIRCLED_LOW, CIRCLED_NUMBER, CIRCLED_UP, HINDI, HINDI_ABSD, LETTERS

T = TypeVar("T")
_KEY_NOUNS = ("कुंजी", "कुञ्जी", "कुंजिका", "माला", "सूची", "तालिका", "संकेत")
# Words of question papers, by what they tell.
WORDS: dict[str, tuple[str, ...]] = {
    "question": ("प्रश्न", "प्र .", "Question", "Ques", "Que", "Q"),
    "short question": ("प्रश्न", "Q", "Question"),
    "page question": ("प्रश्न", "Question", "Ques", "Que", "Q"),
    "topic question": ("Q",),
    "number": ("सं", "संख्या", "No"),
    "answer": ("सही उत्तर", "सही विकल्प", "उत्तर", "Correct Answer", "Correct Option", "Correct Ans", "Right Answer", "Answer", "Ans"),
    "answer line": ("उत्तर", "Answer", "Ans", "सही उत्तर"),
    "told": ("उत्तर", "Answer"),
    "option": ("Option", "विकल्प"),
    "and": ("और", "तथा", "एवं", "and"),
    "explanation": ("व्याख्या", "स्पष्टीकरण", "विवरण", "हल", "Explanation", "Expl", "Exp", "Solution", "Sol"),
    "page note": ("व्याख्या", "उत्तर व्याख्या", "हल", "Explanation", "Solution", "Sol", "Reason", "Analysis"),
    "card note": ("Ex", "Explanation"),
    "key": (
        "answer key", "answer keys", "answer sheet", "answers sheet", "answers", "ans key", "ans. key", "key answer", "key answers", "सही उत्तर सूची", "सही उत्तर तालिका",
        *(f"उत्तर {dash}{noun}" for dash in ("", "- ", "– ") for noun in _KEY_NOUNS),
    ),
    "part": ("भाग", "खण्ड", "खंड", "Section", "Part"),
    "section": ("भाग", "खण्ड", "खंड", "अनुभाग", "Section", "Part", "शिफ्ट", "Shift", "पाली", "सत्र", "Session", "Set", "सेट", "Paper", "पेपर", "प्रश्न पत्र", "प्रश्न - पत्र"),
    "page": ("Page", "पृष्ठ"),
    "of": ("of", "का"),
    "page edge": ("Page", "पृष्ठ", "पेज"),
    "of edge": ("of", "का", "में से"),
    "call": ("join", "follow", "subscribe", "download", "visit", "contact", "जुड़ें", "जुड़े", "जुड़िए", "ज्वाइन", "जॉइन", "फॉलो", "सब्सक्राइब", "डाउनलोड", "संपर्क"),
    "passage": ("Direction", "Directions", "Passage", "Comprehension", "Case Study"),
    "read": ("Read", "Study", "Refer to", "Consider", "Examine", "Go through"),
    "range": ("प्रश्न", "Q", "Question", "Questions", "Qs", "No", "Nos"),
    "to": ("से", "to", "तक", "and", "एवं"),
    "case": ("केस", "Case"),
    "topic": ("Topic",),
}
#: A letter that is also a word for "and".
AND_LETTER = "व"
OPEN, CLOSE, DASHES = "([", ")]", "-–—‒―−·•∙"
CIRCLES = CIRCLED_UP + CIRCLED_LOW + CIRCLED_NUMBER
MOST_LABEL = 12
#: Signs that shapes name; all others are of one kind.
SIGNS = frozenset("()[]{}.,:;=+&/#।：" + DASHES)
OTHER = "\x00"
#: So many lines of at most so many characters stay read, and of longer ones the last few.
KEPT_LINE, KEPT_LINES, KEPT_LONG = 1000, 1 << 14, 2
#: Of so many lines stays what rules made of several shapes told: a document's lines are asked again and again, those of others seldom.
KEPT_TOLD = 1 << 12

_ascii_letters, _hindi_letters = frozenset(LETTERS + LETTERS.lower()), frozenset(HINDI + HINDI_ABSD)
_circles = "".join(f"{s[0]}-{s[-1]}" for s in (CIRCLED_UP, CIRCLED_LOW, CIRCLED_NUMBER))
_piece = re.compile(rf"(\s+)|(\d+)|([{_circles}])|((?:[^\W\d_{_circles}]|[ऀ-ॣ॰-ॿ̀-ͯ])+)|(.)", re.DOTALL)
_blank = re.compile(r"\s+")


def joins(c: str) -> bool:
    """Whether a character goes on a word: Latin letters, digits, Devanagari."""
    return "0" <= c <= "9" or "a" <= c <= "z" or "A" <= c <= "Z" or "ऀ" <= c <= "ॿ"


def _kinds_of_words() -> tuple[dict[str, str], dict[str, str]]:
    """A kind for each set of lists that a word is in: by spelling, and all kinds of a list by its name."""
    lists: dict[str, set[str]] = {}
    for name, words in WORDS.items():
        for word in words:
            for gaps in product(("", " "), repeat=word.count(" ")):
                pieces = word.lower().split(" ")
                lists.setdefault("".join(p + g for p, g in zip(pieces, [*gaps, ""], strict=True)), set()).add(name)
    kinds = {names: chr(0xE000 + i) for i, names in enumerate(sorted({tuple(sorted(x)) for x in lists.values()}))}
    return {spelled: kinds[tuple(sorted(x))] for spelled, x in lists.items()}, {name: "".join(k for names, k in kinds.items() if name in names) for name in WORDS}


_spelled, _listed = _kinds_of_words()
_automaton = ahocorasick.Automaton()
for _word, _kind in _spelled.items():
    _automaton.add_word(_word, (len(_word), _kind))
_automaton.make_automaton()


def word(name: str) -> str:
    """The class of kinds that a list's words have, for shapes."""
    return f"[{_listed[name]}]"


ANY_WORD = "".join(sorted(set(_spelled.values())))
#: Kinds, for shapes: numbers of up to four digits and of up to nine, labels, letters, and what goes on a word.
NUMBER, LONG_NUMBER, LETTER, LABEL, CIRCLED_LABEL = "[12]", "[123]", "[LHV]", "[1LHV]", "[1LHVC]"
GOES_ON = f"[1234LHVx{ANY_WORD}]"


class Line:
    """kinds: a character for each token, a space for white space; begins and ends: where each stands in the text.

    1 is a number that can label an option, 2 another of up to four digits, 3 of up to nine, 4 a longer one; L a Latin
    letter by itself, H and V Devanagari ones, C one in a circle; x other letters; a sign stands for itself.
    """

    __slots__ = ("begins", "ends", "kinds", "text")

    def __init__(self, text: str):
        low = text.lower()
        low = low if len(low) == len(text) else text
        found: dict[int, tuple[int, str]] = {}
        flat, back = _flat(low)
        for last, (size, kind) in _automaton.iter(flat):
            begin, end = last - size + 1, last + 1
            if back:
                begin, end = back[begin], back[last] + 1
            if begin not in found or found[begin][0] < end:
                found[begin] = (end, kind)
        kinds, begins, ends, at = [], [], [], 0
        while at < len(text):
            m = _piece.match(text, at)
            what, end = m.lastindex, m.end()
            if what == 1:
                kind = " "
            elif what == 2:
                kind = _number_kind(m[0])
            elif what == 3:
                kind = "C"
            elif at in found and (what == 4 or found[at][0] > end):
                end, kind = found[at]
            elif what == 4:
                kind = _letter_kind(m[0])
            else:
                kind = m[0] if m[0] in SIGNS else OTHER
            kinds.append(kind)
            begins.append(at)
            ends.append(end)
            at = end
        self.text, self.kinds, self.begins, self.ends = text, "".join(kinds), begins, ends

    def place(self, token: int) -> int:
        """Where a token begins, or the text ends."""
        return self.begins[token] if token < len(self.begins) else len(self.text)

    def of(self, m: re.Match, name: str) -> str:
        """The text of the tokens that a named part of a shape took."""
        a, b = m.span(name)
        return self.text[self.place(a) : self.place(b)]

    def after(self, m: re.Match) -> int:
        """Where the text goes on behind a shape and white space."""
        at = m.end()
        return self.place(at + (self.kinds[at : at + 1] == " "))


def _flat(low: str) -> tuple[str, list[int] | None]:
    """A text with single spaces, and where its characters stood, if any moved."""
    plain = " ".join(low.split())
    if plain == low:
        return low, None
    if len(plain) == len(low.strip()) and low.strip() == plain:
        lead = len(low) - len(low.lstrip())
        return plain, range(lead, lead + len(plain))
    back, out, at = [], [], 0
    for m in _blank.finditer(low):
        out += [low[at : m.start()], " "]
        back += [*range(at, m.start()), m.start()]
        at = m.end()
    out.append(low[at:])
    back += range(at, len(low))
    return "".join(out), back


def _number_kind(digits: str) -> str:
    if len(digits) > 4:
        return "3" if len(digits) <= 9 else "4"
    return "1" if digits.isascii() and digits[0] != "0" and int(digits) <= MOST_LABEL else "2"


def _letter_kind(run: str) -> str:
    if len(run) > 1:
        return "x"
    return "V" if run == AND_LETTER else "L" if run in _ascii_letters else "H" if run in _hindi_letters else "x"


_kept, _long = lru_cache(maxsize=KEPT_LINES)(Line), lru_cache(maxsize=KEPT_LONG)(Line)


def line(text: str) -> Line:
    return (_kept if len(text) <= KEPT_LINE else _long)(text)


_NUMBERS = frozenset(("num", "last"))


class Shape:
    """A shape of tokens. Where it is written with two blanks, white space may stand, and one blank is white space that must.

    match, for the beginning of a line, and find, for any place, give what the named parts took: num as a number, all
    others as text, with where the shape begins (at) and ends (end) and what follows it (rest, from rest_at on).
    """

    def __init__(self, shape: str, check=None):
        self.pattern, self.check = re.compile(shape.replace("  ", " ?"), re.DOTALL), check
        self._kept = lru_cache(maxsize=KEPT_LINES)(self._match)

    def _told(self, tokens: Line, m: re.Match | None) -> dict | None:
        if m is None:
            return None
        out = self._parts(tokens, m)
        out |= {"line": tokens.text, "rest": tokens.text[out["rest_at"] :]}
        return out if self.check is None or self.check(out) else None

    def _parts(self, tokens: Line, m: re.Match) -> dict:
        out = {"at": tokens.place(m.start()), "end": tokens.ends[m.end() - 1] if m.end() else 0, "rest_at": tokens.after(m)}
        for name in self.pattern.groupindex:
            if m.start(name) >= 0:
                found = tokens.of(m, name)
                out[name] = int(found) if name in _NUMBERS else found
        return out

    def match(self, text: str) -> dict | None:
        return self._kept(text) if len(text) <= KEPT_LINE else self._match(text)

    def _match(self, text: str) -> dict | None:
        tokens = line(text)
        return self._told(tokens, self.pattern.match(tokens.kinds))

    def find(self, text: str) -> dict | None:
        tokens = line(text)
        return self._told(tokens, self.pattern.search(tokens.kinds))

    def every(self, text: str) -> list[dict]:
        """What all places in a text have, without what follows them."""
        tokens = line(text)
        return [self._parts(tokens, m) for m in self.pattern.finditer(tokens.kinds)]


def remembered(rule: Callable[[str], T]) -> Callable[[str], T]:
    """A rule over one line that is not worked out anew for a line of late, unless it is long."""
    kept = lru_cache(maxsize=KEPT_TOLD)(rule)
    return wraps(rule)(lambda text: kept(text) if len(text) <= KEPT_LINE else rule(text))


def maybe(shape: str) -> str:
    """A part that may be left out, with white space behind it."""
    return f"(?:{shape}  )?"


def signs(those: str) -> str:
    return f"[{re.escape(those)}]"


def named(name: str, shape: str) -> str:
    return f"(?P<{name}>{shape})"
