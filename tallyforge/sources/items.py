"""Questions in JSON: arrays, objects with questions or quizzes, arrays inside other text. Each item is taken or refused with a reason."""

from __future__ import annotations

import json
import re

from . import marks as M
from . import papers
from .marks import Parsed, Problem, Question

#: Letters that name an option.
LETTERS = {**{c: i for i, c in enumerate("ABCDEF")}, **{c: i for i, c in enumerate("अबसद")}}


def _first(item: dict, *keys: str) -> object:
    return next((item[k] for k in keys if item.get(k)), None)


def _text(x: object) -> str:
    return "" if x is None else str(x).strip()


def item_number(item: object, place: int) -> int:
    raw = item.get("number") if isinstance(item, dict) else None
    told = _text(raw)
    return int(told) if re.fullmatch(r"[+-]?\d+", told) and not isinstance(raw, bool) else place


def answer_index(item: dict, n: int) -> int | None:
    """0-based place of the answer among n options: a number counts from 0, a written number from 1, a letter as it is; anything else is none."""
    told = item.get("correct_index")
    if told is None:
        told = item["answer_index"] if "answer_index" in item else item.get("correct")
    if isinstance(told, str):
        t = told.strip().upper()
        told = LETTERS.get(t, (int(t) - 1 if 1 <= int(t) <= n else int(t)) if t.isdigit() else None)
    return told if isinstance(told, int) and not isinstance(told, bool) and 0 <= told < n else None


def read_item(item: object, place: int) -> Question | str:
    """The question of an item, or why there is none. Blank options go after the answer is found, so they can't move it."""
    if not isinstance(item, dict):
        return "not an object"
    text = _text(_first(item, "question", "q", "stem"))
    if not text:
        return "no question"
    raw = _first(item, "options", "choices") or []
    if not isinstance(raw, list):
        return "options are no list"
    options = [_text(o) for o in raw]
    answer = answer_index(item, len(options))
    if answer is None:
        return "no answer, or one beyond the options"
    if not options[answer]:
        return "the answer is a blank option"
    kept = [o for o in options if o]
    if not M.MIN_OPTIONS <= len(kept) <= M.MAX_OPTIONS:
        return f"{len(kept)} options"
    place_of = sum(bool(o) for o in options[:answer])
    return Question(item_number(item, place), text, kept, place_of, _text(_first(item, "explanation", "solution")), "mcq", "json", 0, _text(item.get("section")), _text(item.get("pre_text")))


def parse(raw: str) -> tuple[str, Parsed]:
    """Title and questions of a JSON file; of several quizzes only the first is read, the others are told."""
    out = Parsed()
    try:
        data = json.loads(raw or "")
    except ValueError:
        out.errors.append(Problem(None, "no JSON"))
        return "", out
    title, items = "", data
    if isinstance(data, dict):
        title = _text(_first(data, "title", "name"))
        items = data.get("questions")
        quizzes = data.get("quizzes")
        if not isinstance(items, list) and isinstance(quizzes, list) and quizzes:
            first = quizzes[0] if isinstance(quizzes[0], dict) else {}
            title, items = title or _text(first.get("title")), first.get("questions")
            if len(quizzes) > 1:
                out.errors.append(Problem(None, f"{len(quizzes) - 1} more quizzes were not read"))
    for place, item in enumerate(items if isinstance(items, list) else [], 1):
        found = read_item(item, place)
        if isinstance(found, Question):
            out.questions.append(found)
        else:
            out.errors.append(Problem(item_number(item, place), found))
    if not out.questions and not out.errors:
        out.errors.append(Problem(None, "no questions"))
    return title, out


def array_in(text: str | None) -> list | None:
    """A JSON array in a text: fenced, as it is, in an object, or between the outermost brackets."""
    body = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", body, re.DOTALL | re.IGNORECASE)
    body = fence[1].strip() if fence else body
    for part in (body, body[body.find("[") : body.rfind("]") + 1] if "[" in body else ""):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        found = found.get("questions") if isinstance(found, dict) else found
        if isinstance(found, list):
            return found
    return None


def from_reply(text: str | None) -> Parsed:
    """Questions of a free reply: its JSON if there is any, else the text as a paper."""
    found = array_in(text)
    return parse(json.dumps(found))[1] if found is not None else papers.parse(text)
