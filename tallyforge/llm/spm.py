"""SentencePiece encoding and decoding by a shared-prefix Viterbi search over a trie of distinct words.

Texts fall into marked words: the word mark for each space before, then what goes on to the next space. The distinct
ones of a batch are sorted, which is the depth-first order of their trie, and each is searched from where it leaves
its predecessor: forward states of the common prefix are kept on a stack.

The model is a byte-pair one, whose result is not the path of the best sum of scores. It is the one path in which
each two neighbours stay apart when they are merged alone, so a transition weighs 0 if its pair stays apart and minus
infinity if not; then one state at most survives for each prefix, and the path is what merging by rank gives. Whether
a pair stays apart is found once, by merging it. Characters outside the vocabulary become bytes.

Defined cases: null stays null, with 0 tokens; the empty text has none; decoding the ids of a text gives the text,
in which U+2581 is read as a space, as the model itself does; equal texts give equal ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and tested pairs kept from batch to batch, and characters of text worked on at once; all only bound memory.
KEPT_WORDS, KEPT_PAIRS, SLICE = 400_000, 300_000, 2_000_000


class State(dict):
    """A piece as the end of a path: which pieces may follow it (their states, or False for those that may not)."""

    __slots__ = ("code", "text")

    def __init__(self, text: str, code: bytes):
        self.text, self.code = text, code


class Pieces:
    """The vocabulary, and the search over it."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        #: Ids are kept as bytes of this width.
        self.type = np.dtype("<u2" if m.get_piece_size() <= 1 << 16 else "<u4")
        self.score, self.states, self.bytes, self.out = {}, {}, {}, []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.out.append(b"" if m.is_control(i) else " ⁇ ".encode())
            else:
                self.score[piece], self.states[piece] = m.get_score(i), State(piece, i.to_bytes(self.type.itemsize, "little"))
                self.out.append(piece.replace(MARK, " ").encode())
        #: The begin of a word, and characters that are no pieces but lie in some.
        self.start = State("", b"")
        self.parts = {c: State(c, self._spelled(c)) for c in {c for p in self.score for c in p} if c not in self.score}
        self.split = re.compile(self._words()).findall
        self.pairs = 0
        self.tails: dict[str, tuple[int, ...]] = {}
        for piece in self.score:  # lengths of the pieces that end in a character, likely ones first
            self.tails.setdefault(piece[-1], set()).add(len(piece))
        self.tails = {c: tuple(sorted(n, key=lambda x: abs(x - 2.6))) for c, n in self.tails.items()}
        self.words: dict[str, bytes] = {}

    def _words(self) -> str:
        """The pattern of words: between two of them no piece can lie, so each is encoded by itself."""
        if any("\n" in p for p in self.score if len(p) > 1) or any(MARK in p.lstrip(MARK) for p in self.score):
            return "(?s).+"
        inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(a.isalnum() != b.isalnum() for a, b in inner if a != MARK):
            return f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        return rf"{MARK}*(?:[^\W_]+|(?:_|[^\w{MARK}\n])+)|{MARK}+|\n"  # letters and signs share no piece

    def _spelled(self, char: str) -> bytes:
        return b"".join(self.bytes.get(b, 0).to_bytes(self.type.itemsize, "little") for b in char.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> list[str]:
        """What merging by rank makes of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follow(self, left: State, piece: str) -> State | bool:
        """The state of a piece after left, False if they don't stay apart; left keeps it."""
        if self.pairs >= KEPT_PAIRS:
            self.forget_pairs()
        self.pairs += 1
        apart = self.merged(left.text + piece) == ([left.text, piece] if left.text else [piece])
        left[piece] = self.states[piece] if apart else False
        return left[piece]

    def forget_pairs(self) -> None:
        for known in ([self.start], self.states.values(), self.parts.values()):
            for state in known:
                state.clear()
        self.pairs = 0

    def learn(self, words: set[str]) -> None:
        """Adds the ids of new words to self.words, by depth-first search of their trie.

        ends[p] is the state that survives at position p, begin[p] where its piece begins, and code[p] its ids.
        """
        ids, tails, states, start = self.words, self.tails.get, self.states, self.start
        ends, begin, code, before = [start], [0], [b""], ""
        for word in sorted(words):
            n, keep = len(word), 0
            most = min(n, len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del ends[keep + 1 :], begin[keep + 1 :], code[keep + 1 :]
            for p in range(keep + 1, n + 1):
                for size in tails(word[p - 1], ()):
                    if size <= p:
                        q = p - size
                        left, piece = ends[q], word[q:p]
                        state = left.get(piece)
                        if state is None:
                            if piece not in states:
                                continue
                            state = self.follow(left, piece)
                        if state is not False:
                            ends.append(state)
                            begin.append(q)
                            code.append(state.code)
                            break
                else:  # a character that no piece ends in here
                    char = word[p - 1]
                    ends.append(self.parts.get(char, start))
                    begin.append(p - 1)
                    code.append(self._spelled(char))
            before, path, p = word, [], n
            while p:
                path.append(code[p])
                p = begin[p]
            path.reverse()
            ids[word] = b"".join(path)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new: set[str] = set()
        for words in split:
            new.update(words or ())
        self.learn(new.difference(self.words))
        get = self.words.__getitem__
        return [None if ws is None else np.frombuffer(b"".join(map(get, ws)), self.type).astype(np.int32) for ws in split]

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        out = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_loaded: dict[str, Pieces] = {}


def pieces(model: str = MODEL) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of SLICE characters or so."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids: the tokens of each whole text."""
    key = docs.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for cut in _slices(texts):
                rows = m.encode(texts[cut])
                sizes = np.array([0 if r is None else len(r) for r in rows])
                flat = pa.array(np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)]), pa.int32())
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([r is None for r in rows] + [False])), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[cut], pa.array(sizes, pa.int64()), lists], ["doc_id", "n_tokens", "ids"])
        m.words.clear()  # the worker lives on

    return docs.select("doc_id", "text").mapInArrow(bounded(work), f"doc_id {key.dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    key = tokens.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            texts = [m.decode(None if not x.is_valid else x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(bounded(work), f"doc_id {key.dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip: each text encoded, its ids decoded again, both digested."""
    key = docs.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for cut in _slices(texts):
                out = []
                for text, ids in zip(texts[cut], m.encode(texts[cut]), strict=True):
                    back = m.decode(ids)
                    if text is None:
                        out.append((0, None, None, None))
                    else:
                        out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(MARK, " ")))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[cut], *columns], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])
        m.words.clear()

    return docs.select("doc_id", "text").mapInArrow(bounded(work), f"doc_id {key.dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
