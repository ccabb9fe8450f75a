"""Sizes in tokens of a public tokenizer, and text cut at natural boundaries."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.inputs import map_lists
from paperlake.llm.words import UNSPACED, WORDS

#: The folder of the public tokenizers' files; another one may be given to every operator.
TOKENIZERS = os.environ.get("PAPERLAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary divides text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CAPACITY = 2048
OVERLAP = 64
#: Sentences on either side of a gap whose words are compared.
BLOCK = 6
#: A piece is at least this full, unless no boundary lies beyond.
LEAST_FILL = 0.5

# A cut is made before white space: the tokenizer begins anew there, so that
# both sides have the tokens that the whole text had.
_BOUNDARY = re.compile(
    r"(?<=\S)(?=\n)|(?<=[.!?…])[\"'”’»)\]]*(?=\s)|(?<=[。！？।॥])[”’」』）】]*(?=[^\s”’」』）】])|(?<=[\u0e00-\u0e7f])(?=\s+[\u0e00-\u0e7f])"
)
_WHITE = re.compile(r"(?<=\S)\s")
_UNSPACED_RUN = re.compile(f"({UNSPACED.pattern}+)")

@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS):
    """The byte-level encoding in `folder`; loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("paperlake", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(folder: str = TOKENIZERS) -> np.ndarray:
    """Bytes of every token."""
    e = encoding(folder)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.max_token_value + 1)], np.int64)


def count(text: str, folder: str = TOKENIZERS) -> int:
    return len(encoding(folder).encode_ordinary(text))


def boundaries(text: str) -> list[int]:
    """Where sentences, lines and paragraphs end, before their white space."""
    return [m.end() for m in _BOUNDARY.finditer(text) if 0 < m.end() < len(text)]


def terms(text: str) -> list[str]:
    """What a unit of text is compared by: its words of four letters or more, and the character pairs of scripts without spaces."""
    words = WORDS.findall(text.lower())
    if text.isascii() or not UNSPACED.search(text):
        return [w for w in words if len(w) > 3]
    out = []
    for word in words:
        for i, run in enumerate(_UNSPACED_RUN.split(word)):
            if i % 2:
                out += [run[j : j + 2] for j in range(len(run) - 1)] or [run]
            elif len(run) > 3:
                out.append(run)
    return out


def valley(words: list[list[str]], first: int, last: int) -> int:
    """The gap g, first <= g <= last, where the words before and after differ most; the last of equals.

    Gap g lies before unit g of `words`.  The blocks beside it are compared by
    the cosine of their word counts; its depth is how far that similarity rises
    to either side.
    """
    if first == last:
        return last
    lo, hi = max(0, first - BLOCK), min(len(words), last + BLOCK)
    column: dict[str, int] = {}
    cells = [
        (u, column.setdefault(w, len(column))) for u in range(lo, hi) for w in words[u]
    ]
    if not cells:
        return last
    at = np.array(cells, np.int64)
    counts = np.bincount((at[:, 0] - lo) * len(column) + at[:, 1], minlength=(hi - lo) * len(column))
    total = np.vstack([np.zeros((1, len(column))), counts.reshape(hi - lo, len(column)).cumsum(0)])
    gaps = np.arange(first, last + 1) - lo
    left = total[gaps] - total[np.maximum(gaps - BLOCK, 0)]
    right = total[np.minimum(gaps + BLOCK, hi - lo)] - total[gaps]
    norms = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    similar = (left * right).sum(1) / np.maximum(norms, 1e-9)
    rise_left, rise_right = similar.copy(), similar.copy()
    for i in range(1, len(similar)):
        if similar[i - 1] >= similar[i]:
            rise_left[i] = rise_left[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            rise_right[i] = rise_right[i + 1]
    depth = rise_left + rise_right - 2 * similar
    return first + len(depth) - 1 - int(np.argmax(depth[::-1]))


class Measured:
    """A text with the places of its tokens."""

    def __init__(self, text: str, folder: str = TOKENIZERS) -> None:
        self.text = text
        self.encoding = encoding(folder)
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        self.n = len(ids)
        ends = np.cumsum(token_lengths(folder)[ids])
        if text.isascii():
            self.ends = ends
        else:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            # A token that ends inside a character counts as ending after it.
            self.ends = np.searchsorted(np.cumsum(width), ends, side="left") + 1

    def size(self, start: int, end: int) -> int:
        """Tokens of a part of the text when it is encoded by itself.

        Where the tokenizer begins anew at both ends they are counted from the
        whole; only the first word is encoded again if the part begins inside it.
        """
        if not self.anew(end):
            return len(self.encoding.encode_ordinary(self.text[start:end]))
        if self.anew(start):
            return self.tokens_to(end) - self.tokens_to(start)
        m = _WHITE.search(self.text, start + 1, end)
        if not m:
            return len(self.encoding.encode_ordinary(self.text[start:end]))
        return len(self.encoding.encode_ordinary(self.text[start : m.start()])) + self.tokens_to(end) - self.tokens_to(m.start())

    def anew(self, at: int) -> bool:
        """True if the tokenizer begins anew at a character, whatever stands before it."""
        text = self.text
        if not 0 < at < len(text):
            return True
        before, after = text[at - 1], text[at]
        if after.isspace():
            return not before.isspace()
        return after.isalpha() and not (before.isspace() or before.isalnum() or before == "'" or unicodedata.category(before)[0] in "LMN")

    def tokens_to(self, at: int) -> int:
        """Tokens of the text up to a character; a token that goes on beyond it isn't counted."""
        return int(np.searchsorted(self.ends, at, side="right"))

    def character_at(self, tokens: int) -> int:
        """The last character boundary within so many tokens."""
        if tokens >= self.n:
            return len(self.text)
        if tokens <= 0:
            return 0
        at = int(self.ends[tokens - 1])
        # Step back over tokens that end inside the same character.
        return at if int(self.ends[tokens]) > at else at - 1


def cut(
    text: str, capacity: int = CAPACITY, overlap: int = OVERLAP, folder: str = TOKENIZERS, cohesive: bool = True
) -> list[tuple[int, int, int, int]]:
    """Pieces (start, own_start, end, tokens) of a text, in characters.

    A piece repeats the last `overlap` tokens of the one before, from start to
    own_start, and has at most `capacity` tokens when it is encoded by itself.
    Among the boundaries that leave a piece well filled the deepest valley of
    lexical cohesion is taken, or the last one if `cohesive` is false; without
    one, the last boundary before; without any, the last token.  A text within
    the capacity is one piece; an empty one has none.
    """
    if not text:
        return []
    m = Measured(text, folder)
    if m.n <= capacity:
        return [(0, 0, len(text), m.n)]
    places = boundaries(text)
    at_tokens = np.searchsorted(m.ends, np.array(places, np.int64), side="right")
    words: list[list[str]] = []
    if cohesive:
        for a, b in zip([0, *places], [*places, len(text)]):
            words.append(terms(text[a:b]))
    out: list[tuple[int, int, int, int]] = []
    own = 0
    while own < len(text):
        begun = m.tokens_to(own)
        start = min(own, m.character_at(begun - overlap)) if out else 0
        end, size = _piece_end(m, own, start, begun, capacity, places, at_tokens, words)
        out.append((start, own, end, size))
        own = end
    return out


def _piece_end(m: Measured, own: int, start: int, begun: int, capacity: int, places: list[int], at_tokens, words) -> tuple[int, int]:
    """End and size of the piece that begins at `start` and goes on from `own`."""
    room = capacity - (begun - m.tokens_to(start))
    if begun + room >= m.n and (size := m.size(start, len(m.text))) <= capacity:
        return len(m.text), size
    while True:
        # The overlap may take a few tokens more by itself than it did in the text.
        limit = begun + max(room, 1)
        last = int(np.searchsorted(at_tokens, limit, side="right")) - 1
        lowest = int(np.searchsorted(places, own, side="right"))
        first = max(lowest, int(np.searchsorted(at_tokens, begun + int(room * LEAST_FILL), side="left")))
        if first <= last:
            # Place i ends unit i, so its gap lies before unit i + 1.
            end = places[valley(words, first + 1, last + 1) - 1] if words else places[last]
        elif lowest <= last:
            end = places[last]
        else:
            end = max(own + 1, m.character_at(limit))
        size = m.size(start, end)
        if size <= capacity or end == own + 1:
            return end, size
        room -= max(1, size - capacity)


def oversized(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows that may exceed the capacity: no token of a byte-level tokenizer is shorter than a byte."""
    return documents.where(F.octet_length("text") > capacity)


PIECES = "piece_no int, start_char int, own_start_char int, end_char int, n_tokens int"


def pieces(
    documents: DataFrame, capacity: int = CAPACITY, overlap: int = OVERLAP, folder: str = TOKENIZERS, with_text: bool = False
) -> DataFrame:
    """(doc_id, piece_no, start_char, own_start_char, end_char, n_tokens[, piece]) of every text above the capacity.

    The texts between own_start_char and end_char, put together, are the
    document.  Null, empty and smaller texts give no rows; repeated rows give
    repeated rows; other columns are ignored.
    """

    def rows(doc: list, text: list) -> list[tuple]:
        out = []
        for d, t in zip(doc, text):
            parts = cut(t, capacity, overlap, folder)
            if len(parts) > 1:
                out += [(d, i, *p, *([t[p[0] : p[2]]] if with_text else [])) for i, p in enumerate(parts)]
        return out

    schema = f"doc_id bigint, {PIECES}" + ", piece string" * with_text
    return map_lists(oversized(documents.select("doc_id", "text"), capacity), rows, schema)
