"""Evaluation texts leaking into training text.

Items are short, documents long, and a leak may be one passage, so the search
asks for containment of passages.  A passage is a window of consecutive words
of an item; its signature is the MinHash of its shingles.  Items are
partitioned by size, which fixes the length of window and shingle; scripts
without spaces are their own partition and counted in characters.

The signatures of all windows of the items make a bit map of fixed size.  One
pass over the documents computes the MinHash of all their windows and passes
on those that the map may hold.  These are joined with the windows of the items
on the whole window, which is exact.  Documents are read once, however many
items there are, and no item is gathered anywhere.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.glyphs import plain
from paperlake.llm.inputs import map_lists
from paperlake.session import cut

PASSAGE_WORDS = 12
SHINGLE_WORDS = 5
PASSAGE_CHARACTERS = 40
SHINGLE_CHARACTERS = 8
#: Bits of a signature that choose its place in the bit map: 2 to this power bits, 8 MB, whatever the number of items.
MAP_BITS = 26
#: Words of documents that are searched at once.
WORDS_AT_ONCE = 1_000_000

# Everything beyond ASCII that is neither letter, mark nor digit.
_SIGNS = re.compile(
    "[\\u0080-\\u00a9\\u00ab-\\u00b1\\u00b4\\u00b6-\\u00b8\\u00bb\\u00bf\\u00d7\\u00f7\\u0964\\u0965"
    "\\u2000-\\u206f\\u20a0-\\u20cf\\u2190-\\u2bff\\u3000-\\u3004\\u3008-\\u3020\\u3030\\u30fb"
    "\\uff01-\\uff0f\\uff1a-\\uff20\\uff3b-\\uff40\\uff5b-\\uff65]"
)
# The same within ASCII, on UTF-8 bytes.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_EAST = re.compile(r"[\u3040-ヿ㐀-䶿一-鿿]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` codes; scattered by _mix before they are compared by size."""
    n = len(codes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for i in range(1, width):
        h *= _MULTIPLIER
        h += codes[i : i + n]
    h *= _MULTIPLIER
    return h


def is_east(text: str) -> bool:
    """True for text that is written without spaces in Chinese or Japanese characters."""
    return len(_EAST.findall(text)) * 3 > len(text)


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case, as UTF-8."""
    text = text.lower() if text.isascii() else _SIGNS.sub(" ", plain(text).lower())
    return text.encode().translate(_SPACED).split()


def character_codes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)


class Size(NamedTuple):
    """A size class of items: whether it is counted in characters, and the length of its windows and shingles."""

    east: bool
    window: int
    shingle: int


class Codes(dict):
    """64-bit codes of words, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def minhashes(codes: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """The least shingle hash of every window."""
    order = _mix(shingle_hashes(codes, shingle))
    n = len(codes) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    # The least of 2, 4, 8... shingles in turn, then of two runs that overlap.
    k, width = window - shingle + 1, 1
    while 2 * width <= k:
        order = np.minimum(order[: len(order) - width], order[width:])
        width *= 2
    return np.minimum(order[:n], order[k - width : k - width + n])


def item_windows(item: int, text: str, codes: Codes) -> list[tuple[int, bool, int, int, int, str]]:
    """(item, east, window, shingle, signature, passage) of every window of an item; none without letters or digits."""
    words = words_of(text)
    if not words:
        return []
    if east := is_east(text):
        joined = b"".join(words).decode()
        numbers, most, shingle = character_codes(words), PASSAGE_CHARACTERS, SHINGLE_CHARACTERS
        passage = lambda i, n: joined[i : i + n]
    else:
        numbers, most, shingle = codes.of(words), PASSAGE_WORDS, SHINGLE_WORDS
        passage = lambda i, n: b" ".join(words[i : i + n]).decode()
    window, shingle = min(len(numbers), most), min(len(numbers), shingle)
    found = minhashes(numbers, window, shingle).view(np.int64).tolist()
    return [(item, east, window, shingle, h, passage(i, window)) for i, h in enumerate(found)]


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _places(codes: np.ndarray, owner: np.ndarray, size: Size, bits: np.ndarray) -> list[int]:
    """Where windows within one owner begin whose signatures the map may hold."""
    hashes = minhashes(codes, size.window, size.shingle)
    if not len(hashes):
        return []
    return np.flatnonzero(_may_hold(bits, hashes) & (owner[: len(hashes)] == owner[size.window - 1 :])).tolist()


def document_windows(docs: list[tuple[int, list[bytes]]], sizes: list[Size], bits: np.ndarray, codes: Codes) -> set[tuple[int, str]]:
    """(document, passage) for the windows of documents (id, words) that may be windows of items."""
    out: set[tuple[int, str]] = set()
    plain = [s for s in sizes if not s.east]
    if plain:
        words = [w for _, ws in docs for w in ws]
        owner = np.repeat(np.arange(len(docs)), [len(ws) for _, ws in docs])
        numbers = codes.of(words)
        for size in plain:
            out.update((docs[owner[i]][0], b" ".join(words[i : i + size.window]).decode()) for i in _places(numbers, owner, size, bits))
    if len(plain) < len(sizes):
        for doc, ws in docs:
            joined = b"".join(ws).decode()
            if not joined.isascii() and _EAST.search(joined):
                numbers = character_codes(ws)
                for size in sizes:
                    if size.east:
                        out.update((doc, joined[i : i + size.window]) for i in _places(numbers, np.zeros(len(numbers), np.int8), size, bits))
    return out


def bit_map(signatures: DataFrame) -> np.ndarray:
    """The bit map of signatures (column signature): at most 2 ** (MAP_BITS - 6) rows reach the driver."""
    at = F.shiftrightunsigned("signature", 64 - MAP_BITS)
    rows = (
        signatures.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(signature, {64 - MAP_BITS}) & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item or a passage of it.

    Every text is read whole, and once.  Null and empty texts hold and leak
    nothing; an item shorter than a passage must be held as a whole; repeated
    rows count once; an empty table on either side gives no rows.
    """

    def of_items(item: list, text: list) -> list[tuple]:
        codes = Codes()
        return [row for i, t in zip(item, text) for row in item_windows(i, t, codes)]

    windows = cut(
        map_lists(
            items.select("item_id", "text").where(F.length("text") > 0),
            of_items,
            "item_id bigint, east boolean, window int, shingle int, signature bigint, passage string",
        ).distinct()
    )
    # A size class for every length up to that of a passage, so no more than PASSAGE_WORDS + PASSAGE_CHARACTERS.
    sizes = [Size(r.east, r.window, r.shingle) for r in windows.select("east", "window", "shingle").distinct().collect()]
    shared = documents.sparkSession.sparkContext.broadcast((sorted(sizes), bit_map(windows.select("signature"))))

    def of_documents(doc: list, text: list, most: int = WORDS_AT_ONCE) -> list[tuple]:
        sizes, bits = shared.value
        codes, out, some, n = Codes(), [], [], 0
        for d, t in zip(doc, text):
            some.append((d, words_of(t)))
            n += len(some[-1][1])
            if n > most:
                out += document_windows(some, sizes, bits, codes)
                some, n = [], 0
        return out + list(document_windows(some, sizes, bits, codes))

    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    held = map_lists(texts, of_documents, "doc_id bigint, passage string")
    return held.join(windows.select("item_id", "passage"), "passage").select("doc_id", "item_id").distinct()
