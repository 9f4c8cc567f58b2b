"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern; each piece is merged on its own. For a piece of
n bytes a segment tree over the byte positions holds, at leaf i, the rank of the pair that starts at
i (packed with i, so that the root is the leftmost pair of least rank). One merge takes the root,
drops the right part's leaf and renews the leaves of the two live pairs beside the merged part:
three point updates of logarithmic cost, so a piece of any length takes O(n log n). Pieces of up to
``SHORT_PIECE`` bytes, nearly all, keep the ranks of their pairs in a plain list instead: the same merges
in the same order, without the cost of a tree.

Which characters are letters, numbers and blanks is asked of the `regex` module, whose Unicode tables may be newer
than the library's: a character that only the newer tables call a letter or a number is a symbol to the library. Which
ones these are is measured with the library itself, once per tokenizer on the driver. Texts within the basic plane are
cut by Python's `re` with these classes spelled out, which takes a third of the time; texts with characters beyond it
by `regex` itself.

Workers keep the ids of pieces they have met in a cache of two generations of bounded size; the
cache never changes a result. Ids travel as little-endian unsigned 32-bit integers in one binary
column, and decoding joins the tokens' bytes, which restores the text's UTF-8 bytes exactly.

Defined results: a null text counts as empty and has no ids; very long texts are taken in runs of
pieces; repeated rows are encoded each for itself; a null id column passes through. Columns of the
input other than the id and the text are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces kept in one generation of a worker's cache, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 150_000, 200
#: Texts with more characters than this are matched step by step, this many pieces at a time.
LONG_CHARS, RUN = 1 << 20, 1 << 16
#: Bytes up to which a piece is merged by a plain list of ranks.
SHORT_PIECE = 48
_NONE, _FAR = 1 << 62, (1 << 30) - 1
_AT = (1 << 32) - 1


class PieceCache(dict):
    """piece -> value by a function; when a generation is full it becomes the old one, whose used pieces move on."""

    def __init__(self, make: Callable, limit: int = CACHE_PIECES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece):
        value = self.old.pop(piece, None)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            self.keep(piece, value)
        return value

    def keep(self, piece, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, at 256 * first + second."""
    return [ranks.get(bytes((a, b)), _FAR) for a in range(256) for b in range(256)]


def _merge_short(piece: bytes, ranks: dict[bytes, int], pairs: list[int] | None) -> list[int]:
    """merge() with a list of the pairs' ranks in place of the tree."""
    rank = ranks.get
    if pairs is None:
        least = [rank(piece[i : i + 2], _FAR) for i in range(len(piece) - 1)]
    else:
        least = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
    starts = list(range(len(piece) + 1))  # where each part begins, and the end
    while least and (best := min(least)) != _FAR:
        i = least.index(best)
        del starts[i + 1], least[i]
        if i < len(least):
            least[i] = rank(piece[starts[i] : starts[i + 2]], _FAR)
        if i:
            least[i - 1] = rank(piece[starts[i - 1] : starts[i + 1]], _FAR)
    return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]  # noqa: B905


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int] | None = None) -> list[int]:
    """The ids of one piece; pairs: pair_table() of the ranks, which saves time."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    if n <= SHORT_PIECE:
        return _merge_short(piece, ranks, pairs)
    rank = ranks.get
    width = 1 << max(0, (n - 1).bit_length())
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << 32 | i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 2))  # where the part that follows begins
    before = list(range(-1, n))

    while (best := tree[1]) < _NONE:
        i = best & _AT
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        r = rank(piece[i : after[k]]) if k < n else None
        updates = [(j, _NONE), (i, _NONE if r is None else r << 32 | i)]
        h = before[i]
        if h >= 0:
            r = rank(piece[h:k])
            updates.append((h, _NONE if r is None else r << 32 | h))
        for leaf, value in updates:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


#: Python's own tables are older than those of `regex`: only what they do not know may be unknown to the library.
_CODE_POINTS = range(0x80, 0x110000)


@lru_cache(maxsize=1)
def new_characters() -> list[str]:
    """Letters and numbers that Python's tables lack."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return [c for c in map(chr, _CODE_POINTS) if unicodedata.category(c) == "Cn" and known.match(c)]


def unknown_class(is_letter: Callable[[str], bool]) -> str:
    """The new characters that a library does not take for letters or numbers, as ranges of a character class."""
    spans: list[list[int]] = []
    for c in (ord(c) for c in new_characters() if not is_letter(c)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_CLASSES = re.compile(r"\\p\{[LN]\}|\\[sS]|\\.|\[\^?|\]", re.S)


def spelled_out(pattern: str, unknown: str = "") -> re.Pattern | None:
    r"""The pattern for `re`, its \p{L}, \p{N} and \s as ranges of the basic plane; None if it has what is not translated."""
    plane = "".join(map(chr, range(0x10000)))

    def ranges(kind: str) -> str:
        held = f"[{kind}--[{unknown}]]+" if unknown and kind != r"\s" else f"[{kind}]+"
        return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(held, plane, flags=regex.V1))

    spans, out, at, inside = {}, [], 0, False
    for m in _CLASSES.finditer(pattern):
        token = m[0]
        out.append(pattern[at : m.start()])
        at = m.end()
        if token in ("[", "[^", "]"):
            inside = token != "]"
        elif token == r"\S" and not inside or token in (r"\p{L}", r"\p{N}", r"\s"):
            kind = token.lower() if token == r"\S" else token
            span = spans.setdefault(kind, ranges(kind))
            token = span if inside else f"[{'^' * (token != kind)}{span}]"
        elif token[1].isalnum():
            return None
        out.append(token)
    try:
        return re.compile("".join([*out, pattern[at:]]))
    except re.error:
        return None


class Cutter:
    """A pattern's matches, as a library finds them that does not know the characters of the class `unknown`."""

    def __init__(self, pattern: str, unknown: str = ""):
        self.plain = spelled_out(pattern, unknown)
        self.match = self.older = regex.compile(pattern)
        self.unknown = None
        if unknown:
            self.unknown = regex.compile(f"[{unknown}]")
            letters, numbers = (rf"[\p{{{k}}}--[{unknown}]]" for k in "LN")
            self.older = regex.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers), flags=regex.V1)

    def runs(self, text: str) -> Iterator[list[str]]:
        """The matches, in lists of bounded length for long texts."""
        match = self.match
        if self.plain is not None and (text.isascii() or not _BEYOND.search(text)):
            match = self.plain
        elif self.unknown is not None and not text.isascii() and self.unknown.search(text):
            match = self.older
        if len(text) <= LONG_CHARS:
            yield match.findall(text)
            return
        found = (m[0] for m in match.finditer(text))
        while run := list(islice(found, RUN)):
            yield run


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def unknown_to_library(path: str, pattern: str) -> str:
    """unknown_class() of the tiktoken library: a contraction is its own piece after letters and numbers alone."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    end = library.encode_ordinary("'d")
    return unknown_class(lambda c: library.encode_ordinary(f"{c}'d")[-len(end) :] == end)


class Encoder:
    """Ranks, cutter and piece cache of one worker process."""

    def __init__(self, path: str, pattern: str, unknown: str = ""):
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cut = Cutter(pattern, unknown)
        pairs = pair_table(self.ranks)
        self.cache = PieceCache(lambda piece: np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks, pairs), "<u4").tobytes())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(map(self.cache.__getitem__, run)) for run in self.cut.runs(text)])

    def decode(self, ids: bytes) -> bytes:
        table, whole = self.tokens.__getitem__, np.frombuffer(ids, "<u4")
        return b"".join([b"".join(map(table, whole[i : i + RUN].tolist())) for i in range(0, len(whole), RUN)])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, unknown: str = "") -> Encoder:
    """One encoder per worker process, tokenizer file and pattern."""
    return Encoder(path, pattern, unknown)


def in_slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column's values have about `most` bytes a slice, to bound what a worker holds."""
    if batch.num_rows == 0:
        return
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("float64"))
    group = (np.cumsum(sizes) // most).astype("int64")
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): ids of each whole text, a binary of little-endian unsigned 32-bit integers.

    With `decoded`, also the bytes that the ids decode to, by the same worker; decode() gives the same from stored ids.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unknown = unknown_to_library(path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, unknown)
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                ids = [enc.encode(text) if text else b"" for text in part.column("text").to_pylist()]
                arrays = [part.column("id"), pa.array(ids, pa.binary())]
                if decoded:
                    arrays.append(pa.array(map(enc.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "decoded"][: len(arrays)])

    id_type = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(work, f"id {id_type}, ids binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """The input with a column `decoded`: the UTF-8 bytes that the ids stand for."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in in_slices(batch, ids_col):
                texts = pa.array([enc.decode(ids) if ids else b"" for ids in part.column(ids_col).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(work, schema)
