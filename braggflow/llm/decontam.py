r"""Benchmark decontamination: windows of benchmark words looked up in every window of every document.

Texts are lower-cased in A-Z and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A benchmark window is
thirteen consecutive words of an item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit.

The windows' 64-bit hashes are broadcast with their words. Workers hash words and windows of whole
texts with array operations; a window whose hash is found is compared word for word before it counts.
The broadcast is bounded: benchmarks with more than ``block_words`` words are taken in blocks of items,
one stored pass over the documents each, whose hits are merged row by row; nothing is shuffled.

Defined results: null texts have no words; items without words have no window; repeated items count by
their id once, a null id as the item `None`; repeated documents are judged each for itself; very long texts are hashed in stretches;
columns of the documents are passed through under their own names; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braggflow.llm.bpe import in_slices
from braggflow.llm.common import discard, stored
from braggflow.llm.words import ALNUM, LOWER, window_hashes, words_of

WINDOW = 13
#: Benchmark words in one broadcast block.
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 22
class Windows:
    """The windows of a block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[object, str]]):
        self.grams: dict[bytes, list[str]] = defaultdict(list)
        by_length: dict[int, dict[int, None]] = defaultdict(dict)
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")
            starts, ends, hashes = words_of(raw, ALNUM)
            low, n = LOWER[raw].tobytes(), min(WINDOW, len(starts))
            if n == 0:
                continue
            for i, h in enumerate(window_hashes(hashes, [n])[n].tolist()):
                gram = _gram(low, starts, ends, i, n)
                if str(item) not in self.grams[gram]:
                    self.grams[gram].append(str(item))
                by_length[n][h] = None
        self.grams = dict(self.grams)
        self.hashes = {n: np.sort(np.fromiter(found, "u8", len(found))) for n, found in by_length.items()}
        self.filters = {n: self._filter(found) for n, found in self.hashes.items()}

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        marks = np.zeros(1 << _FILTER_BITS, "?")
        marks[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return marks

    def __getstate__(self):
        return {"grams": self.grams, "hashes": self.hashes}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.filters = {n: self._filter(found) for n, found in self.hashes.items()}


def _gram(low: bytes, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join([low[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)])


def scan_texts(texts: list[bytes], windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple[int, int]]]]:
    """For each text: number of words, hit spans in words [start, end), item ids, hit spans in bytes."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, "u1")
    starts, ends, hashes = words_of(raw, ALNUM)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, offsets)  # a text's first word
    occur: list[tuple[int, int, bytes]] = []
    low = None
    for n, found in window_hashes(hashes, sorted(windows.hashes)).items():
        table = windows.hashes[n]
        at = np.flatnonzero(windows.filters[n][found >> np.uint64(64 - _FILTER_BITS)])
        at = at[table[np.minimum(np.searchsorted(table, found[at]), len(table) - 1)] == found[at]]
        if len(at):
            low = LOWER[raw].tobytes() if low is None else low
            same_text = np.searchsorted(first, at, "right") == np.searchsorted(first, at + n - 1, "right")
            occur += [(i, n, gram) for i in at[same_text].tolist() if (gram := _gram(low, starts, ends, i, n)) in windows.grams]
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for i, n, gram in sorted(occur):
        doc = int(np.searchsorted(first, i, "right")) - 1
        items[doc].update(windows.grams[gram])
        a, b = i - int(first[doc]), i - int(first[doc]) + n
        if spans[doc] and a <= spans[doc][-1][1]:
            spans[doc][-1][1] = max(b, spans[doc][-1][1])
        else:
            spans[doc].append([a, b])
    out = []
    for d in range(len(texts)):
        base, byte = int(first[d]), int(offsets[d])
        cut = [(int(starts[base + a]) - byte, int(ends[base + b - 1]) - byte) for a, b in spans[d]]
        out.append((int(first[d + 1]) - base, [tuple(s) for s in spans[d]], sorted(items[d]), cut))
    return out


_HITS = "n_words long, spans array<struct<start:long,end:long>>, bytes array<struct<start:long,end:long>>, items array<string>"


def _pass(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """rows (doc, text) with a struct `hit` of one block's hits; shared: its Windows."""
    kept = rows.schema
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), span, span, pa.list_(pa.string())]
    names = ["n_words", "spans", "bytes", "items"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 2 << 20):
                found = scan_texts(part.column("text").cast(pa.binary()).to_pylist(), shared.value)
                pairs = lambda spans: [{"start": a, "end": b} for a, b in spans]
                columns = [[f[0] for f in found], [pairs(f[1]) for f in found], [pairs(f[3]) for f in found], [f[2] for f in found]]
                hit = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                yield pa.RecordBatch.from_arrays([*part.columns, hit], [*part.schema.names, "hit"])

    return rows.mapInArrow(work, T.StructType([*kept.fields, T.StructField("hit", T._parse_datatype_string(_HITS))]))


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc struct with all columns, text, n_words, n_hit, spans, bytes, items) of each document; spans are merged and in order."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // (2 * block_words)))  # a word and what parts it from the next have two bytes at least
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(n_blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()]))
        passed = _pass(rows, shared).withColumnRenamed("hit", f"hit{b}")
        if n_blocks > 1:  # a stored pass for each block, so only one is held at a time
            passed = stored(passed, "decontam")
            shared.destroy()
            discard(rows)
        rows = passed
    hits = [F.col(f"hit{b}") for b in range(n_blocks)]
    merge = (lambda field: hits[0][field]) if n_blocks == 1 else (lambda field: _merged(F.flatten(F.array(*[h[field] for h in hits]))))
    items_of = F.array_sort(F.array_distinct(F.flatten(F.array(*[h["items"] for h in hits]))))
    out = rows.select("doc", "text", hits[0]["n_words"].alias("n_words"), merge("spans").alias("spans"), merge("bytes").alias("bytes"), items_of.alias("items"))
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def _merged(spans):
    """Overlapping spans of several passes as disjoint ones."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(done, s):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, step)


def contaminated(found: DataFrame, least_share: int = 20):
    """True where something is hit and hits are at least one word in `least_share`."""
    return (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", mode: str = "document", **options) -> DataFrame:
    """Documents with their own columns: without the contaminated ones (mode "document"), or without the hit words (mode "span")."""
    found = scan(docs, benchmark, text_col=text_col, **options)
    if mode == "document":
        return found.where(~contaminated(found)).select("doc.*")
    gaps = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col("bytes"))
    raw = F.encode("text", "utf-8")
    pieces = F.transform(
        gaps, lambda g, i: F.substring(raw, (g["end"] + 1).cast("int"), F.coalesce(F.try_element_at(gaps, (i + 2).cast("int"))["start"] - g["end"], F.octet_length("text")).cast("int"))
    )
    rest = F.when(F.size("bytes") > 0, F.array_join(F.transform(pieces, lambda p: F.decode(p, "utf-8")), "")).otherwise(F.col(f"doc.`{text_col}`"))
    return found.select(*[(rest if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
