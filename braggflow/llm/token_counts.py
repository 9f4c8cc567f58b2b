"""Token counts by a two-tier lookup on the map side.

First tier: a compact table (pre-token -> number of tokens) of the most frequent pre-tokens, broadcast
to every worker; its size is a parameter. Second tier: each worker encodes what the table lacks
with the tokenizer library and keeps the counts in a cache of bounded size. The texts' pre-tokens are
never shuffled: the table is chosen by a pass over all documents in which each task counts its pre-tokens
and proposes only its own most frequent short ones (at most ``per_task`` rows a task); these proposals
alone are summed. The table and the cache affect speed alone; every count comes from the library.

For a byte-level JSON tokenizer a text is first cut at the added special strings, which are one token
each as the library has it by default, then by the tokenizer's pattern with the library's classes of characters (see bpe). Tokenizers that cannot be cut
into independent pre-tokens (other JSON tokenizers, sentencepiece models) encode whole texts.

Defined results: a null text counts as empty and has no tokens; very long texts are taken in runs;
repeated rows are counted each for itself; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.llm.bpe import CACHE_CHARS, Cutter, PieceCache, in_slices, unknown_class

#: Rows of the broadcast table, rows that a task may propose for it, and the counter size at which a task forgets its rare pre-tokens.
TABLE_ROWS, TASK_ROWS, COUNTER_ROWS = 16_384, 4_096, 200_000


class Tokenizer:
    """Pre-token cutting and exact counts of one worker process."""

    def __init__(self, path: str, pattern: str, unknown: str = ""):
        self.cut = self.special = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text, num_threads=1))
            return
        import tokenizers

        library = tokenizers.Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.count = lambda text: len(library.encode(text, add_special_tokens=False))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        if plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.cut = Cutter(pattern, unknown)
            self.library = library
            self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of what is encoded on its own: special strings, pre-tokens, or the whole text."""
        if self.cut is None:
            yield [text]
            return
        if self.special is None or not (cuts := [m.span() for m in self.special.finditer(text)]):
            yield from self.cut.runs(text)
            return
        at = 0
        for a, b in cuts:
            yield from self.cut.runs(text[at:a])
            yield [text[a:b]]
            at = b
        yield from self.cut.runs(text[at:])


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str, unknown: str = "") -> Tokenizer:
    return Tokenizer(path, pattern, unknown)


@lru_cache(maxsize=4)
def unknown_to_library(path: str, pattern: str) -> str:
    """unknown_class() of the tokenizers library, empty for a tokenizer that encodes whole texts."""
    found = tokenizer(path, pattern)
    if found.cut is None:
        return ""
    ids = lambda text: found.library.encode(text, add_special_tokens=False).ids
    end = ids("'d")
    return unknown_class(lambda c: ids(f"{c}'d")[-len(end) :] == end)


class TwoTier(dict):
    """The broadcast table, with the worker's cache behind it."""

    def __init__(self, table: dict[str, int], count: Callable[[str], int]):
        super().__init__(table)
        self.misses = PieceCache(count)

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]


def frequent(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", rows: int = TABLE_ROWS, per_task: int = TASK_ROWS) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of all documents; at most `rows` of them reach the driver."""

    unknown = unknown_to_library(path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, found = tokenizer(path, pattern, unknown), Counter()
        for batch in batches:
            for part in in_slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    for run in cut.pieces(text) if text and cut.cut is not None else ():
                        found.update(run)
                    if len(found) > COUNTER_ROWS:
                        found = Counter(dict(found.most_common(COUNTER_ROWS // 4)))
        top = [(p, n) for p, n in found.most_common(2 * per_task) if len(p) <= CACHE_CHARS][:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(rows)
    cut = tokenizer(path, pattern, unknown)
    return {row["piece"]: cut.count(row["piece"]) for row in top.collect()}


def count(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """(id, n_bytes, n_tokens) of each whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, pattern, text_col=text_col, rows=rows))
    made, unknown = uuid.uuid4().hex, unknown_to_library(path, pattern)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenizer(path, pattern, unknown)
        if getattr(cut, "made", None) != made:  # a worker serves many tasks; its cache goes on with the same table
            cut.made, cut.tiers = made, TwoTier(table.value, cut.count)
        length = cut.tiers.__getitem__
        for batch in batches:
            for part in in_slices(batch, "text"):
                texts = part.column("text")
                totals = [sum(sum(map(length, run)) for run in cut.pieces(text)) for text in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(totals, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
