r"""Quality rules: measures of each text, and lines that too many documents of a host share.

Words are runs of ``[^\x20\x09-\x0D]``. A document fails the base rules if it has fewer than ten words
or if more than a fifth of its words lie in five-word windows that its text repeats.

Cross-document line frequency: every line is normalised (A-Z lower-cased, white space collapsed) and
hashed to 64 bits; for each host and hash the distinct documents are counted, where documents of equal
text count once, so copies do not turn their own lines into boilerplate. A line is over the limit if
more than ``min_docs`` documents of the host have it, however large the host is, or, for small hosts, if
more than ``SHARE_DOCS`` documents and more than ``max_share`` of the host's documents have it. Such
lines are removed; a document with less than ``min_left`` of its words left is depleted and rejected.

The text is read once: measures and line hashes are written to the shared folder, and the counts run
over those small rows (with partial sums before each shuffle, so hot hosts and lines are no burden).

Defined results: a null text counts as empty and fails; a null host is a host of its own; repeated
rows are judged alike; other columns are passed through by ``apply`` and ignored by ``judge``; empty
tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braggflow.llm.bpe import in_slices
from braggflow.llm.common import small_side, stored

MIN_WORDS, WINDOW, MAX_REPEAT_SHARE = 10, 5, 20
MIN_DOCS, SHARE_DOCS, MAX_SHARE, MIN_LEFT = 30, 5, 0.1, 0.3
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in windows of five words which occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, words), "i8", len(words))
    key = np.zeros(n, "u8")
    for j in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * _MIX[j] + ids[j : j + n].astype("u8")
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if all((ids[a + j] == ids[b + j]).all() for j in range(WINDOW)):
        starts = np.unique(np.concatenate([a, b]))
    else:  # two different windows share a hash: compare the windows themselves
        where = defaultdict(list)
        for i in range(n):
            where[tuple(ids[i : i + WINDOW])].append(i)
        starts = np.array(sorted(i for found in where.values() if len(found) > 1 for i in found))
    cover = np.zeros(len(words) + 1, "i8")
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure_text(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hash of each line, words of each line); a line without words has hash 0."""
    tally = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    chars = int(tally.sum() - tally[0x80:0xC0].sum() - sum(tally[c] for c in _SPACES))
    symbols = int(sum(tally[c] for c in SYMBOLS))
    seen, dup, words, hashes, sizes = set(), 0, [], [], []
    for line in text.split(b"\n"):
        own = line.split()
        sizes.append(len(own))
        if not own:
            hashes.append(0)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        words += own
        hashes.append(xxhash.xxh64_intdigest(b" ".join(own).lower()) or 1)
    return len(words), chars, symbols, dup, repeat_words(words), hashes, sizes


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row, id, text_key, host, measures, line_hashes, line_words), stored in the shared folder."""
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    plain = [f for f in source.schema.fields if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                found = [measure_text(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                *numbers, hashes, sizes = zip(*found, strict=True)
                lines = pa.array([np.array(h, "u8").view("i8") for h in hashes], pa.list_(pa.int64()))
                arrays = [part.column(f.name) for f in plain] + [pa.array(c, pa.int64()) for c in numbers] + [lines, pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([*plain, *T._parse_datatype_string(f"{MEASURES}, line_hashes array<long>, line_words array<int>").fields])
    names = schema.fieldNames()
    return stored(source.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "quality")


def frequent_lines(measured: DataFrame, *, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line) of the lines over the limit."""
    texts = measured.groupBy("host", "text_key").agg(F.first("line_hashes").alias("line_hashes"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = texts.select("host", F.explode(F.array_distinct("line_hashes")).alias("line")).where("line <> 0")
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min(min_docs, SHARE_DOCS))
    often = often.withColumnRenamed("host", "host_of_line")
    over = (F.col("n") > min_docs) | ((F.col("n") > SHARE_DOCS) & (F.col("n") > F.lit(max_share) * F.col("host_docs")))
    return often.join(hosts, F.col("host_of_line").eqNullSafe(F.col("host"))).where(over).select("host", "line")


def verdicts(measured: DataFrame, *, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """measured with base_failed, removed (positions of lines over the limit), removed_words (words in them), and kept."""
    over = stored(frequent_lines(measured, min_docs=min_docs, max_share=max_share), "quality-lines")
    over = small_side(over.select(F.col("host").alias("f_host"), F.col("line").alias("f_line")))
    lines = measured.select("row", "host", F.posexplode(F.arrays_zip(F.col("line_hashes").alias("h"), F.col("line_words").alias("w"))).alias("at", "l"))
    hits = lines.join(over, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("l.h") == F.col("f_line")))
    hits = hits.groupBy("row").agg(F.sum("l.w").alias("gone"), F.array_sort(F.collect_list("at")).alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        measured.join(hits, "row", "left")
        .withColumn("removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= F.lit(min_left) * F.col("n_words")))
    )


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """(id, measures, base_failed, kept, removed, removed_words) of each document."""
    found = verdicts(measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), **limits)
    return found.select(F.col("id").alias(id_col), *[c.split()[0] for c in MEASURES.split(", ")], "base_failed", "kept", "removed", "removed_words")


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that are kept, with all their columns and without the lines over the limit."""
    found = verdicts(measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), **limits).where("kept")
    found = found.groupBy("id", "text_key", "host").agg(F.first("removed").alias("removed"))  # repeated rows are judged alike
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    text = F.col(f"doc.`{text_col}`")
    same = F.col(f"doc.`{id_col}`").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_key")) & F.col(f"doc.`{host_col}`").eqNullSafe(F.col("host"))
    kept = rows.join(found, same)
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains("removed", at)), "\n")
    rest = F.when(F.size("removed") > 0, rest).otherwise(text)
    return kept.select(*[(rest if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
