r"""Source divergence audit: how far the terms of a language's sources lie apart.

Terms are the matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. A language keeps the V terms of at
least ``min_docs`` of its documents. A source gives each kept term ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, N its
occurrences of kept terms; the language as a whole gives it a p likewise. The divergence of p from q in a term is
``floor((p - q)**2 / q)``; that of two sources is its sum over all kept terms.

1. Each task counts terms by source in a bounded table and sends a row (language, term, source, documents, occurrences) for
   each entry when the table is full: what is shuffled is pre-aggregated, so no term or source is hot.
2. Rows are dealt by (language, term) and sorted by (language, term, source). A scan over each sorted stream adds up
   equal keys and ends a run where the term changes: the run has the term's document frequency, and if it is kept
   its counts by source go on. What a run needs at once is a row for each of its sources.
3. Counts are joined with the sources' sums, dealt and sorted again, and a second scan emits, for each run, the partial
   sums of pairs of the run's sources and the terms of each source, both combined before they leave the task.
   Only sources that have the term are paired there. What a pair gets from terms that one or both lack follows
   from how often each count occurs: with p0 the value of an absent term, the sum over all terms of f(p, q) is the sum
   over the first's counts of f(p, q0), plus that over the second's of f(p0, q), plus f(p0, q0) for each of the V terms,
   less those of either, plus f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over the terms of both.

All arithmetic is on integers: 64 bit in the tasks (exact for up to 9 * 10**15 words a language), decimals in sums.

Defined results: a null text, language or source counts as empty; each row is a document, repeated ones too (ids aren't
read); a source without terms and a language without kept terms (V = 0, all pairs have value 0) are told like the others;
other columns are ignored; very long texts are counted in stretches; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braggflow.llm.bpe import in_slices
from braggflow.llm.common import discard, small_side, stored
from braggflow.llm.words import LOWER

SCALE = 1_000_000_000
#: Entries of a task's table of counts; pairs that the second scan expands at once, and partial sums that it keeps.
TABLE_ENTRIES, PAIRS, SUMS = 600_000, 1 << 20, 1 << 19
#: Bytes of a text that are matched at once, up to the next byte that is in no term.
STRETCH = 1 << 22
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_LOWER = LOWER.tobytes()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + STRETCH)) if len(text) - at > STRETCH else None
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole) without overflow, for count <= whole."""
    found, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


def apart(p, q):
    """floor((p - q)**2 / q), of arrays or columns of integers."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, q) if isinstance(p, Column) else square // q


def _groups(docs: DataFrame) -> DataFrame:
    """(gid, lid, lang, source): every occurring pair, numbered; lid stands for the language. Stored."""
    found = stored(docs.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    langs = found.groupBy("lang").agg(F.min("gid").alias("lid"))
    out = stored(found.join(small_side(langs), "lang").select("gid", "lid", "lang", "source"), "groups")
    discard(found)
    return out


_ROWS = "lid long, term string, gid long, docs long, n long"


def _counted(docs: DataFrame) -> DataFrame:
    """Partial counts (lid, term, gid, docs, n) of rows (lid, gid, text)."""

    def drained(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lid, gid), found in counts.items():
            k, own = len(found), docs[lid, gid]
            arrays = [pa.array(np.full(k, lid)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(np.full(k, gid)), pa.array([own[t] for t in found], pa.int64()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lid", "term", "gid", "docs", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, entries = {}, {}, 0
        for batch in batches:
            for part in in_slices(batch, "text"):
                for lid, gid, text in zip(part.column("lid").to_pylist(), part.column("gid").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    own = counts.setdefault((lid, gid), Counter())
                    seen, before = set(), len(own)
                    for terms in terms_of(text.translate(_LOWER)):
                        own.update(terms)
                        seen.update(terms)
                    docs.setdefault((lid, gid), Counter()).update(seen)
                    entries += len(own) - before
                    if entries >= TABLE_ENTRIES:
                        yield from drained(counts, docs)
                        counts, docs, entries = {}, {}, 0
        yield from drained(counts, docs)

    return docs.select("lid", "gid", "text").mapInArrow(work, _ROWS)


def _sorted_by_term(rows: DataFrame) -> DataFrame:
    return rows.repartition("lid", "term").sortWithinPartitions("lid", "term", "gid")


def _whole_runs(batches: Iterator[pa.RecordBatch], add: list[str]) -> Iterator[pa.Table]:
    """Tables of whole (lid, term) runs of a sorted stream, a row for each source; equal keys are added up in the columns `add`."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        merged = _merged(both.combine_chunks(), add)
        cut = int(_starts(merged, ["lid", "term"])[-1])
        if cut:
            yield merged.slice(0, cut).combine_chunks()
        rest = merged.slice(cut).combine_chunks()
    if rest is not None:
        yield rest


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a key differs from the row before."""
    new = np.ones(table.num_rows, bool)
    for k in keys:
        column = table.column(k)
        differs = pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        new[1:] = differs if k == keys[0] else new[1:] | differs
    return np.flatnonzero(new)


def _merged(table: pa.Table, add: list[str]) -> pa.Table:
    starts = _starts(table, ["lid", "term", "gid"])
    if len(starts) == table.num_rows:
        return table
    sums = {c: np.add.reduceat(table.column(c).to_numpy(), starts) for c in add}
    kept = table.take(pa.array(starts))
    for c, values in sums.items():
        kept = kept.set_column(kept.schema.get_field_index(c), c, pa.array(values))
    return kept


def kept_counts(docs: DataFrame, groups: DataFrame, min_docs: int) -> DataFrame:
    """(lid, term, gid, n, first) of the kept terms, first in one row of each; docs (lang, source, text). Stored."""
    rows = docs.join(small_side(groups), ["lang", "source"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _whole_runs(batches, ["docs", "n"]):
            starts = _starts(runs, ["lid", "term"])
            sizes = np.diff(np.append(starts, runs.num_rows))
            often = np.add.reduceat(runs.column("docs").to_numpy(), starts) >= min_docs
            first = np.zeros(runs.num_rows, bool)
            first[starts] = True
            out = runs.drop_columns(["docs"]).append_column("first", pa.array(first)).filter(pa.array(np.repeat(often, sizes)))
            yield from out.to_batches()

    return stored(_sorted_by_term(_counted(rows)).mapInArrow(scan, "lid long, term string, gid long, n long, first boolean"), "terms")


def _facts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """groups with n (occurrences), has (terms), v (terms of the language), whole (n + v), lang_whole, p0. Stored."""
    own = kept.groupBy("gid").agg(F.sum("n").alias("n"), F.count("*").alias("has"), F.count_if("first").alias("first"))
    found = groups.join(own, "gid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "has", "first")})
    langs = found.groupBy("lid").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_n"))
    found = found.join(small_side(langs), "lid").withColumn("whole", F.col("n") + F.col("v")).withColumn("lang_whole", F.col("lang_n") + F.col("v"))
    p0 = F.when(F.col("whole") > 0, 1 + F.call_function("div", F.lit(SCALE), F.col("whole"))).otherwise(1)
    return stored(found.withColumn("p0", p0).drop("first", "lang_n"), "groups")


def _pair_sums(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, sizes: np.ndarray, sums: dict[tuple[int, int], int]) -> None:
    """Add what pairs of sources of a run have beyond what each has alone; rows are sorted by run, `sizes` rows each."""
    end = np.repeat(np.cumsum(sizes), sizes)
    begin, k = end - np.repeat(sizes, sizes), np.repeat(sizes, sizes)
    names, code = np.unique(gid, return_inverse=True)
    spent = np.cumsum(k)
    a = 0
    while a < len(gid):  # as many rows as have PAIRS partners, one at least; a row's partners may come in parts
        b = max(a + 1, int(np.searchsorted(spent, (spent[a - 1] if a else 0) + PAIRS, "right")))
        for skip in range(0, int(k[a:b].max()), PAIRS):
            many = np.clip(k[a:b] - skip, 0, PAIRS)
            left = np.repeat(np.arange(a, b), many)
            right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[a:b] + skip, many)
            other = left != right
            left, right = left[other], right[other]
            if len(left):
                x, y, x0, y0 = p[left], p[right], p0[left], p0[right]
                more = apart(x, y) - apart(x, y0) - apart(x0, y) + apart(x0, y0)
                pair = code[left] * len(names) + code[right]
                order = np.argsort(pair, kind="stable")
                starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
                for c, v in zip(pair[order][starts].tolist(), np.add.reduceat(more[order], starts).tolist(), strict=True):
                    key = (int(names[c // len(names)]), int(names[c % len(names)]))
                    sums[key] = sums.get(key, 0) + v
        a = b


_PARTS = "gid long, other long, term string, value decimal(38,0)"


def _scanned(kept: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """Partial pairs (gid, other, null, value) and terms (gid, null, term, value) of each run, the latter `top` of a source and task at most."""
    rows = kept.drop("first").join(small_side(facts.select("gid", "whole", "lang_whole")), "gid")
    names = ["gid", "other", "term", "value"]

    def told(gid, other, term, value) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(other, pa.int64()), pa.array(term, pa.string()), pa.array(value, pa.int64()).cast(pa.decimal128(38, 0))], names)

    def best(gid: np.ndarray, term: pa.Array, value: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        order = pc.sort_indices(pa.table({"g": gid, "v": value, "t": term}), [("g", "ascending"), ("v", "descending"), ("t", "ascending")]).to_numpy()
        own = gid[order]
        starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1 if len(own) else 0))
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        order = order[rank < top]
        return gid[order], term.take(pa.array(order)), value[order]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        held = []
        for runs in _whole_runs(batches, []):
            starts = _starts(runs, ["lid", "term"])
            sizes = np.diff(np.append(starts, runs.num_rows))
            gid, n, whole, lang_whole = (runs.column(c).to_numpy() for c in ("gid", "n", "whole", "lang_whole"))
            p, p0 = share(n + 1, whole), 1 + SCALE // whole
            q = share(np.repeat(np.add.reduceat(n, starts), sizes) + 1, lang_whole)
            _pair_sums(gid, p, p0, sizes, sums)
            more = np.flatnonzero(p > q)
            held.append((gid[more], runs.column("term").combine_chunks().take(pa.array(more)), apart(p[more], q[more])))
            if sum(len(h[0]) for h in held) > SUMS:
                held = [best(*_joined(held))]
                if len(held[0][0]) > SUMS // 2:
                    yield told(held[0][0], [None] * len(held[0][0]), held[0][1], held[0][2])
                    held = []
            if len(sums) > SUMS:
                yield told([a for a, _ in sums], [b for _, b in sums], [None] * len(sums), list(sums.values()))
                sums = {}
        if held:
            gid, term, value = best(*_joined(held))
            yield told(gid, [None] * len(gid), term, value)
        if sums:
            yield told([a for a, _ in sums], [b for _, b in sums], [None] * len(sums), list(sums.values()))

    return stored(_sorted_by_term(rows).mapInArrow(scan, _PARTS), "parts")


def _joined(held: list[tuple]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])


def _alone(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """(gid, other, value): what each pair gets from the counts of either and from the terms that both lack; parts of sums."""
    whole = lambda c: c.cast("decimal(19,0)")
    counts = kept.groupBy("gid", "n").agg(F.count("*").alias("terms"))
    own = counts.join(small_side(facts.select("gid", "lid", "whole", "p0")), "gid")
    # as in share(): SCALE * (n + 1) may pass 64 bits
    own = own.withColumn("p", 1 + F.call_function("div", (F.col("n") + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.col("whole").cast("decimal(19,0)")))
    others = small_side(facts.select("lid", F.col("gid").alias("other"), F.col("p0").alias("q0"), F.col("has").alias("other_has")))
    met = own.join(others, "lid").where("gid <> other").select(
        "gid", "other", (whole(F.col("terms")) * whole(apart(F.col("p"), F.col("q0")))).alias("to"), (whole(F.col("terms")) * whole(apart(F.col("q0"), F.col("p")))).alias("from")
    )
    met = met.select(F.inline(F.array(F.struct("gid", "other", F.col("to").alias("value")), F.struct(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("from").alias("value")))))
    pairs = facts.select("gid", "lid", "p0", "has", "v").join(others, "lid").where("gid <> other")
    lacked = whole(F.col("v") - F.col("has") - F.col("other_has")) * whole(apart(F.col("p0"), F.col("q0")))
    return met.unionByName(pairs.select("gid", "other", lacked.alias("value")))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the `top` terms that mark a source."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*read)
    groups = _groups(docs)
    kept = kept_counts(docs, groups, min_docs)
    facts = _facts(kept, groups)
    parts = _scanned(kept, facts, top)
    alone = _alone(kept, facts).select("gid", "other", F.col("value").cast("decimal(38,0)").alias("value"))
    sums = alone.unionByName(parts.where("other is not null").select("gid", "other", "value")).groupBy("gid", "other").agg(F.sum("value").cast("long").alias("value"))
    source = facts.select("gid", "lang", "source")
    pairs = sums.join(small_side(source), "gid").join(small_side(source.select(F.col("gid").alias("other"), F.col("source").alias("item"))), "other")
    terms = parts.where("other is null").join(small_side(source), "gid").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
