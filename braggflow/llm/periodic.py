r"""Periodic runs of words: stretches in which a text repeats itself over and over.

A *run* is a stretch of consecutive words (``[^\x20\x09-\x0D]+``, compared exactly) with smallest period q, that is
words q apart are identical, of ``max(LEAST_LENGTH, LEAST_POWER * q)`` words or more, which neither neighbouring word
extends at that period.

1. Masking. A run overlaps itself, moved by its period, in at least ``GRAM`` words (the least of length - q over all q),
   and what overlaps covers the whole run. So each of its words lies in a GRAM-gram that the text has twice. Words in no
   such gram cannot join a run; stretches of the others survive. Grams are told apart by hashes: a collision lets a word
   survive for nothing, and no more.
2. Main-Lorentz on the surviving stretches, all of a slice of texts at once. Stretches are halved level by level; at each
   level every middle and every period up to a quarter of the stretch asks how far words agree with those a period
   further, forwards and backwards. These extensions are exact: they are looked up in ranks of all substrings of 1, 2,
   4, ... words. A run is found where a middle cuts it, at the first level that does.

Texts need no shuffle; each is taken whole by the task that reads it. A slice takes about 4 bytes a surviving word for
each doubling of the longest stretch, so a text is bounded by the task's memory alone (about 100 bytes a word).

Defined results: a null text counts as empty and has no runs and an empty collapsed text; a null id passes through; repeated
rows are told each for themselves; columns other than id and text are ignored (``apply`` passes them through); very long
texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.llm.bpe import in_slices

LEAST_LENGTH, LEAST_POWER = 6, 4


def least_length(period):
    return np.maximum(LEAST_LENGTH, LEAST_POWER * period)


#: Least overlap of a run with itself moved by its period.
GRAM = int(min(least_length(q) - q for q in range(1, LEAST_LENGTH + 1)))
_STEP = np.random.default_rng(29).integers(1, 1 << 63, GRAM + 1, dtype="u8") | np.uint64(1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a GRAM-gram that their text has twice; ids and text give the word and the text at each place."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(len(ids), bool)
    starts = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    key = sum((ids[i : i + n].astype("u8") * _STEP[i] for i in range(GRAM)), text[:n].astype("u8") * _STEP[GRAM])[starts]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    equal = np.diff(key[order]) == 0
    twice = starts[order[np.append(equal, False) | np.insert(equal, 0, False)]]
    cover = np.zeros(len(ids) + 1, "i4")
    cover[twice] += 1
    cover[twice + GRAM] -= 1
    return np.cumsum(cover)[:-1] > 0


class Agreement:
    """How many words agree from two places on, for arrays of places, by ranks of substrings of 2**j words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype("i4")]
        while 2 << (len(self.ranks) - 1) <= min(longest, len(ids)):
            last, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            pairs = last[:-half].astype("i8") * len(ids) + last[half:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype("i4"))

    def _steps(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        done = np.zeros(len(a), "i8")
        for j in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[j], 1 << j
            fits = np.flatnonzero(done + step <= most)
            shift = done[fits] if sign > 0 else -done[fits] - step
            done[fits[rank[a[fits] + shift] == rank[b[fits] + shift]]] += step
        return done

    def forwards(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b on, `most` at most."""
        return self._steps(a, b, most, 1)

    def backwards(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b, `most` at most."""
        return self._steps(a, b, most, -1)


def runs_in(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of the stretches [low, high) of ids, by start, then period."""
    agree = Agreement(ids, int((high - low).max(initial=1)))
    found = []
    left, right, lo, hi = low, high, low, high
    while len(left):
        wide = right - left >= LEAST_LENGTH
        left, right, lo, hi = left[wide], right[wide], lo[wide], hi[wide]
        middle, periods = (left + right) // 2, (right - left) // LEAST_POWER
        node = np.repeat(np.arange(len(left)), periods)
        p = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        m, first, last = middle[node], lo[node], hi[node]
        for a in (m, m - p):  # the run holds a whole period to the right of the middle, or to the left of it
            ok = (a >= first) & (a + p <= last)
            x, q, f, e = a[ok], p[ok], first[ok], last[ok]
            back = agree.backwards(x, x + q, x - f)
            ahead = agree.forwards(x, x + q, e - x - q)
            long = back + ahead + q >= least_length(q)
            found.append(np.stack([x - back, x + q + ahead, q])[:, long])
        left, right, lo, hi = np.concatenate([left, middle]), np.concatenate([middle, right]), np.tile(lo, 2), np.tile(hi, 2)
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), "i8")
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)  # multiples of the smallest period give the same stretch
    new[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _told(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs (start, length, period) and the collapsed text of each text."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], "i8")
    begin = np.cumsum(sizes) - sizes
    codes: list[int] = []
    for own in words:
        known: dict[bytes, int] = {}
        codes += [known.setdefault(w, len(known)) for w in own]
    ids, text = np.array(codes, "i8"), np.repeat(np.arange(len(texts)), sizes)
    alive = np.flatnonzero(surviving(ids, text))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(alive):
        return runs, [b" ".join(w) for w in words]
    cut = np.flatnonzero((np.diff(alive) != 1) | (np.diff(text[alive]) != 0)) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(alive)]])
    start, end, period = runs_in(ids[alive], low, high)
    start, length = alive[start], end - start
    drop = np.zeros(len(ids) + 1, "i8")
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    gone = np.cumsum(drop)[:-1] > 0
    of = text[start]
    for t, s, n, p in zip(of.tolist(), (start - begin[of]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append((s, n, p))
    for t in np.unique(of).tolist():
        left = np.flatnonzero(~gone[begin[t] : begin[t] + sizes[t]]).tolist()
        words[t] = [words[t][i] for i in left]
    return runs, [b" ".join(w) for w in words]


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): the runs of each text by start, then period, and its words without those after a run's first period."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(source.dtypes)["id"]
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 2 << 20):
                runs, collapsed = _told(part.column("text").cast(pa.binary()).to_pylist())
                listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], runs_type)
                yield pa.RecordBatch.from_arrays([part.column("id"), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return source.mapInArrow(work, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def apply(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every text collapsed, all other columns as they are; a text without runs keeps its white space, and null stays null."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, text_col, 2 << 20):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                runs, collapsed = _told([t or b"" for t in texts])
                new = pa.array([c if r else t for t, r, c in zip(texts, runs, collapsed, strict=True)], pa.binary()).cast(part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(work, schema)
