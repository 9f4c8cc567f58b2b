r"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; fewer
words: the whole sequence as one). Documents with at least 85 % of their union in common are linked.

1. One pass over the texts gives each document its set's size, digest and 64-coordinate MinHash
   signature. Documents of equal digest form a class; one signature stands for it.
2. A pair above the threshold agrees on 40 of the 64 coordinates or more, but for a chance below
   1e-5. So it shares at least one of any 25 coordinate-value pairs in a fixed order (prefix). The
   order puts rare coordinate-value pairs first, by counts over all classes, so values that come from
   passages shared by many documents are skipped. Classes are posted under their prefix alone.
3. In a short posting list each pair counts whose sizes allow a link. Longer ones are merged by their centres instead (see graph.link); a pair's
   collisions over all coordinates are counted, and pairs above the match threshold are confirmed on
   the full shingle sets of both texts.
4. Posting lists that stay open hold documents that are alike but below the threshold. They are joined
   again by what tells them apart: each set's difference D from the list's first centre. Sets of sizes
   n and m above the threshold differ in at most a = 15 / 185 * (n + m) shingles, so their differences
   share at least (|D| + |D'| - a) / 2. A *near* set (one whose D is within a of the centre) is linked to
   the centre already, so only links of *far* sets are sought; both are posted under the rarest parts
   of D that such a link needs, but for shingles that no other document has. A far set leaves a list in
   which no partner can share enough with it. This filter is exact; its pairs go through the same two tests as in 3.
5. Connected groups of confirmed links get the smallest document id.

The order is kept for at most ``HOT_VALUES`` frequent values; any order is right, so the bound is on
speed only. Signatures, sets and links stay in tables; the driver sees counts and the bounded order.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a
null id has no component of its own to name, gets a null component and is kept; repeated rows are in
one class and share the result; other columns are ignored (``apply`` passes them through); very long
texts are hashed in stretches; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.llm.bpe import in_slices
from braggflow.llm.common import discard, small_side, stored
from braggflow.llm.graph import components, link
from braggflow.llm.words import VISIBLE, window_hashes, words_of

SHINGLE, PERCENT = 5, 85
COORDINATES, MATCHES = 64, 40
PREFIX = COORDINATES - MATCHES + 1
#: A value more frequent than this goes into the order of frequent values; at most so many go in.
HOT_COUNT, HOT_VALUES = 16, 400_000
#: Members of a posting list that are held against each other at once; longer lists are merged by their centres.
SMALL = 32
#: Sets or signatures that are broadcast, in units of 100 bytes; more are shuffled. 4 MB: a larger table would fill the driver.
SENT = 40_000
#: Centre rounds over signature postings.
ROUNDS = 1
_A = np.random.default_rng(101).integers(1, 1 << 63, COORDINATES, dtype="u8") | np.uint64(1)
_B = np.random.default_rng(103).integers(1, 1 << 63, COORDINATES, dtype="u8")


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(np.frombuffer(text, "u1"), VISIBLE)[2]
    n = min(SHINGLE, len(words))
    return np.unique(window_hashes(words, [n])[n]) if n else np.empty(0, "u8")


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set."""
    least = np.full(COORDINATES, np.iinfo("u8").max, "u8")
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[i : i + 2048, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype("u4")


def _rows(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names)


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, d1, d2, sig) of each document, stored in the shared folder."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                sizes, digests, sigs = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    found = shingles(text)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sigs.append(signature(found).tobytes() if len(found) else None)
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                arrays = [part.column("id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary())]
                yield _rows(arrays, ["id", "text_key", "n_shingles", "d1", "d2", "sig"])

    return stored(source.mapInArrow(work, "id long, text_key long, n_shingles long, d1 long, d2 long, sig binary"), "sketch")


def classes_of(sketched: DataFrame) -> DataFrame:
    """(cid, d1, d2, rep, n, sig): one row for each distinct set that is not empty; rep is its smallest id."""
    known = sketched.where("n_shingles > 0 and id is not null")
    found = known.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    return stored(found.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _values(sigs: list[bytes]) -> np.ndarray:
    """Coordinate-value pairs as 64-bit integers, a row for each signature."""
    table = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES).astype("i8")
    return table | (np.arange(COORDINATES, dtype="i8") << 32)


def _frequent(values: DataFrame, more_than: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent values and their counts, of partial counts (value, n); HOT_VALUES of them at most."""
    counts = values.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > more_than)
    top = counts.orderBy(F.desc("n"), "value").limit(HOT_VALUES).toPandas().sort_values("value")
    return top["value"].to_numpy("i8"), top["n"].to_numpy("i8")


def _ranks(values: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of values in the order of frequent values, 0 for those outside."""
    hot, n = order
    if not len(hot):
        return np.zeros(values.shape, "i8")
    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
    return np.where(hot[at] == values, n[at], 0)


def _counted(arrays: list[np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(arrays), return_counts=True)
    return _rows([pa.array(values), pa.array(n.astype("i8"))], ["value", "n"])


def postings(classes: DataFrame) -> DataFrame:
    """(bucket, id, n, often): each class and its set's size under the rarest PREFIX of its coordinate-value pairs; often: the pair is in the order of frequent values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _counted(list(_values(batch.column("sig").to_pylist())))

    counts = classes.select("sig").mapInArrow(count, "value long, n long")
    order = classes.sparkSession.sparkContext.broadcast(_frequent(counts, HOT_COUNT))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch.column("sig").to_pylist())
            ranks = _ranks(values, order.value)
            rarest = np.lexsort((values, ranks), axis=1)[:, :PREFIX]
            ids, n = (np.repeat(batch.column(c).to_numpy(), PREFIX) for c in ("cid", "n"))
            posted, often = (np.take_along_axis(x, rarest, axis=1).reshape(-1) for x in (values, ranks > 0))
            yield _rows([pa.array(posted), pa.array(ids), pa.array(n), pa.array(often)], ["bucket", "id", "n", "often"])

    return classes.select("cid", "n", "sig").mapInArrow(work, "bucket long, id long, n long, often boolean")


def in_lists(rare: DataFrame, often: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) in lists of `small` members or fewer whose sizes allow a link, and (bucket, id) of longer lists.

    rare, often: postings (bucket, id, n); buckets of `often` are known to be shared, and it is stored. Only `rare` is dealt and sorted
    as it comes, once: no key of it is hot. Of `often` the lists are counted first, and short ones join in.
    """

    def told(bucket: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(bucket)))
        pairs = []
        for k in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():
            rows = starts[sizes == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            left, right = rows[:, i].reshape(-1), rows[:, j].reshape(-1)
            ok = np.abs(n[left] - n[right]) <= most_apart(n[left], n[right])
            pairs.append(np.sort(np.stack([ids[left[ok]], ids[right[ok]]]), axis=0))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), "i8")
        large = np.repeat(sizes > small, sizes)
        buckets = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(bucket[large])])
        others = pa.concat_arrays([pa.array(b), pa.nulls(int(large.sum()), pa.int64())])
        return _rows([buckets, pa.array(np.concatenate([a, ids[large]])), others], ["bucket", "a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, "i8")] * 3
        for batch in batches:
            rows = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("bucket", "id", "n"), strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last list may go on
            if cut:
                yield told(*[r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]
        if len(rest[0]):
            yield told(*rest)

    sizes = stored(often.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    some = often.join(small_side(sizes.where(F.col("k") <= small).select("bucket")), "bucket").select("bucket", "id", "n")
    found = stored(rare.unionByName(some).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scan, "bucket long, a long, b long"), "lists")
    large = often.join(small_side(sizes.where(F.col("k") > small).select("bucket")), "bucket").select("bucket", "id")
    large = stored(large.unionByName(found.where("bucket is not null").select("bucket", F.col("a").alias("id"))), "large-lists")
    return found.where("bucket is null").select("a", "b").distinct(), large


def most_apart(n: int, m: int) -> int:
    """In how many shingles sets of n and m may differ and still be linked."""
    return (100 - PERCENT) * (n + m) // (100 + PERCENT)


def difference_prefix(d: int, n: int, centre: int) -> tuple[int, bool]:
    """(rarest parts of its difference to post, whether it is far) for a set of size n that differs in d from a centre of some size.

    A near set is linked to the centre, and so to all other near sets; only links that have a far set need to be found.
    Sets that differ in d and d' from the centre are linked if their differences share (d + d' - most_apart) / 2 parts at least.
    """
    if d <= most_apart(n, centre):  # a far partner differs in more than most_apart(partner, centre), which leaves 17 / 37 of d to share
        return d - max(1, d * 17 // 37) + 1 if d else 0, False
    return min(d, most_apart(n, 100 * n // PERCENT) + 1), True


def difference_postings(sets: DataFrame, frames: DataFrame) -> DataFrame:
    """(bucket, id) of framed ids (centre, id): a bucket is a centre and a part of the difference, and has a far set that may have a link in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "members"):
                yield _counted([np.frombuffer(m, "i8") for m in part.column("members").to_pylist()])

    members = sets.join(frames.select(F.col("id").alias("cid")).distinct(), "cid", "left_semi").select("members")
    found = _frequent(members.mapInArrow(count, "value long, n long"), 1)
    complete = len(found[0]) < HOT_VALUES  # then a shingle outside the order is one document's own, and meets no other
    order = sets.sparkSession.sparkContext.broadcast(found)
    names = ["bucket", "id", "far", "d", "n", "reach"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "own", 1 << 20):
                columns = [[] for _ in names]
                for centre, cid, mid, own in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    mid, own = np.frombuffer(mid, "i8"), np.frombuffer(own, "i8")
                    more, less = np.setdiff1d(own, mid, assume_unique=True), np.setdiff1d(mid, own, assume_unique=True)
                    # rarest first: what few have, then what few lack
                    rank = _ranks(more, order.value)
                    alone = int((rank == 0).sum()) if complete else 0
                    more, less = more[np.lexsort((more, rank))], less[np.lexsort((less, -_ranks(less, order.value)))]
                    parts = np.concatenate([more.view("u8"), less.view("u8") ^ _A[1]])
                    parts = (parts ^ (parts >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    d = len(parts)
                    n, far = difference_prefix(d, len(own), len(mid))
                    posted = parts[alone:n] + np.uint64(centre * int(_A[2]) & (1 << 64) - 1)
                    # what two sets share from here on is at most what is left of either; reach is twice that, less d
                    reach = 2 * (d - np.arange(alone, alone + len(posted))) - d
                    k = len(posted)
                    for column, values in zip(columns, (posted.view("i8"), np.full(k, cid), np.full(k, far), np.full(k, d), np.full(k, len(own)), reach), strict=True):
                        column.append(values)
                if columns[0]:
                    yield _rows([pa.array(np.concatenate(c)) for c in columns], names)

    centres = stored(sets.join(frames.select(F.col("centre").alias("cid")).distinct(), "cid", "left_semi"), "centres")
    own = sets.select(F.col("cid").alias("id"), F.col("members").alias("own"))
    schema = "bucket long, id long, far boolean, d long, n long, reach long"
    posted = stored(small_side(frames).join(own, "id").join(_sent(centres), "centre").select("centre", "id", "mid", "own").mapInArrow(work, schema), "differences")
    # a far set needs a partner whose reach is d - most_apart(n, partner's n) at least
    most = posted.groupBy("bucket").agg(F.max("reach").alias("most_reach"), F.max("n").alias("most_n"), F.count_if("far").alias("k"), F.count("*").alias("m")).where("k > 0 and m > 1")
    apart = F.floor((100 - PERCENT) * (F.col("n") + F.least(F.floor(100 * F.col("n") / PERCENT), "most_n")) / (100 + PERCENT))
    left = posted.join(most, "bucket").where(~F.col("far") | (F.col("d") - apart <= F.col("most_reach")))
    left = stored(left.select("bucket", "id", "far"), "differences")
    useful = left.groupBy("bucket").agg(F.count_if("far").alias("k"), F.count("*").alias("m")).where("k > 0 and m > 1").select("bucket")
    out = stored(left.join(useful, "bucket").select("bucket", "id").distinct(), "differences")
    discard(posted, left, centres)
    return out


def of_ends(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of classes (cid, ...) that pairs (a, b) have at an end, stored, so that no other row moves when they are joined."""
    ends = stored(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "ends")
    out = stored(classes.join(small_side(ends), "cid", "left_semi"), "end-rows")
    discard(ends)
    return out


def matching(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that agree on MATCHES coordinates, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_values(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= MATCHES))

    sigs = of_ends(classes.select("cid", "sig"), pairs)
    side = lambda c: few_sent(sigs.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}")), f"sig_{c}")
    out = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long"), "near")
    discard(sigs)
    return out


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, shingled: Callable[[bytes], np.ndarray] = shingles) -> DataFrame:
    """(cid, members): the full shingle sets of wanted classes (cid), read from the documents again, stored."""
    wanted = stored(classes.join(wanted, "cid").select("cid", "rep", "d1", "d2"), "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows give a set once for each task
        for batch in batches:
            for part in in_slices(batch, "text", 2 << 20):
                found = [shingled(t).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                digests = [xxhash.xxh3_128_digest(f) for f in found]
                keys = list(zip(part.column("id").to_pylist(), digests, strict=True))
                new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                d = np.frombuffer(b"".join(digests[i] for i in new), "<i8").reshape(-1, 2)
                yield _rows([part.column("id").take(pa.array(new, pa.int64())), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([found[i] for i in new], pa.binary())], ["id", "e1", "e2", "members"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(small_side(wanted.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    whole = texts.mapInArrow(work, "id long, e1 long, e2 long, members binary")
    whole = whole.join(small_side(wanted), (F.col("id") == F.col("rep")) & (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2"))).select("cid", "members")
    out = stored(whole, "sets")
    discard(wanted)
    return out


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have PERCENT of their union in common, stored.

    The end of a pair that has more pairs is its centre: few sets are centres, so these go to the others where they are small
    enough, and no other set moves.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own").to_pylist(), batch.column("mid").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n"))
    told = pairs.join(degree.select(F.col("cid").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("cid").alias("b"), F.col("n").alias("n_b")), "b")
    centre = F.when(F.col("n_a") > F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    told = stored(told.select("a", "b", centre.alias("centre"), (F.col("a") + F.col("b") - centre).alias("cid")), "pairs")
    mid = stored(sets.join(small_side(told.select(F.col("centre").alias("cid")).distinct()), "cid", "left_semi"), "centres")
    out = stored(sets.withColumnRenamed("members", "own").join(small_side(told), "cid").join(_sent(mid), "centre").select("a", "b", "own", "mid").mapInArrow(work, "a long, b long"), "confirmed")
    discard(told, mid)
    return out


def few_sent(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a stored table, broadcast if what the column has is no more than SENT."""
    return small_side(rows, SENT // 2, weight=F.floor(F.octet_length(column) / 100))


def _sent(centres: DataFrame) -> DataFrame:
    """(centre, mid) of stored sets (cid, members), broadcast if they are few."""
    return few_sent(centres.select(F.col("cid").alias("centre"), F.col("members").alias("mid")), "mid")


def links(docs: DataFrame, classes: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) of classes, enough to connect every pair above the threshold."""

    def test(pairs: DataFrame) -> DataFrame:
        near = matching(classes, pairs)
        ends = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
        sets = sets_of(docs, classes, ends, id_col=id_col, text_col=text_col)
        good = confirmed(sets, near)
        discard(near, sets)
        return good

    def finish(frames: DataFrame, groups: DataFrame | None) -> DataFrame:
        wanted = frames.select(F.col("id").alias("cid")).union(frames.select("centre")).distinct()
        sets = sets_of(docs, classes, wanted, id_col=id_col, text_col=text_col)
        return link(difference_postings(sets, frames), lambda pairs: confirmed(sets, matching(classes, pairs)), rounds=0, groups=groups)

    placed = stored(postings(classes), "postings")
    rare, often = (placed.where(which).select("bucket", "id", "n") for which in ("not often", "often"))
    pairs, large = in_lists(rare, often, SMALL)
    near = test(stored(pairs, "pairs"))
    more = link(large, test, rounds=ROUNDS, finish=finish, groups=components(near))
    return near.unionByName(more.select("a", "b"))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept) of each document."""
    sketched = sketch(docs, id_col=id_col, text_col=text_col)
    classes = classes_of(sketched)
    labels = components(links(docs, classes, id_col=id_col, text_col=text_col))
    reps = classes.select("cid", "d1", "d2", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    reps = reps.withColumn("component", F.coalesce("component", "cid"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(reps.join(least, "component").select("d1", "d2", "component_id"), "components")
    discard(classes, labels)
    out = sketched.select("id", "text_key", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = out.withColumn("component_id", own)
    return out.select(
        F.col("id").alias(id_col), "text_key", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    gone = groups(docs, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key")).distinct()
    gone = small_side(stored(gone, "gone"))
    return docs.join(gone, (docs[id_col].cast("long") == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key")), "left_anti")
