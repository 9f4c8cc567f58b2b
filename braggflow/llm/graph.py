"""Links and connected groups, as joins and grouped minima.

``components`` contracts a graph: in each round every group hooks onto its smallest neighbour, hooks
are followed to their end, and edges are renamed. Rounds needed grow with the logarithm of the number
of nodes for paths as for stars. Each round is written to the shared folder, so lineage stays short.

``link`` connects all pairs that share a bucket and pass a test, without making the pairs of a bucket.
One aggregation of the postings leaves count, least, greatest and exclusive-or of each bucket's ids: that
names the members of buckets of two or three, so only the postings of larger buckets are read again.
In each round a larger bucket has a centre, which is tested against the bucket's other members: rows
grow in proportion to the postings. The centre then leaves, and a bucket is done when all that is left
of it lies in one connected group, since further links could not change any group. Buckets of copies
or near copies end so after a round or two. What is still open after `rounds` rounds, where members of
different groups share a bucket but are no links, goes to `finish` if the caller has a sharper filter
for it. Otherwise `finer` may part the open buckets, and more rounds follow. There all members outside a
bucket's largest group ask the others at once if they are few, so a large group with some strangers ends
in one round; where they are many, the number of centres grows eightfold each round, so a bucket of n
members ends after about log8(n) rounds. Only in the latter may tests grow faster than the postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.llm.common import discard, small_side, stored


#: Centres that a bucket may have at once in the rounds after the first ones.
FEW_CENTRES = 64


def _is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node."""
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = stored(nodes.withColumn("component", F.col("node")), "labels")
    while not _is_empty(live):
        both = live.union(live.select("b", "a"))
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("to")).where(F.col("to") < F.col("a")), "hooks")
        while True:  # follow hooks to their end
            on = hooks.select(F.col("a").alias("to"), F.col("to").alias("further"))
            if _is_empty(hooks.join(on, "to", "left_semi")):
                break
            jumped = stored(hooks.join(on, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "hooks")
            discard(hooks)
            hooks = jumped
        renamed = live
        for end in ("a", "b"):
            to = hooks.select(F.col("a").alias(end), F.col("to").alias(f"{end}_to"))
            renamed = renamed.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        renamed = renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new_live = stored(renamed, "edges")
        to = hooks.select(F.col("a").alias("component"), "to")
        new_labels = stored(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        discard(live, labels, hooks)
        live, labels = new_live, new_labels
    discard(live)
    return labels


def _few(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of buckets of two and of three ids."""
    pairs = buckets.where("n = 2").select("a", "b")
    three = buckets.where("n = 3").withColumn("c", F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b")))
    return pairs.union(three.select(F.inline(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("c").alias("a"), "b")))))


def _open(live: DataFrame) -> DataFrame:
    """(bucket, id, group, n, others, largest, score) of the postings (bucket, id, group) in buckets of two groups or more, stored.

    n: members of the bucket; others: those outside its largest group; score: small groups first, since what they have to be
    held against shrinks fastest.
    """
    live = stored(live, "rest")
    in_group = stored(live.groupBy("bucket", "group").agg(F.count("*").alias("k")), "groups")
    facts = in_group.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("group", F.struct("k", "group")).alias("largest"))
    facts = facts.where("groups > 1").select("bucket", "n", (F.col("n") - F.col("most")).alias("others"), "largest")
    own = in_group.join(small_side(stored(facts, "open")), "bucket").withColumn("score", -F.col("k")).drop("k")
    out = stored(live.join(own, ["bucket", "group"]), "postings")
    discard(live, in_group)
    return out


def link(postings: DataFrame, test: Callable[[DataFrame], DataFrame], *, rounds: int = 2, refine: Callable[[DataFrame], DataFrame] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, finish: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among ids that share a bucket, enough to connect all that test() accepts.

    postings: distinct (bucket, id). test: from distinct pairs (a, b), those that are links. refine: from postings of
    buckets of four ids or more, postings that part them further but no two that may be linked. finer: the same of open
    postings, but for few links. finish: from distinct (centre, id), where id is in an open bucket whose first centre it
    was tested against, and the groups so far, enough links to connect all links among ids of equal centres.
    groups: (node, component) of ids that are known to be connected.
    """
    counts = [F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor("id").alias("x")]
    buckets = stored(postings.groupBy("bucket").agg(*counts).where("n > 1"), "buckets")
    few = _few(buckets)
    live = stored(postings.join(small_side(buckets.where("n > 3").select("bucket", "n")), "bucket"), "postings")
    if refine is not None:
        parts = refine(live.select("bucket", "id"))
        parts = stored(parts.join(parts.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "postings")
        discard(live)
        live = parts
    popular = live.groupBy("id").agg(F.sum("n").alias("score"))  # who shares most buckets with most others comes first
    scored = live.join(popular, "id").select("bucket", "id", "n", F.col("id").alias("group"), F.col("score").cast("long").alias("score"))
    if groups is not None:
        scored = scored.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "group")).drop("component")
    scored = stored(scored, "postings")
    discard(live)
    live, edges, tried, labels = scored, [], [], None
    known_before = [] if groups is None else [stored(live.where("id <> group").select(F.col("id").alias("a"), F.col("group").alias("b")).distinct(), "known")]
    if rounds == 0:
        live = _open(live.select("bucket", "id", "group"))
    centres_of, r = FEW_CENTRES // 8, 0
    first_centres = None
    while True:
        open_ = not _is_empty(live)
        if not open_ and (r or _is_empty(few)):
            break
        if open_ and r == rounds and finish is not None:
            framed = live.select("bucket", "id").join(first_centres, "bucket").where("id <> centre").select("centre", "id").distinct()
            framed = stored(framed, "open")
            edges.append(stored(finish(framed, labels).select("a", "b"), "links"))
            discard(framed)
            break
        if open_ and r == rounds and finer is not None:
            known = live.select("id", "group").distinct()
            parts = finer(live.select("bucket", "id")).distinct().join(known, "id")
            parted = _open(parts)
            discard(live)
            live = parted
        if r >= rounds:
            centres_of *= 8
        if r < rounds:
            centre = live.groupBy("bucket").agg(F.max_by("id", F.struct("score", "id")).alias("centre"))
        else:  # all outside the largest group if they are few, otherwise about so many by hash, and the one of least hash
            hashed = F.xxhash64("bucket", "id")
            chosen = F.when(F.col("others") <= centres_of, F.col("group") != F.col("largest")).otherwise(F.pmod(hashed, F.floor(F.col("n") / centres_of) + 1) == 0)
            centre = live.where(chosen).select("bucket", F.col("id").alias("centre"))
            centre = centre.union(live.where(F.col("others") > centres_of).groupBy("bucket").agg(F.min_by("id", hashed))).distinct()
        centre = stored(centre.join(live.select("bucket", F.col("id").alias("centre"), F.col("group").alias("c_group")), ["bucket", "centre"]), "centres")
        pairs = live.join(centre, "bucket").where("group <> c_group").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        pairs = (pairs if r else pairs.union(few)).distinct()
        for done in tried:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried.append(pairs)
        good = stored(test(pairs).select("a", "b"), "links")
        edges.append(good)
        if not open_:
            break
        if r == 0:
            first_centres = centre.select("bucket", "centre")
        if not _is_empty(good):
            discard(*([labels] if labels is not None else []))
            labels = components(_union([*known_before, *edges]))
        # who has asked everybody leaves; buckets that are one group by now are done
        rest = live.select("bucket", "id", "group").join(centre.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_anti")
        if labels is not None:
            to = labels.select(F.col("node").alias("group"), "component")
            rest = rest.join(to, "group", "left").select("bucket", "id", F.coalesce("component", "group").alias("group"))
        after = _open(rest)
        discard(live)
        live = after
        r += 1
    out = _union(edges) if edges else few.limit(0)
    discard(live, *tried, *known_before)
    return out


def _union(edges: list[DataFrame]) -> DataFrame:
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    return found
