"""Connected groups, line dedup, near-dedup and the pipeline against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from braggflow.llm import bpe, graph, line_dedup, near_dedup
from tests.llm.test_text_operators import brute_quality, lower, words


class Groups:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def root(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)])


def near_groups(docs):
    sets = {i: shingles(t) for i, t in docs}
    found = Groups(sets)
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                found.join(a, b)
    return {i: (len(sets[i]), found.root(i)) for i in sets}


def distance(a, b):
    row = np.arange(len(b) + 1)
    letters = np.array(list(b))
    for i, c in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def line_groups(docs):
    """What line dedup leaves of each document, by edit similarity alone: (text, lines, lines that went)."""
    norm = {}
    for i, t in docs:
        for at, line in enumerate(t.split("\n") if t is not None else []):
            plain = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")
            if len(plain) >= line_dedup.MIN_CHARS:
                norm[i, at] = plain
    distinct = sorted(set(norm.values()))
    found = Groups(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i + 1, len(distinct)):
            least, most = sorted((len(distinct[i]), len(distinct[j])))
            if least >= 0.8 * most and distance(distinct[i], distinct[j]) <= int(0.2 * most + 1e-9):
                found.join(i, j)
    at, keep = {line: i for i, line in enumerate(distinct)}, {}
    for place, line in sorted(norm.items(), key=lambda x: x[0]):
        keep.setdefault(found.root(at[line]), place)
    out = {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        left = [line for n, line in enumerate(lines) if (i, n) not in norm or keep[found.root(at[norm[i, n]])] == (i, n)]
        out[i] = (None if t is None else "\n".join(left), len(lines), len(lines) - len(left))
    return out


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30)], "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)], "none": []}[shape]
    found = Groups({i for e in edges for i in e})
    for a, b in edges:
        found.join(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {i: found.root(i) for i in found.parent if i not in loops}


def test_link_loses_no_link(spark):
    """Buckets of many groups, where only neighbours in value are links: every round and the rest are needed."""
    rng = random.Random(2)
    value = {i: rng.randint(0, 400) for i in range(120)}
    buckets = [(b, i) for b in range(3) for i in value if rng.random() < 0.8]
    for rounds in (0, 1, 4):
        test = lambda pairs: pairs.where(F.abs(F.element_at(lookup, F.col("a")) - F.element_at(lookup, F.col("b"))) <= 3)
        lookup = F.create_map(*[F.lit(x) for i, v in value.items() for x in (i, v)])
        edges = graph.link(spark.createDataFrame(buckets, "bucket long, id int"), test, rounds=rounds)
        expect, got = Groups(value), Groups(value)
        for b in range(3):
            own = [i for c, i in buckets if c == b]
            for i in own:
                for j in own:
                    if abs(value[i] - value[j]) <= 3:
                        expect.join(i, j)
        for r in edges.collect():
            got.join(r.a, r.b)
        assert {i: got.root(i) for i in value} == {i: expect.root(i) for i in value}


def near_documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = [(50, " ".join(base))]

    def edited(n):
        own = list(base)
        for at in rng.sample(range(len(base)), n):
            own[at] = f"x{rng.randint(0, 10**6)}"
        return " ".join(own)

    docs += [(100 + i, edited(rng.choice([1, 1, 2, 3, 4]))) for i in range(90)]  # near and nearly near copies of one text
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs += [(300 + i, " ".join([*rng.choices(vocabulary, k=60), *passage, *rng.choices(vocabulary, k=40)])) for i in range(40)]
    own = list(base)
    for i in range(25):  # a chain whose ends are far apart
        docs.append((400 + i, " ".join(own)))
        own[rng.randint(0, 119)] = f"y{i}"
    docs += [(500, "a b"), (501, "A  b"), (502, ""), (503, None), (504, "\n"), (505, "a b c d e"), (506, " ".join(base).upper())]
    return docs


def test_near_dedup_equals_brute_force(spark):
    docs = near_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "cid", "sig", "kept", "bucket")}).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(df).collect()}
    expect = near_groups(docs)
    assert got == expect
    kept = near_dedup.apply(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expect.items() if i == c}
    assert near_dedup.groups(df.where("false")).count() == 0


def test_near_dedup_without_order(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_VALUES", 3)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    docs = near_documents()[:110]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_groups(docs)


def test_near_dedup_repeats_and_nulls(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "q r s t u v w")]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept, r.doc_id) for r in got)[0][1:] == (1, False, 2)
    assert [r.kept for r in got if r.doc_id is None] == [True]


def line_documents():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(600)]
    base = [rng.choice(vocabulary) for _ in range(50)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(3):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randint(0, 49)] = rng.choice(vocabulary)
            lines.append(" ".join(own))
        lines += [" ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 30, 300]))), "short", "", "buy now " * rng.randint(3, 30)]
        docs.append((i, "\n".join(lines)))
    return docs + [(900, None), (901, ""), (902, "\n\n"), (-5, " ".join(base).upper() + "!!")]


def test_line_dedup_equals_brute_force(spark):
    docs = line_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "at", "doc", "lid", "occ", "dropped")}).repartition(3)
    got = {r.doc.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.apply(df).collect()}
    assert got == line_groups(docs)
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and out.where("doc_id in (900, 901, 902)").count() == 3
    assert line_dedup.apply(df.where("false")).count() == 0


def test_line_dedup_repeats_and_nulls(spark):
    line = "the same long line of many words in all"
    rows = [(None, line), (3, line), (3, line), (4, f"{line}\nand another line that is its own")]
    got = sorted((r.doc.doc_id or 0, r.text) for r in line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, line), (3, ""), (3, ""), (4, "and another line that is its own")]
    assert line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_long_lines_are_compared(spark):
    rng = random.Random(1)
    words_ = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    near = [*words_[:2000], "other", *words_[2001:]]
    got = {r.doc.doc_id: r.n_dropped for r in line_dedup.apply(spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(near))], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"term{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, text(20)) for i in range(4)]
    docs = [(i, "\n".join(text(rng.randint(8, 40)) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(6)] + [(200 + i, docs[i][1].replace("term1", "termx", 2)) for i in range(10)]
    docs += [(300 + i, f"{text(15)}\n{bench[i][1]}") for i in range(4)] + [(400, None), (401, ""), (402, "too short"), (403, "again and again now " * 20)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", 1) for i, t in docs], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in docs if not brute_quality(t)[5]]
    deduped = line_groups(left)
    left = [(i, deduped[i][0]) for i, _ in left if not deduped[i][2] or words(deduped[i][0])]
    groups = near_groups(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    grams = {tuple(words(t)[i : i + 13]) for _, t in bench for i in range(8)}

    def contaminated(t):
        own = words(t)
        hit = {j for i in range(len(own) - 12) if tuple(own[i : i + 13]) in grams for j in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(own)

    left = {i: t for i, t in left if not contaminated(t)}
    assert 0 < len(left) < len(docs) and got.keys() == left.keys()
    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in left.items():
        assert got[i].decoded == t and np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, df.where("false"), str(tmp_path)).columns == df.columns, name
