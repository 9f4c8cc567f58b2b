"""Source divergence and periodic runs against brute force, with the odd rows that tables have."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from braggflow.llm import divergence, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def audit(rows, min_docs=3, top=200):
    found, groups, seen = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        found[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // whole for t in kept}

        q = shares(sum((found[lang, s] for s in sources), Counter()))
        p = {s: shares(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(listed, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgé" for b in ("on", "ert", "漢", "ing", "Z")]
    rows = []
    for i in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 30)) + [rng.choice(["the", "THE", "x1y", "-", "rare" + "abcdefghij"[i % 10]])] * rng.randint(0, 9)
        rows.append((i, " ".join(own), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "", None, "é"])))
    rows += [rows[5]] * 3 + [(None, None, None, "none"), (1, "", "fr", "empty"), (2, "one two", "fr", "other"), (3, "one", "fr", "é")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # tables, expansions and sums that are full at once
        for name, value in (("TABLE_ENTRIES", 7), ("PAIRS", 3), ("SUMS", 4), ("STRETCH", 5)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("gid", "lid", "term", "n", "rank", "value")}).repartition(3)
    got = divergence.audit(df, top=5)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit(rows, top=5)
    assert divergence.audit(df.where("false")).count() == 0


def test_scale_of_shares():
    import numpy as np

    rng = random.Random(5)
    whole = [rng.randint(1, 9 * 10**15) for _ in range(300)]
    count = [rng.randint(1, w) for w in whole]
    assert divergence.share(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * c // w for c, w in zip(count, whole, strict=True)]


def runs_of(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(words[i : j + q - r] == words[i + r : j + q] for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts():
    rng = random.Random(9)
    texts = [None, "", " \n", "a " * 5, "a " * 6, "a " * 3000, "A a " * 8, "a\x1cb " * 9, "é " * 7 + "漢 é " * 6]
    for _ in range(250):
        own, n = [], rng.randint(0, 90)
        while len(own) < n:
            unit = rng.choices("abcdefgh"[: rng.choice([1, 2, 3, 8])], k=rng.randint(1, 7))
            own += (unit * 9)[: rng.randint(1, 9 * len(unit))] if rng.random() < 0.5 else [rng.choice("abcdefghijk")]
        texts.append(" \t\n"[rng.randint(0, 2)].join(own))
    unit = [f"w{i}" for i in range(700)]
    return texts + [" ".join(unit * 5 + unit[:30]), " ".join((["x"] * 9 + unit[:40]) * 6)]


def collapsed(words):
    gone = {i for s, n, q in runs_of(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force(spark, monkeypatch):
    texts = periodic_texts()
    df = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "runs", "start", "collapsed")}).repartition(3)
    # bytes.split() cuts at the same six characters as the pattern
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.detect(df).collect())
    assert got == Counter((None if i == 3 else i // 2, tuple(runs_of(split(t))), collapsed(split(t))) for i, t in enumerate(texts))
    assert periodic.detect(df.where("false")).count() == 0
    kept = periodic.apply(df)
    assert kept.schema == df.schema
    assert Counter(r.text for r in kept.collect()) == Counter(collapsed(split(t)) if runs_of(split(t)) else t for t in texts)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "\n ".join(rng.choices([f"w{j}" for j in range(rng.choice([3, 500]))], k=rng.choice([0, 1, 9, 200])))) for i in range(150)] + [(None, "a b " * 9), (7777, None)]
    spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in rows:
        words, planted = (text or "").split(), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if planted % 10 == 0 and words:
            g, n = planted // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_of(words)
        start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        top = (start, length, period, None if period is None else 1000 * length // period)
        assert got[doc_id] == (len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words))), doc_id
    assert sum(v[0] > 0 for v in got.values()) > 10
