"""Chat, tokenizers, licenses, decontamination, quality and URLs against brute force, with the odd rows that tables have."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from braggflow.llm import bpe, chat, decontam, licenses, quality, token_counts, token_io, url_filter

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Don't  stop\n\nnow é漢字🙂 <|endoftext|> x"), (4, "Don't  stop\n\nnow é漢字🙂 <|endoftext|> x"), (None, "a b"), (5, "z" * 3000 + " 12 " * 700), (6, "\x1c\x85\xa0'S 't ſK Σς")]
PATTERN = public_tokenizers.PATTERN


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names the operators use inside
    return df.withColumns({c: F.lit(c) for c in ("id", "ids", "row", "n_words", "source", "host", "key", "hit0", "rule")}) if extra else df


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_chat_reads_back_and_folds(spark):
    texts = [r"\### Assistant: </turn> ok", "\\e\\h\\t", "", None, "###</turn>\n### user: x", "é🙂"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(1, 3, "assistant", "tie"), (None, 0, None, "n"), (2, None, "as:si%st<a#nt\n", "role")]
    rows += [(3, i, "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).drop("seq").withColumn("formatted", F.lit("x"))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.raw_events(df), message=["seq", "tie"]))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.read_back(chat.render(chat.fold(chat.raw_events(df.where("false")), message=["seq", "tie"]))).count() == 0


def test_chat_events(spark):
    log = [("m", 0, "message", "user", "hi"), ("a", 1, "delta", "assistant", "he"), ("a", 2, "delta", None, "llo"), ("a", 4, "regenerate", None, None), ("a", 5, "delta", None, "by"), ("a", 6, "delta", None, "e"), ("m", 7, "edit", None, "hey")]
    df = spark.createDataFrame([(9, *r) for r in log], "conv_id long, msg_id string, seq long, kind string, role string, text string")
    got = sorted((r.seq, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(0, "user", "hey"), (1, "assistant", "bye")]


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(path, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "ab éÉß \n\t\x1c\x85  's't12٣ 漢字🙂-.,<|endoftext|>\xa0"
    rows = ODD + [(100 + i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(300)]
    coded = bpe.encode(table(spark, rows), path, PATTERN)
    both = bpe.decode(coded, path, PATTERN).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in both) == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    fused = bpe.encode(table(spark, rows), path, PATTERN, decoded=True).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in fused) == Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both)
    assert bpe.encode(table(spark, rows).where("false"), path, PATTERN).count() == 0
    long = "ab" * 20_000
    assert bpe.merge(long.encode(), enc.ranks) == library.encode_ordinary(long)


def test_bpe_long_texts_and_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 50)
    monkeypatch.setattr(bpe, "RUN", 7)
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN)
    text = "The quick brown fox, jumps over\n\n the lazy dog. " * 20
    enc.cache.limit = 3
    first = enc.encode(text)
    assert enc.decode(first) == text.encode() and len(enc.cache) <= 3
    monkeypatch.setattr(bpe, "LONG_CHARS", 1 << 20)
    assert enc.encode(text) == first


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_library(spark, file):
    path = public_tokenizers.path(file)
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        library = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False))
    got = token_counts.count(table(spark, ODD), path, PATTERN, rows=5).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), count(t or "")) for i, t in ODD)
    assert token_counts.count(table(spark, ODD).where("false"), path, PATTERN).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, tmp_path, planes):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [r for r in ODD if r[0] != 4] + [(50 + i, "Word, word. café! " * i) for i in range(40)] + [(7, "DON'T <|ENDOFTEXT|> <|endoftext|>.")]
    out = f"file://{tmp_path}/tokens"
    manifest = token_io.write(table(spark, rows), path, out, planes=planes, shard_docs=10, block=64)
    got = {r.doc_id: r for r in token_io.read(manifest, out).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids) // 4, ids)
        start += len(ids) // 4
    empty = token_io.write(table(spark, rows).where("false"), path, f"{out}-empty")
    assert token_io.read(empty, f"{out}-empty").count() == 0
    broken = tmp_path / "tokens" / manifest.first().path
    broken.write_bytes(broken.read_bytes()[:-3])
    import pyarrow as pa

    with pytest.raises(ValueError, match="shard"), pa.OSFile(str(broken)) as f:
        next(token_io.read_shard(f))


def brute_licenses(text):
    own = words(text)
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    spelt, starts, at = "".join(f" {w} " for w in own), {}, 0
    for i, w in enumerate([*own, ""]):
        starts[at] = i
        at += len(w) + 2
    hits = sorted(((starts[m.start()], -starts[m.end()], tier, order, label) for order, tier, _, label, p in licenses.rules() for m in re.finditer(licenses._regex(p), spelt)))
    alive = [h for i, h in enumerate(hits) if not any(b[2] <= h[2] and -b[1] >= -h[1] for b in hits[:i])]
    labels = {label for _, label in found}
    score = max((licenses.CONFIDENCE[h[2]] for h in alive), default=0.0)
    return len(own), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[4] for h in alive})), score


def test_licenses_equal_brute_force(spark):
    assert all(key in tokens.split() or f"({key}" in tokens for _, _, key, _, tokens in licenses.rules())
    rng = random.Random(6)
    pool = [*licenses.vocabulary(), "foo", "CC-BY", "cc by cc by", "GNU General Public License, version 3 or later", "Apache License 2.0", "MIT License"]
    rows = ODD + [(100 + i, " ".join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(120)] + [(9, "license " * 3000)]
    got = licenses.scan(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got if r.doc_id != 9) == Counter((i, *brute_licenses(t)) for i, t in rows if i != 9)
    assert licenses.scan(table(spark, rows).where("false")).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)] + ["É"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([3, 13, 20, 1, 40, 0])] + [(6, None), (7, "-"), (2, "w1 w2")]
    rows = ODD + [(100 + i, " - ".join([*rng.choices(vocabulary, k=rng.randint(0, 60)), (rng.choice(items)[1] or "").upper(), *rng.choices(vocabulary, k=5)])) for i in range(80)]
    grams = {}
    for item, text in items:
        own = words(text)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            grams.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    expect = Counter()
    for i, text in rows:
        own, hit, found = words(text), set(), set()
        for a in range(len(own)):
            for n in {len(g) for g in grams}:
                if a + n <= len(own) and (found_here := grams.get(tuple(own[a : a + n]))):
                    hit |= set(range(a, a + n))
                    found |= found_here
        expect[i, len(own), len(hit), tuple(sorted(found))] += 1
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    for block in (decontam.BLOCK_WORDS, 20):
        got = decontam.scan(docs, bench, block_words=block)
        assert Counter((r.doc.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == expect
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, w, h, _), n in expect.items() if not (h and 20 * h >= w))
    for r, (i, text) in zip(decontam.decontaminate(docs.where("doc_id >= 100"), bench, mode="span").orderBy("doc_id").collect(), [r for r in rows if (r[0] or 0) >= 100], strict=True):
        own = next(k for k in expect if k[0] == i)
        assert len(words(r.text)) == own[1] - own[2] or own[2] == 0 and r.text == text
    assert decontam.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0 and decontam.scan(docs.where("false"), bench).count() == 0


def brute_quality(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    cover = {j for i in range(len(own) - 4) if grams[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(own) < 10 or 100 * len(cover) > 20 * len(own)


def test_quality_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["é#", "<b>"]
    boiler = "shared footer line of every page here"
    rows = [(i, t, "h0") for i, t in ODD]
    for i in range(60):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        rows.append((100 + i, "\n".join(lines + [boiler] * (i % 3 > 0)), "h1" if i % 4 else None))
    rows += [(300 + i, "\n".join([boiler.upper()] * 9 + ["one two"]), "h1") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("kept", F.lit(2))
    got = quality.judge(df, min_docs=5, max_share=0.4).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *brute_quality(t)) for i, t, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[300].kept and by_id[300].removed == list(range(9)) and all(not (r.base_failed and r.kept) for r in got)
    kept = quality.apply(df, min_docs=5, max_share=0.4)
    assert kept.columns == df.columns and kept.where(F.col("text").contains(boiler) & F.col("source").isNotNull()).count() == 0
    assert kept.count() == sum(r.kept for r in got)
    assert quality.judge(df.where("false")).count() == 0 and quality.apply(df.where("false")).count() == 0


def test_copies_do_not_become_boilerplate(spark):
    text = "\n".join(" ".join(f"word{i}{j}" for j in range(8)) for i in range(4))
    df = spark.createDataFrame([(i, text, "h") for i in range(50)], "doc_id long, text string, source string")
    assert quality.judge(df, min_docs=5, max_share=0.1).where("kept").count() == 50


def test_urls_equal_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("Deep.a.b", "/x/y/z", "block"), ("host.net", "", "block"), ("org", "/", "block")]
    rng = random.Random(3)
    hosts = ["example.org", "WWW.Example.ORG", "a.com", "org", "xorg", "host.net", "q.deep.a.b", "", "b..org", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?x", "/de/#f", "?q=/es/", "/x/y/z/w", "/x/y/", "#"]
    urls = [None, "", "nothing", "://", "a://b://org/es/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 290, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("row", "host", "path", "rule", "n", "key", "r_host")})
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v, lower(h) + p) for h, p, v in rules if (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        return host, path, best[2], best[1]

    assert Counter(tuple(r) for r in got.collect()) == Counter((i % 290, *judge(u)) for i, u in enumerate(urls))
    assert url_filter.judge(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


def test_query_digests(spark):
    from braggflow.llm import queries

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for doc, row in zip(docs, queries.op6_token_binary(spark, data).orderBy("doc_id").collect(), strict=True):
        ids = np.array(library.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for doc, row in zip(docs, queries.op2_byte_bpe(spark, data).orderBy("doc_id").collect(), strict=True):
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
