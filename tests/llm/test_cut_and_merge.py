"""Byte BPE's quick ways: texts of the basic plane are not cut by `regex`, and short pieces are merged without a tree."""

import random

import public_tokenizers

from braggflow.llm import bpe, token_counts


def test_basic_plane_is_cut_without_regex(monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    cut = bpe.Cutter(pattern, bpe.unknown_to_library(path, pattern))
    slow = bpe.Cutter(pattern, bpe.unknown_to_library(path, pattern))
    slow.plain = None
    texts = [f"a{c} {c}'d{c}9 {c}{c}  {c}\n{c}" for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    rng = random.Random(4)
    texts += ["".join(rng.choices(" \t\n\x1c\x85 'stdrevlmaZ09é字٣²_-", k=60)) for _ in range(2000)]
    expected = [list(slow.runs(text)) for text in texts]
    cut.match = cut.older = None  # what these texts must not need
    assert [list(cut.runs(text)) for text in texts] == expected
    beyond = "x 𝒜𝒷 ’𝟗 " + chr(0x2A6E0)
    assert list(bpe.Cutter(pattern).runs(beyond)) == list(slow.runs(beyond))


def test_a_pattern_beyond_the_translated_is_left_to_regex():
    assert bpe.spelled_out(r"\p{Lu}+|\s+") is None and bpe.spelled_out(r"[^\S]+") is None
    assert list(bpe.Cutter(r"\p{Lu}+|\p{Ll}+").runs("ABcd")) == [["AB", "cd"]]


def test_short_and_long_merges_are_the_same(monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pairs, rng = bpe.pair_table(ranks), random.Random(5)
    pieces = ["".join(rng.choices("etaoin shré字\x00", k=rng.randint(1, 20))).encode() for _ in range(3000)] + [b"aaaaaaaaaaaaa", b"abababababab"]
    short = [bpe.merge(piece, ranks, pairs) for piece in pieces]
    assert short == [bpe.merge(piece, ranks) for piece in pieces]
    monkeypatch.setattr(bpe, "SHORT_PIECE", 0)
    assert short == [bpe.merge(piece, ranks) for piece in pieces]


def test_counts_cut_the_basic_plane_without_regex():
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    own = token_counts.Tokenizer(path, pattern, token_counts.unknown_to_library(path, pattern))
    own.cut.match = own.cut.older = None
    for text in ("Don't stop: it's 12½ 字字 ​\n\n  end ", "tab\tand　space  'll", "Ünï 🙂"[:3]):
        assert sum(own.count(p) for run in own.pieces(text) for p in run) == own.count(text)
