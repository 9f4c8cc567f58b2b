"""Every code point is cut as the tokenizer libraries cut it; a streamed log folds back into its turns."""

import random

import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from braggflow.llm import bpe, chat, token_counts

PATTERN = public_tokenizers.PATTERN
POINTS = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]


def test_bpe_of_every_code_point():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.Encoder(path, PATTERN, bpe.unknown_to_library(path, PATTERN))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    wrong = [c for c in POINTS if enc.encode(f" {chr(c)}'d{chr(c)}") != b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(f" {chr(c)}'d{chr(c)}"))]
    assert wrong == []
    assert [c for c in bpe.new_characters() if enc.encode(f"{c}'d")] and enc.encode("₟'d")[-4:] == (67).to_bytes(4, "little")


def test_counts_of_every_code_point():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_counts.Tokenizer(path, PATTERN, token_counts.unknown_to_library(path, PATTERN))
    library = tokenizers.Tokenizer.from_file(path)
    text = lambda c: f"a{chr(c)}'d 1{chr(c)}"
    counts = [len(e.ids) for e in library.encode_batch([text(c) for c in POINTS], add_special_tokens=False)]
    cache = bpe.PieceCache(own.count)
    assert [c for c, n in zip(POINTS, counts, strict=True) if sum(cache[p] for run in own.pieces(text(c)) for p in run) != n] == []


def test_streamed_log_folds_back(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a", "ab", "x" * 5000, "é🙂###</turn>"])) for c in (1, 2, None) for t in [None, *range(-3, 700), 1 << 62]]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).drop("seq")
    log = chat.streamed_events(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "regenerate", "message", "edit"}
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(log, message=["turn", "tie"]), block=512)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
