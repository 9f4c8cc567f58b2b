"""Token ids in binary shards: plane-shuffled, compressed blocks with a chunk index.

A shard holds the ids of a contiguous range of documents in ascending id order. Its ids are cut into
blocks of a fixed number of ids; each block is transposed into byte planes (all low bytes, then all
next bytes) or bit planes, and each plane is compressed with zstandard on its own. The index at the
end of the shard has one entry for each plane of each block, and one for each document.

    shard  := magic "BFTOK1\\n\\0" | plane* | index | uint64 length of index | magic
    index  := zstandard of: uint32 n_head | JSON head | int64 ids of documents | uint64 lengths of documents
    head   := {"width": bytes of an id, "planes": "byte" or "bit", "block": ids in a block, "n_ids": all ids,
               "n_null": leading documents with a null id, "n_docs": documents, "chunks": [[offset, size], ...]}

Writing: documents are encoded where they are read, dealt to shards by range bounds taken from the id
column alone, sorted, and streamed into one file a shard. A file appears under its final name by a
rename, so a task that runs again, or twice, leaves the same single file. Shards and their sizes go
into a manifest table; a document's start is its shard's start plus what precedes it in the shard.

Defined results: a null text counts as empty and keeps only its end id; null document ids come first;
equal ids are ordered by their token ids; very long texts are cut at white space; other columns are
ignored; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braggflow.llm.bpe import CACHE_CHARS, in_slices
from braggflow.llm.common import shared_dir, stored

MAGIC = b"BFTOK1\n\0"
#: Documents in a shard, about; ids in a block.
SHARD_DOCS, BLOCK_IDS = 16_384, 1 << 16
#: Words in one generation of a worker's cache.
CACHE_WORDS = 400_000
_MARKS, _ALNUM = frozenset(b".,;:!?)|"), frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")


class WordEncoder:
    """Ids by the tokenizers library for tokenizers that drop white space: runs between ASCII white space are independent.

    Lower-casing A-Z first changes nothing for a tokenizer that lower-cases, unless a special string is in the text.
    One mark after a letter or digit is a pre-token of its own, so ``word,`` is ``word`` and ``,``. What the cache
    lacks is encoded by the library a batch at a time.
    """

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.new, self.old, self.ends = {}, {}, None
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        if suffix:
            self.ends = np.zeros(self.library.get_vocab_size(), "?")
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new words; words of letters alone are one pre-token each and go together, parted at the tokens that end a word."""
        texts = [w.decode("utf-8") for w in fresh]
        letters = [i for i, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        if letters:
            ids = np.array(self.encode([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids, self.dtype)
            at = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(at) == len(letters):
                packed = ids.tobytes()
                self.new.update(zip([fresh[i] for i in letters], [packed[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)], strict=True))
            else:
                letters = []
        rest = sorted(set(range(len(fresh))) - set(letters))
        for i, found in zip(rest, self.encode([texts[i] for i in rest], add_special_tokens=False), strict=True):
            self.new[fresh[i]] = np.array(found.ids, self.dtype).tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        new, old = self.new, self.old
        fresh = [w for w in set().union(*words) if w not in new]
        unknown, marked = set(), []
        for w in fresh:
            value = old.get(w)
            if value is not None:
                new[w] = value
            elif len(w) > 1 and w[-1] in _MARKS and w[-2] in _ALNUM:
                marked.append(w)
                unknown.add(w[:-1])
                unknown.add(w[-1:])
            else:
                unknown.add(w)
        unknown = [w for w in unknown if w not in new]
        for i in range(0, len(unknown), 4096):
            self._learn(unknown[i : i + 4096])
        new.update([(w, new[w[:-1]] + new[w[-1:]]) for w in marked])
        value = new.__getitem__
        out = [b"".join(map(value, own)) for own in words]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                new.pop(w, None)
                new.pop(w[:-1], None)
        if len(new) > CACHE_WORDS:  # a full generation becomes the old one, whose used words move on
            self.old, self.new = new, {}
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def shuffle_block(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of ids, low plane first."""
    rows = ids.view("u1").reshape(len(ids), ids.dtype.itemsize)
    if planes == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(column, bitorder="little").tobytes() for column in np.ascontiguousarray(rows.T)]
    return [column.tobytes() for column in np.ascontiguousarray(rows.T)]


def unshuffle_block(planes: list[bytes], kind: str, n: int, dtype: str) -> np.ndarray:
    columns = np.stack([np.frombuffer(p, "u1") for p in planes])
    if kind == "bit":
        columns = np.packbits(np.unpackbits(columns, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(columns.T).view(dtype).reshape(-1)


class ShardWriter:
    """Streams documents into one shard; holds one block of ids and the index."""

    def __init__(self, sink, dtype: str, planes: str, block: int):
        self.sink, self.dtype, self.planes, self.block = sink, dtype, planes, block
        self.at, self.n_ids, self.n_null, self.chunks, self.docs, self.lengths = len(MAGIC), 0, 0, [], [], []
        self.held, self.held_bytes, self.press = [], 0, zstandard.ZstdCompressor(level=1)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // np.dtype(self.dtype).itemsize
        self.n_null += doc_id is None
        self.docs.append(0 if doc_id is None else doc_id)
        self.lengths.append(n)
        self.n_ids += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.block * np.dtype(self.dtype).itemsize * 4:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        whole = np.frombuffer(b"".join(self.held), self.dtype)
        end = len(whole) if all_of_it else len(whole) // self.block * self.block
        for a in range(0, end, self.block):
            for plane in shuffle_block(whole[a : min(a + self.block, end)], self.planes):
                data = self.press.compress(plane)
                self.sink.write(data)
                self.chunks.append([self.at, len(data)])
                self.at += len(data)
        self.held = [whole[end:].tobytes()]
        self.held_bytes = len(self.held[0])

    def close(self) -> None:
        self.flush(True)
        head = {"width": np.dtype(self.dtype).itemsize, "planes": self.planes, "block": self.block, "n_ids": self.n_ids, "n_null": self.n_null, "n_docs": len(self.docs), "chunks": self.chunks}
        text = json.dumps(head).encode()
        index = self.press.compress(struct.pack("<I", len(text)) + text + np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_shard(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in order; holds the ids of a document and a block at a time."""
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token shard, or cut short")
    n_index = struct.unpack("<Q", tail[:8])[0]
    source.seek(size - 16 - n_index)
    index = zstandard.ZstdDecompressor().decompress(source.read(n_index))
    n_head = struct.unpack("<I", index[:4])[0]
    head = json.loads(index[4 : 4 + n_head])
    docs = np.frombuffer(index, "<i8", head["n_docs"], 4 + n_head)
    lengths = np.frombuffer(index, "<u8", head["n_docs"], 4 + n_head + 8 * head["n_docs"])
    dtype, unpress = f"<u{head['width']}", zstandard.ZstdDecompressor()
    per_block = head["width"] * (8 if head["planes"] == "bit" else 1)

    def blocks() -> Iterator[np.ndarray]:
        for b in range(0, len(head["chunks"]), per_block):
            planes = []
            for offset, n in head["chunks"][b : b + per_block]:
                source.seek(offset)
                planes.append(unpress.decompress(source.read(n)))
            n_block = min(head["block"], head["n_ids"] - b // per_block * head["block"])
            yield unshuffle_block(planes, head["planes"], n_block, dtype)

    stream, buffer = blocks(), np.empty(0, dtype)
    for i, (doc, n) in enumerate(zip(docs.tolist(), lengths.tolist(), strict=True)):
        parts, have = [buffer], len(buffer)
        while have < n:
            parts.append(next(stream))
            have += len(parts[-1])
        whole = np.concatenate(parts) if len(parts) > 1 else buffer
        buffer = whole[n:]
        yield (None if i < head["n_null"] else doc), whole[:n]


def write(docs: DataFrame, path: str, out_dir: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", shard_docs: int = SHARD_DOCS, block: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, append end_id, and write shards to out_dir; returns the manifest (shard, path, n_docs, n_ids, n_bytes, start)."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n_docs = ids.count()
    n_shards = max(1, -(-n_docs // shard_docs))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n_shards for i in range(1, n_shards)], 20 * n_shards)).first()[0] if n_shards > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(sorted(set(cuts or [])), "i8"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                keys = part.column("doc_id")
                shard = np.searchsorted(bounds.value, pc.fill_null(keys, -(1 << 63)).to_numpy(), "left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), keys, pa.array([ids + end for ids in enc.encode_all(texts)], pa.binary())], ["shard", "doc_id", "ids"]
                )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_encoder(path).dtype
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        open_shard, writer, done = None, None, []

        def close():
            writer.close()
            sink.close()
            name = f"{root}/shard-{open_shard:08d}.bftok"
            n_bytes = fs.get_file_info(scratch).size
            fs.move(scratch, name)
            done.append((open_shard, f"shard-{open_shard:08d}.bftok", len(writer.docs), writer.n_ids, n_bytes))

        for batch in batches:
            for part in in_slices(batch, "ids"):
                for shard, doc, ids in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if shard != open_shard:
                        if writer:
                            close()
                        scratch = f"{root}/.writing-{shard:08d}-{uuid.uuid4().hex}"
                        open_shard, sink = shard, fs.open_output_stream(scratch)
                        writer = ShardWriter(sink, dtype, planes, block)
                    writer.add(doc, ids)
        if writer:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "path", "n_docs", "n_ids", "n_bytes"])

    encoded = source.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartition(n_shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    manifest = stored(dealt.mapInArrow(save, "shard int, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{name}") as source:
                    for doc, ids in read_shard(source):
                        rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += 4 * len(ids)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    dealt = manifest.select("path", "start", "shard").repartition(max(1, manifest.count()), "shard")
    return dealt.select("path", "start").mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def scratch_dir(docs: DataFrame) -> str:
    """A new folder for shards in the shared folder."""
    return f"{shared_dir(docs.sparkSession)}/braggflow/tokens-{uuid.uuid4().hex}"
