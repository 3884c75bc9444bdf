"""Token ids in bit-plane shuffled shard files.

Documents are range-partitioned by doc_id, encoded, and packed into shards of about
`SHARD_IDS` ids; a document never spans two shards. In a shard, each block of `BLOCK_IDS` ids
is transposed into byte planes (or bit planes), every plane is compressed alone with
zstandard, and an index at the end tells each block's place, its count of ids and a checksum,
followed by the documents' ids and lengths. Any block can be read without the others.

A shard is one binary value of a Parquet table: the table's commit protocol makes the files
whole under retried tasks and on any store that Spark reaches.

Shard, little-endian: MAGIC, blocks (planes one after another), index = zstd(JSON header and
arrays), u32 length of the index, MAGIC.

A null text is empty and still gets the end id. Rows with a null doc_id come first. Rows with
equal doc_id are ordered by a hash of their text, then the text; repeated rows are written as often
as they stand there. A very long text makes a long shard of its own. An empty table gives no
shards. Extra columns are not looked at.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACE, bounded_batches, column, n_groups, numbered_words, release, slices, utf8

MAGIC = b"QMPLANE1"
SHARD_IDS = 1 << 20
BLOCK_IDS = 1 << 16
#: The shard table.
SHARDS = "part int, seq int, n_docs long, n_ids long, shard binary"
#: Words whose ids a worker remembers; when it is full, those that were used least are forgotten.
REMEMBERED = 400_000
#: Words that go through the tokenizer in one text.
AT_ONCE = 4096
#: Every special token of the tokenizers served begins like this.
MARK = b"<|"
#: The tokenizer's parts that `pieces` relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LETTER, _LATIN, _STOP = (np.zeros(256, bool) for _ in range(3))
_LETTER[97:123] = True
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # after 0xC3: letters, but not the signs of times and division
_STOP[list(b".,")] = True


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes from low to high; high planes without a set bit are left out."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, j]).tobytes() for j in range(-(-top // 8))]
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, :top]
    return [np.packbits(bits[:, j], bitorder="little").tobytes() for j in range(top)]


def from_planes(raw: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for j, plane in enumerate(raw):
            octets[:, j] = np.frombuffer(plane, np.uint8)
        return octets.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for j, plane in enumerate(raw):
        bits[:, j] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[:n]
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: list[int], kind: str = "byte", level: int = 1) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level)
    out, index, at = [MAGIC], [], len(MAGIC)
    for start in range(0, len(ids), BLOCK_IDS):
        block = ids[start : start + BLOCK_IDS]
        parts = [squeeze.compress(p) for p in to_planes(block, kind)]
        index.append([at, len(block), zlib.crc32(block.astype("<u4").tobytes()), *map(len, parts)])
        out += parts
        at += sum(map(len, parts))
    foot = squeeze.compress(json.dumps({"kind": kind, "blocks": index, "doc_ids": doc_ids, "lengths": lengths}).encode())
    return b"".join([*out, foot, struct.pack("<I", len(foot)), MAGIC])


def read_index(shard: bytes) -> dict:
    if not (shard.startswith(MAGIC) and shard.endswith(MAGIC)):
        raise ValueError("not a shard")
    (size,) = struct.unpack("<I", shard[-len(MAGIC) - 4 : -len(MAGIC)])
    return json.loads(zstandard.ZstdDecompressor().decompress(shard[-len(MAGIC) - 4 - size : -len(MAGIC) - 4]))


def read_block(shard: bytes, entry: list, kind: str) -> np.ndarray:
    at, n, crc, *sizes = entry
    expand, raw = zstandard.ZstdDecompressor(), []
    for size in sizes:
        raw.append(expand.decompress(shard[at : at + size]))
        at += size
    ids = from_planes(raw, n, kind)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def read_ids(shard: bytes, index: dict) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *(read_block(shard, e, index["kind"]) for e in index["blocks"])]).astype("<u4")


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the place of each text's words among them, end to end, and how many each text has.

    Words are in lower case, a stop or comma at a word's end apart from the letter before it: the
    tokenizer takes each alone. Texts with the look of a special token keep their case, which tells
    one from ordinary text.
    """
    low = [t if MARK in t else t.lower() for t in texts]
    data = np.frombuffer(b"\n\n" + b"\n".join(low) + b"\n", np.uint8)
    here, before = data[2:-1], data[1:-2]
    at = np.flatnonzero(_STOP[here] & SPACE[data[3:]])
    at = at[_LETTER[before[at]] | (_LATIN[before[at]] & (data[at] == 0xC3))]
    spaced = np.insert(here, at, 0x20)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1) - 1
    ends += np.searchsorted(at, ends)
    return numbered_words(spaced, ends)


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer's file has the normaliser and the split that `pieces` relies on; others get whole texts."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    return parts.get("normalizer") == NORMALIZER and parts.get("pre_tokenizer") == PRE_TOKENIZER and parts.get("post_processor") is None


class WordEncoder:
    """Ids of whole texts, with the words' ids remembered.

    The tokenizer drops white space and none of its pieces spans it, so a text's ids are those
    of its words, one after another; a word goes through the library once while it is remembered.
    Words to learn go through it many at a time, with its own special token between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_at_spaces(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) and t.content.startswith(MARK.decode())]
        self.between = special[0] if special else None
        self.numbered({})
        self.start, self.size, self.uses = (np.zeros(REMEMBERED, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def numbered(self, known: dict[bytes, int]) -> None:
        """A word that is looked up for the first time gets the next number."""
        self.number: dict[bytes, int] = defaultdict(count(len(known)).__next__, known)

    def forget(self) -> None:
        """Keeps at most half of the words, those that were used most."""
        have, least = len(self.number), 1
        keep = np.arange(have)
        while len(keep) > REMEMBERED // 2:
            least *= 2
            keep = np.flatnonzero(self.uses[:have] >= least)
        words, sizes = list(self.number), self.size[keep]
        self.numbered(dict(zip((words[i] for i in keep.tolist()), range(len(keep)), strict=True)))
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(sizes.sum())
        self.pool, self.used = self.pool[at], len(at)
        self.size[: len(keep)], self.start[: len(keep)], self.uses[: len(keep)] = sizes, ends - sizes, self.uses[keep] // 2

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and their count of each text, each text by itself."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As library, for words without the look of a special token."""
        if not self.between:
            return self.library([w.decode("utf-8", "replace") for w in words])
        sep, parts = self.between.encode(), [np.zeros(0, np.uint32)]
        for at in range(0, len(words), AT_ONCE):
            text = (sep.join(words[at : at + AT_ONCE]) + sep).decode("utf-8", "replace")
            parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        ids = np.concatenate(parts)
        mark = ids == self.tokenizer.token_to_id(self.between)
        ends = np.flatnonzero(mark)
        if len(ends) != len(words):
            raise ValueError("the special token does not keep words apart")
        return ids[~mark], np.diff(ends, prepend=-1) - 1

    def learn(self, first: int) -> None:
        """The ids of the words from this number on."""
        words = list(islice(self.number, first, None))
        while len(self.start) < len(self.number):
            self.start, self.size, self.uses = (np.concatenate([x, x * 0]) for x in (self.start, self.size, self.uses))
        odd = np.fromiter((MARK in w for w in words), bool, len(words)) if MARK in b" ".join(words) else np.zeros(len(words), bool)
        for some, encode in ((np.flatnonzero(~odd), self.of_words), (np.flatnonzero(odd), lambda ws: self.library([w.decode("utf-8", "replace") for w in ws]))):
            if not len(some):
                continue
            ids, sizes = encode([words[i] for i in some.tolist()])
            if len(self.pool) < self.used + len(ids):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.size[first + some], self.uses[first + some] = sizes, 0
            self.start[first + some] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the count of each text."""
        if not self.by_words:
            ids, lengths = self.library([t.decode("utf-8", "replace") for t in texts])
            return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1
        words, place, counts = pieces(texts)
        if len(self.number) > REMEMBERED:
            self.forget()
        have = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > have:
            self.learn(have)
        self.uses[numbers] += np.bincount(place, minlength=len(words))
        at = numbers[place]
        sizes = self.size[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.start[at] - before[:-1], sizes) + np.arange(before[-1])]
        edges = np.concatenate([[0], np.cumsum(counts)])
        lengths = before[edges[1:]] - before[edges[:-1]]
        return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The worker's encoder; workers are reused, so later tasks find its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Drops the worker's encoders and gives their memory back."""
    if _ENCODERS:
        _ENCODERS.clear()
        release()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, kind: str = "byte", doc_id: str = "doc_id", text: str = "text", order: list[Column] | None = None) -> None:
    """Writes the shard table: part (of the order, by default that of doc_id), seq, n_docs, n_ids, shard."""
    picked = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(c.alias(f"__{i}") for i, c in enumerate(order or [])))
    by = [f"__{i}" for i in range(len(order or []))] + [F.col("doc_id").asc_nulls_first(), "tie"]
    ordered = picked.withColumn("tie", F.xxhash64("text")).repartitionByRange(n_groups(picked, each=32 << 20), *by).sortWithinPartitions(*by, "text").select("doc_id", "text")

    def run(batches):
        encoder, part, seq = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_lengths, held = [], [], [], 0

        def shard():
            data = pack_shard(np.concatenate(held_ids), held_docs, held_lengths, kind)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(held_docs)], "n_ids": [held], "shard": [data]}, schema)

        for batch in slices(batches, 2 << 20):
            ids, lengths = encoder.encode(utf8(column(batch, "text")), end_id)
            held_ids.append(ids)
            held_docs += column(batch, "doc_id").to_pylist()
            held_lengths += lengths.tolist()
            held += len(ids)
            if held >= SHARD_IDS:
                yield shard()
                held_ids, held_docs, held_lengths, held, seq = [], [], [], 0, seq + 1
        if held_docs:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])
    ordered.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Of each document, from the shards alone: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    meta = shards.select("part", "seq", "n_ids")
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = meta.join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + inside).alias("base"))

    def run(batches):
        forget_encoders()  # what is read has been encoded
        for batch in batches:
            for part, seq, shard in zip(*(column(batch, c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                index = read_index(shard)
                ids, lengths = memoryview(read_ids(shard, index)).cast("B"), np.array(index["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(crcs), "seq": [seq] * len(crcs), "doc_id": index["doc_ids"], "local": ends - lengths, "n_tokens": lengths, "ids_crc32": crcs}, schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    read = shards.select("part", "seq", "shard").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
