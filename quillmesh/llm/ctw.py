"""Language-model scores by context-tree weighting.

Bytes are decomposed into eight binary decisions; each decision has a tree of contexts of the
0 to DEPTH bytes before it. A node's Krichevsky-Trofimov estimate from its training counts is
weighed with the product of its children, from the deepest contexts up to the root; a bit's
probability mixes the estimates of all depths on its path by those weights. The code length of
a text is minus its log probability. Texts are preceded by zero bytes.

Documents whose crc32(doc_id as text) mod 7 is not 2 train the model; all are scored with the
model of the whole training part. What is gathered are all distinct grams of DEPTH + 1 bytes, so
it grows with the input. Groups of documents send their grams to shards and get prices back
(see anchors.py). The tree is cut in three:

* depths SPLIT to DEPTH: a shard of contexts by a hash of their SPLIT nearest bytes;
* depths 2 to SPLIT - 1: one of TOPS buckets by a hash of the two nearest bytes, from the shards'
  sums, one entry for each distinct gram of SPLIT + 1 bytes;
* depths 0 and 1: one task, from at most 65,280 nodes (byte, prefix) a bucket, whatever the input.

Weights go up and mixtures come down the same way. A shard gets each gram of its contexts once
from each group, so a context of SPLIT bytes that stands everywhere costs it the count of groups
times the grams around it. Word counts are summed in the same shards, so no table of the
corpus's words is ever broadcast.

Null texts are empty: an end token, score 0. A null doc_id counts as the empty text, which
trains. Repeated rows train as often as they stand there. Very long texts are cut for sorting
only: their contexts go on over the cuts. An empty table gives an empty one. Extra columns are not
looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import anchors as A
from quillmesh.llm.common import distinct, mix64, numbered_words, utf8, written

DEPTH, SPLIT, TOPS = 6, 4, 64
FOLDS, HELD_OUT = 7, 2
#: Text of a group, and of the block of it that is sorted at once (of 256 pieces at most).
GROUP_BYTES, BLOCK_BYTES = 12 << 20, 2 << 20
LN2 = np.log(2.0)
_EXACT = 1 << 16
_HALVES = np.r_[0.0, np.cumsum(np.log(np.arange(_EXACT) + 0.5))] + 0.5 * np.log(np.pi)
_WHOLES = np.r_[0.0, np.cumsum(np.log(np.arange(1, _EXACT + 1)))]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def gram_keys(pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Of each byte of each piece (8 bytes before it, body): the DEPTH bytes before it, nearest first, then itself, as an integer."""
    data = b"".join(x for p in pieces for x in p)
    n = len(data)
    back = np.frombuffer(data, np.uint8)[::-1].tobytes()
    before = np.ndarray((n - 8,), ">u8", back, 1, (1,))[::-1].astype(np.uint64)
    sizes = np.fromiter((len(b) for _, b in pieces), np.int64, len(pieces))
    skip = np.cumsum(sizes + 8) - sizes - 8
    real = np.ones(n, bool)
    for j in range(8):
        real[skip + j] = False
    own = np.frombuffer(data, np.uint8)[8:]
    return ((before >> np.uint64(64 - 8 * DEPTH)) << np.uint64(8) | own)[real[8:]]


class Grams:
    """A group's distinct grams (keys, ascending), and where each document has them."""

    def __init__(self, texts: list[bytes]):
        self.n, self.blocks = len(texts), []
        pieces, docs, held = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK_BYTES):
                body = t[at : at + BLOCK_BYTES]
                pieces.append((t[at - 8 : at] if at else bytes(8), body))
                docs.append(i)
                held += len(body)
                if held >= BLOCK_BYTES or len(pieces) == 256:
                    self._add(pieces, docs)
                    pieces, docs, held = [], [], 0
        if pieces:
            self._add(pieces, docs)
        self.keys = distinct(np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in self.blocks)]))

    def _add(self, pieces, docs) -> None:
        keys = gram_keys(pieces)
        place = np.repeat(np.arange(len(pieces), dtype=np.uint64), [len(b) for _, b in pieces])
        both = np.sort(keys << np.uint64(8) | place)  # 8 * (DEPTH + 1) + 8 bits
        keys = both >> np.uint64(8)
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.blocks.append((keys[head], head, both.astype(np.uint8), np.array(docs, np.int64)))

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often the documents that train have each key."""
        out = np.zeros(len(self.keys), np.uint32)
        for keys, head, place, docs in self.blocks:
            out[np.searchsorted(self.keys, keys)] += np.add.reduceat(train[docs][place].astype(np.uint32), head)
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each document's sum of its grams' values."""
        out = np.zeros(self.n)
        for keys, head, place, docs in self.blocks:
            each = np.repeat(values[np.searchsorted(self.keys, keys)], np.diff(np.r_[head, len(place)]))
            np.add.at(out, docs, np.bincount(place, weights=each, minlength=len(docs)))
        return out

    def dealt(self, n_shards: int):
        shard = mix64(self.keys >> np.uint64(8 * (DEPTH - SPLIT + 1))) % np.uint64(n_shards)
        return A.deal(shard.astype(np.uint16 if n_shards <= 1 << 16 else np.int64), n_shards)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for large x, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of whole counts."""
    total = zeros + ones
    small = total < _EXACT
    a, b, c = (np.where(small, x, 0).astype(np.int64) for x in (zeros, ones, total))
    out = _HALVES[a] + _HALVES[b] - _WHOLES[c] - np.log(np.pi)
    if not small.all():
        big = np.flatnonzero(~small)
        halves = [np.where(x[big] < _EXACT, _HALVES[np.minimum(x[big], _EXACT).astype(np.int64)], lgamma(x[big] + 0.5)) for x in (zeros, ones)]
        out[big] = halves[0] + halves[1] - lgamma(total[big] + 1.0) - np.log(np.pi)
    return out


class Level:
    """Nodes of one depth: entries are (context, byte) in ascending order with counts.

    A node of bit k is a run of entries with one context and the same first k bits of the byte.
    `up` places each entry among those of the next lower depth.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.up = keys, n, None
        byte = (keys & np.uint64(255)).astype(np.int64)
        self.bit = [(byte >> (7 - k) & 1).astype(bool) for k in range(8)]
        self.first = [np.flatnonzero(np.r_[True, np.diff(keys >> np.uint64(8 - k)) != 0]) if len(keys) else np.zeros(0, np.int64) for k in range(8)]
        self.node = [np.repeat(np.arange(len(f)), np.diff(np.r_[f, len(keys)])) for f in self.first]
        self.ones, self.zeros, self.kt = [], [], []
        for k in range(8):
            total = np.add.reduceat(n, self.first[k]) if len(n) else n
            one = np.add.reduceat(np.where(self.bit[k], n, 0.0), self.first[k]) if len(n) else n
            self.ones.append(one)
            self.zeros.append(total - one)
            self.kt.append(log_kt(total - one, one))
        self.pw = self.kt

    def lower(self) -> Level:
        """The depth below: contexts without their farthest byte."""
        keys, self.up = np.unique((self.keys >> np.uint64(16)) << np.uint64(8) | (self.keys & np.uint64(255)), return_inverse=True)
        out = Level(keys, np.bincount(self.up, weights=self.n, minlength=len(keys)))
        out.pw = []
        for k in range(8):
            below = np.bincount(out.node[k][self.up[self.first[k]]], weights=self.pw[k], minlength=len(out.first[k]))
            out.pw.append(np.logaddexp(out.kt[k], below) - LN2)
        return out

    def estimate(self, k: int) -> np.ndarray:
        """Of each entry's decision k: the node's probability of its bit."""
        seen = np.where(self.bit[k], self.ones[k][self.node[k]], self.zeros[k][self.node[k]])
        return (seen + 0.5) / (self.ones[k] + self.zeros[k] + 1.0)[self.node[k]]

    def stop(self, k: int) -> np.ndarray:
        """Weight of the node itself against its children."""
        return np.exp(self.kt[k] - LN2 - self.pw[k])[self.node[k]]


def levels(top: Level, depths: int) -> list[Level]:
    """The level and `depths` lower ones."""
    out = [top]
    for _ in range(depths):
        out.append(out[-1].lower())
    return out


def prices(deep: list[Level], above: np.ndarray) -> np.ndarray:
    """log10 probability of each deepest entry's byte. above: (A, B) of each last entry and bit: what
    the depths below give, and the weight that they leave to these."""
    total = np.zeros(len(deep[0].keys))
    for k in range(8):
        p = deep[0].estimate(k)
        at = np.arange(len(p))
        for one, two in zip(deep, deep[1:], strict=False):
            at = one.up[at]
            stop = two.stop(k)[at]
            p = stop * two.estimate(k)[at] + (1 - stop) * p
        total += np.log10(above[at, k, 0] + above[at, k, 1] * p)
    return total


def roots(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Depths 0 and 1 for nodes (byte << 8 | prefix) of depth 1: what they give for bit 0 and bit 1, and the weight left to deeper ones."""
    kt = log_kt(zeros, ones)
    pw = np.logaddexp(kt, below) - LN2
    prefix = nodes & 255
    z, o, b = (np.bincount(prefix, weights=x, minlength=256) for x in (zeros, ones, pw))
    kt0 = log_kt(z, o)
    stop0, stop1 = np.exp(kt0 - np.logaddexp(kt0, b))[prefix], np.exp(kt - LN2 - pw)
    z, o = z[prefix], o[prefix]
    give = [stop0 * (a0 + 0.5) / (z + o + 1) + (1 - stop0) * stop1 * (a1 + 0.5) / (zeros + ones + 1) for a0, a1 in ((z, zeros), (o, ones))]
    return np.stack([*give, (1 - stop0) * (1 - stop1)], axis=1)


def flat(a: np.ndarray) -> bytes:
    """Bytes of an array, those of one place together, under zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unflat(raw: bytes, kind: str) -> np.ndarray:
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(octets.T).reshape(-1).view(kind)


def pack_grams(keys: np.ndarray, n: np.ndarray) -> bytes:
    one = flat(np.diff(keys, prepend=np.uint64(0)))
    return b"c" + len(one).to_bytes(4, "little") + one + flat(n)


def unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 5 + int.from_bytes(blob[1:5], "little")
    return np.cumsum(unflat(blob[5:cut], "<u8"), dtype=np.uint64), unflat(blob[cut:], "<u4")


class Tokens:
    """A group's distinct words, lower-cased, with an end token (the empty word), dealt to shards.

    The shard comes from one hash and the entry from another, so that words are told apart by
    more bits as the input grows. `place` has every token's word, text by text.
    """

    def __init__(self, texts: list[bytes], train: list[bool], n_shards: int):
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        words, place, n = numbered_words(np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8), ends)
        self.words = [*words, b""]
        self.place = np.insert(place.astype(np.int64), np.cumsum(n), len(words))
        self.n = n + 1
        self.counts = np.bincount(self.place[np.repeat(np.array(train, bool), self.n)], minlength=len(self.words)).astype(np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        shard = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)) % np.uint64(n_shards)
        self.dealt = list(A.deal(shard.astype(np.int64), n_shards))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each text's sum of its tokens' values."""
        return np.add.reduceat(values[self.place], np.cumsum(self.n) - self.n) if len(self.n) else np.zeros(0)


def by_kind(rows: pa.Table) -> dict[bytes, list[tuple[int, bytes]]]:
    """(g, rest of the blob) of each kind (first byte), ordered by g."""
    out: dict[bytes, list] = {b"c": [], b"t": []}
    for g, blob in sorted(zip(rows["g"].to_pylist(), rows["blob"].to_pylist(), strict=True)):
        out[blob[:1]].append((g, blob))
    return out


def shard_levels(sent: list[tuple[int, bytes]]) -> tuple[list[Level], list[np.ndarray]]:
    """Depths DEPTH to SPLIT of the groups' grams, and each group's places among the deepest entries."""
    parts = [unpack_grams(b) for _, b in sent]
    keys = distinct(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]))
    places, n = [], np.zeros(len(keys))
    for k, c in parts:
        at = np.searchsorted(keys, k)
        n[at] += c
        places.append(at.astype(np.int32))
    return levels(Level(keys, n), DEPTH - SPLIT), places


def bucket_entries(rows: pa.Table) -> tuple[list[int], list[np.ndarray], Level]:
    """Shards, their entries' places, and the level SPLIT of a bucket."""
    rows = rows.sort_by("shard")
    parts = []
    for blob in rows["blob"].to_pylist():
        n = len(blob) // 80
        parts.append((np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<f8", n, 8 * n), np.frombuffer(blob, "<f8", 8 * n, 16 * n).reshape(n, 8)))
    keys, n, pw = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(keys)
    level = Level(keys[order], n[order])
    pw = pw[order]
    level.pw = [pw[level.first[k], k] for k in range(8)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return rows["shard"].to_pylist(), np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1]), level


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    rows, n_shards = A.grouped(docs, doc_id, text, group_bytes)

    def ask(key, t):
        t = A.in_order(t)
        g, texts = key[0].as_py(), utf8(t["text"])
        train = [not held_out(x) for x in t["doc_id"].to_pylist()]
        tokens = Tokens(texts, train, n_shards)
        out = [(s, g, b"t" + A.pack(tokens.hashes[p], tokens.counts[p])) for s, p in tokens.dealt]
        grams = Grams(texts)
        n = grams.counts(np.array(train, bool))
        return A.messages(out + [(s, g, pack_grams(grams.keys[p], n[p])) for s, p in grams.dealt(n_shards)])

    def up(key, t):
        """Entries of depth SPLIT with their counts and log weights, to the buckets."""
        sent = by_kind(t)[b"c"]
        if not sent:
            return bucketed([])
        last = shard_levels(sent)[0][-1]
        weight = np.stack([last.pw[k][last.node[k]] for k in range(8)], axis=1)
        bucket = (mix64(last.keys >> np.uint64(8 * (SPLIT - 1))) % np.uint64(TOPS)).astype(np.int64)
        return bucketed([(b, key[0].as_py(), A.pack(last.keys[p], last.n[p]) + weight[p].tobytes()) for b, p in A.deal(bucket, TOPS)])

    def bucketed(found):
        return A.messages([(s, b, blob) for b, s, blob in found]).rename_columns(["shard", "bucket", "blob"])

    def top_up(key, t):
        """Sums of depth 2 for each node of depth 1."""
        two = levels(bucket_entries(t)[2], SPLIT - 2)[-1]
        nodes, sums = [], []
        for k in range(8):
            head = two.keys[two.first[k]]
            nodes.append((head >> np.uint64(16)).astype(np.int64) << 8 | 1 << k | (head & np.uint64(255)).astype(np.int64) >> (8 - k))
            sums.append(np.stack([two.zeros[k], two.ones[k], two.pw[k]]))
        each, of = np.unique(np.concatenate(nodes), return_inverse=True)
        sums = [np.bincount(of, weights=x, minlength=len(each)) for x in np.concatenate(sums, axis=1)]
        return bucketed([(key[0].as_py(), 0, A.pack(each.astype("<i4"), *sums))])

    def root(t):
        parts = [A.unpack(b, "<i4", "<f8", "<f8", "<f8") for b in t["blob"].to_pylist()]
        nodes, zeros, ones, below = (np.concatenate([p[i] for p in parts]) for i in range(4))
        each, of = np.unique(nodes, return_inverse=True)
        give = roots(each, *(np.bincount(of, weights=x, minlength=len(each)) for x in (zeros, ones, below)))
        blob = A.pack(each.astype("<i4")) + give.tobytes()
        return bucketed([(b, -1, blob) for b in range(TOPS)])

    def top_down(key, t, told):
        """(A, B) of each entry of depth SPLIT and bit, in the order in which the shard sent them."""
        if not t.num_rows:
            return bucketed([])
        blob = told["blob"][0].as_py()
        n = len(blob) // 28
        nodes, give = np.frombuffer(blob, "<i4", n), np.frombuffer(blob, "<f8", 3 * n, 4 * n).reshape(n, 3)
        shards, places, level = bucket_entries(t)
        depths = levels(level, SPLIT - 2)
        ways = [np.arange(len(level.keys))]
        for d in depths[:-1]:
            ways.append(d.up[ways[-1]])
        out = np.empty((len(level.keys), 8, 2))
        byte, nearest = (level.keys & np.uint64(255)).astype(np.int64), (level.keys >> np.uint64(8 * SPLIT)).astype(np.int64)
        for k in range(8):
            at = np.searchsorted(nodes, nearest << 8 | 1 << k | byte >> (8 - k))
            a, b = np.where(level.bit[k], give[at, 1], give[at, 0]), give[at, 2]
            for d, way in zip(depths[:0:-1], ways[:0:-1], strict=True):
                stop = d.stop(k)[way]
                a, b = a + b * stop * d.estimate(k)[way], b * (1 - stop)
            out[:, k, 0], out[:, k, 1] = a, b
        return bucketed([(key[0].as_py(), s, out[p].tobytes()) for s, p in zip(shards, places, strict=True)])

    def price(key, t, told):
        """Answers: the counts of the words, and the prices of the grams; sums of the words under g = -1."""
        shard, sent, out = key[0].as_py(), by_kind(t), []
        if sent[b"t"]:
            parts = [A.unpack(b[1:], "<u8", "<i8") for _, b in sent[b"t"]]
            each, of = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            total = np.bincount(of, weights=np.concatenate([n for _, n in parts]), minlength=len(each)).astype("<i8")
            out += [(shard, g, b"t" + total[p].tobytes()) for (g, _), p in zip(sent[b"t"], np.split(of, np.cumsum([len(h) for h, _ in parts])[:-1]), strict=True)]
            out.append((shard, -1, np.array([total.sum(), np.count_nonzero(total)], "<i8").tobytes()))
        if sent[b"c"]:
            deep, places = shard_levels(sent[b"c"])
            last = deep[-1]
            bucket = (mix64(last.keys >> np.uint64(8 * (SPLIT - 1))) % np.uint64(TOPS)).astype(np.int64)
            blobs = dict(zip(told["bucket"].to_pylist(), told["blob"].to_pylist(), strict=True))
            above = np.empty((len(last.keys), 8, 2))
            for b, p in A.deal(bucket, TOPS):
                above[p] = np.frombuffer(blobs[b], "<f8").reshape(-1, 8, 2)
            each = prices(deep, above).astype("<f4")
            out += [(shard, g, b"c" + each[p].tobytes()) for (g, _), p in zip(sent[b"c"], places, strict=True)]
        return A.messages(out)

    def finish(key, t, told):
        if key[0].as_py() < 0:
            n, v = np.array([np.frombuffer(b, "<i8") for b in told["blob"].to_pylist()]).sum(axis=0).tolist()
            return pa.table({k: pa.array([x], f.type) for k, x, f in zip(schema.names, (None, None, n, v, None, None, None), schema, strict=True)})
        t = A.in_order(t)
        ids, texts = t["doc_id"].to_pylist(), utf8(t["text"])
        train = [not held_out(x) for x in ids]
        got = {(b[:1], s): b for s, b in zip(told["shard"].to_pylist(), told["blob"].to_pylist(), strict=True)}
        grams, tokens = Grams(texts), Tokens(texts, train, n_shards)
        value = np.zeros(len(grams.keys))
        for s, places in grams.dealt(n_shards):
            value[places] = np.frombuffer(got[b"c", s], "<f4", -1, 1)
        score = grams.sums(value)
        c = np.zeros(len(tokens.words), np.int64)
        for s, places in tokens.dealt:
            c[places] = np.frombuffer(got[b"t", s], "<i8", -1, 1)
        bits = [-x / np.log10(2) / len(t) if t else None for x, t in zip(score.tolist(), texts, strict=True)]
        values = (t["doc_id"], pa.array([not use for use in train], pa.bool_()), tokens.n, tokens.sums((c > 0).astype(np.int64)), tokens.sums(np.log10(c + 1)), score, pa.array(bits, pa.float64()))
        return pa.table(dict(zip(schema.names, values, strict=True)), schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    to_bucket = "shard int, bucket int, blob binary"
    by_group = rows.groupBy("g")
    asked = by_group.applyInArrow(ask, A.REQUEST).repartition(n_shards, "shard")
    ups = asked.groupBy("shard").applyInArrow(up, to_bucket).repartition(TOPS, "bucket")
    tops = ups.groupBy("bucket").applyInArrow(top_up, to_bucket).groupBy().applyInArrow(root, to_bucket)
    down = ups.groupBy("bucket").cogroup(tops.groupBy("bucket")).applyInArrow(top_down, to_bucket)
    answered = asked.groupBy("shard").cogroup(down.groupBy("shard")).applyInArrow(price, A.REQUEST)
    # A row without held_out has the sums of the words, which the base score needs.
    found = written(by_group.cogroup(answered.groupBy("g")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double"))
    total = found.where("held_out IS NULL").agg(F.sum("n_tokens").alias("n"), F.sum("n_known").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return found.where("held_out IS NOT NULL").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")
