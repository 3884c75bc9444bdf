"""Finding where repeats can be, by requests and answers between groups and shards.

Documents are dealt into groups of a few MB by a hash of the row; every pass over the groups
reads the same shuffled rows. A pass sends requests, packed as binary values for each
(shard, group), and gets answers aligned with them, so that small answers and not texts cross
the network. Nothing but counts of bytes reaches the driver.

An anchor is the leftmost smallest k-gram hash in a window, so equal windows have their anchor
at the same place, and each window start belongs to exactly one anchor. An anchor's context is
the stretch that its windows cover. A window can only repeat where its anchor's hash repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_batches, mix64, n_groups

#: Text of one group of documents.
GROUP_BYTES = 4 << 20
#: An anchor hash with more distinct contexts is settled window by window, in many shards.
HOT = 4096
#: Codes of the answer to an anchor request.
ALONE, SEND, KNOWN, SAME, SPREAD = range(5)

REQUEST = "shard int, g int, blob binary"


def grouped(docs: DataFrame, doc_id: str, text: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, row, g) dealt by g, and the count of groups."""
    picked = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = n_groups(picked, each=group_bytes)
    row = F.xxhash64("doc_id", "text")
    return picked.withColumn("row", row).withColumn("g", F.pmod(F.col("row"), F.lit(n)).cast("int")).repartition(n, "g"), n


def in_order(rows: pa.Table) -> pa.Table:
    """The group's rows in an order that every pass finds again; rows with equal keys are equal."""
    return rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each `width` consecutive values (by their high 32 bits)."""
    n = len(values)
    low = np.uint64((1 << 32) - 1)
    keyed = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = keyed
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def runs(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive window starts with one anchor: anchor place, first start, last start."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    tail = np.r_[head[1:], len(starts)] - 1
    return owner[head], starts[head], starts[tail]


class Rolling:
    """Hashes of any stretch of an array of 64-bit values, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power = np.full(n + 1, np.uint64(base))
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])
        self.back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal stretches hash equally wherever they stand, in any array."""
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.back[:-k])


class Group:
    """Base of a group's windows: items lie in one array, `lengths` of them in each document.

    Sets the anchors' place and first and last window start, and the distinct (anchor hash h,
    context hash c) with the first occurrence of each (member), those of all anchors (of) and
    their counts.
    """

    def __init__(self, size: int, gram: int, lengths: np.ndarray):
        self.size, self.gram, self.lengths, self.ends = size, gram, lengths, np.cumsum(lengths)
        room = np.maximum(lengths - size + 1, 0)
        self.starts = np.repeat(self.ends - lengths - (np.cumsum(room) - room), room) + np.arange(room.sum())
        self.place = self.first = self.last = self.member = self.of = self.count = np.zeros(0, np.int64)
        self.unique = np.zeros(0, PAIR)

    def anchor(self, grams: np.ndarray, roll: Rolling) -> None:
        self.place, self.first, self.last = runs(self.starts, sliding_argmin(grams, self.size - self.gram + 1)[self.starts])
        shape = (self.place - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        pairs = paired(grams[self.place], mix64(roll.of(self.first, self.last + self.size) ^ mix64(shape + np.uint64(1))))
        self.unique, self.member, self.of, self.count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)

    def dealt(self, n_shards: int):
        return deal((self.unique["h"] % np.uint64(n_shards)).astype(np.int64), n_shards)

    def answered(self, rows: pa.Table, n_shards: int, *types) -> list[np.ndarray]:
        """The answers in the order of unique."""
        got = {s: unpack(b, *types) for s, b in zip(rows["shard"].to_pylist(), rows["blob"].to_pylist(), strict=True)}
        out = [np.zeros(len(self.unique), t) for t in types]
        for s, places in self.dealt(n_shards):
            for o, a in zip(out, got[s], strict=True):
                o[places] = a
        return out

    def windows(self, some: np.ndarray) -> np.ndarray:
        """All window starts of these anchors."""
        room = self.last[some] - self.first[some] + 1
        return np.repeat(self.first[some] - (np.cumsum(room) - room), room) + np.arange(room.sum())


PAIR = np.dtype([("h", "<u8"), ("c", "<u8")])


def paired(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), PAIR)
    out["h"], out["c"] = h, c
    return out


def deal(shard: np.ndarray, n_shards: int):
    """(shard, places) of the shards that have any, places in ascending order."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(n_shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, order[edges[s] : edges[s + 1]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; unpack needs their types."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(blob) // sum(sizes), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.frombuffer(blob, t, n, at))
        at += n * size
    return out


def gathered(rows: pa.Table, *types) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Of a shard's requests, ordered by group: (group, count) of each, and the arrays end to end."""
    rows = rows.sort_by("g")
    parts = [unpack(b, *types) for b in rows["blob"].to_pylist()]
    arrays = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]
    return [(g, len(p[0])) for g, p in zip(rows["g"].to_pylist(), parts, strict=True)], arrays


def answers(shard: int, counts: list[tuple[int, int]], *arrays: np.ndarray) -> pa.Table:
    """Answers aligned with the gathered requests, cut by group."""
    at, out = 0, []
    for g, n in counts:
        out.append((shard, g, pack(*(a[at : at + n] for a in arrays))))
        at += n
    return messages(out)


def messages(found: list[tuple[int, int, bytes]]) -> pa.Table:
    """(shard, g, blob) rows."""
    shard, g, blob = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"shard": pa.array(shard, pa.int32()), "g": pa.array(g, pa.int32()), "blob": pa.array(blob, pa.binary())})


def vote(h: np.ndarray, c: np.ndarray, repeats, hot: int = HOT) -> np.ndarray:
    """Codes of requests (anchor hash, context hash), ordered by group.

    repeats(order, heads): whether each run of equal h is a repeat. The first request of a
    context sends it; where a repeated anchor has but one context, nobody needs to.
    """
    n = len(h)
    order = np.lexsort((c, h))
    hs, cs = h[order], c[order]
    new_h = np.r_[True, hs[1:] != hs[:-1]]
    new_c = new_h | np.r_[True, cs[1:] != cs[:-1]]
    heads = np.flatnonzero(new_h)
    of = np.cumsum(new_h) - 1
    kinds = np.add.reduceat(new_c.astype(np.int64), heads)[of]
    again = repeats(order, heads)[of]
    code = np.where(~again, ALONE, np.where(kinds == 1, SAME, np.where(kinds > hot, SPREAD, np.where(new_c, SEND, KNOWN))))
    out = np.zeros(n, np.uint8)
    out[order] = code
    return out
