"""Exact substring dedup with per-shard suffix arrays.

Which 400-byte strings start in two places or more? Anchors (see anchors.py) tell where that
can be. The contexts of repeated anchors go to the shard of the anchor's hash, one copy of each
distinct context. A shard sorts all suffixes of its contexts by Larsson-Sadakane refinement
(ranks at depth h give ranks at depth 2h, and only groups that are not yet split are sorted
again), takes the common prefixes of neighbours in Kasai's manner, and so finds the classes of
equal 400-byte strings. A shard whose contexts exceed PIECE_BYTES is cut into pieces with a
suffix array each, which are merged by binary search of every piece's strings in the others.
Each string start has one anchor and so lies in one context: a class with two members, or a
context that occurs twice, is a repeat.

`longest_repeat` tells of shorter repeats what the same suffix arrays show: from an anchor that stands
in two contexts, the common prefix of the two suffixes that begin there, and the common bytes before
it. It is a lower bound, of strings that hold an anchor in both places, and 0 below half the size.
Nothing is removed for its sake.

Anchors with more than HOT distinct contexts are settled by 128-bit fingerprints of single
strings, dealt over all shards, each group sending a string once: such a passage may stand in a
third of all documents.

Null texts are empty. Rows with a null doc_id take part like all others. Repeated rows are
copies of each other. A very long text is handled whole, in the memory of one task. An empty table
gives an empty one. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from quillmesh.llm import anchors as A
from quillmesh.llm.common import mix64, utf8

#: Bytes of the k-grams whose hashes pick anchors.
GRAM = 48
#: Contexts that one suffix array holds.
PIECE_BYTES = 3 << 20
#: Ranges of repeated window starts in a context; a first beyond the last means none.
FULL, NONE, SINGLY = 65535, (1, 0), 2


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Bytes(A.Group):
    """A group's bytes with the anchors of its windows."""

    def __init__(self, rows: pa.Table, size: int):
        self.rows = A.in_order(rows)
        texts = utf8(self.rows["text"])
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        super().__init__(size, GRAM, np.fromiter(map(len, texts), np.int64, len(texts)))
        if len(self.starts):
            roll = A.Rolling(_VALUES[self.data], _BASES[0])
            self.anchor(roll.every(GRAM), roll)

    def prints(self, starts: np.ndarray) -> np.ndarray:
        """128-bit fingerprints of windows."""
        return np.frombuffer(b"".join(hashlib.blake2b(self.raw[a : a + self.size], digest_size=16).digest() for a in starts.tolist()), A.PAIR)


def packed(items: np.ndarray, room: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first `count` items of each suffix as one integer; zero beyond its end."""
    n = len(items)
    padded = np.concatenate([items, np.zeros(count, items.dtype)])
    key = np.zeros(n, np.uint64)
    for j in range(count):
        key = (key << np.uint64(bits)) | np.where(room > j, padded[j : j + n], 0).astype(np.uint64)
    return key


def suffix_order(key: np.ndarray, h: int, room: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` items at least, equal ones by place.

    key orders them by the first h items; room: items up to each one's end.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    del ordered
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while h < depth:
        open_ = ~(head & np.r_[head[1:], True])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        some = order[at]
        beyond = room[some] <= h
        second = np.where(beyond, 0, rank[np.minimum(some + h, n - 1)] + 1)
        joint = (rank[some].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        move = np.argsort(joint, kind="stable")
        order[at] = some[move]
        joint = joint[move]
        head[at] = np.r_[True, joint[1:] != joint[:-1]]
        slot = np.maximum.accumulate(np.where(head[at], at, 0))
        rank[order[at]] = slot
        h *= 2
    return order


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: common prefix of each suffix in the order with the one before it.

    In text order the prefix shrinks by one where both suffixes just move on by one byte; only
    the other places are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (room[1:] == room[:-1] - 1) & (data[:-1] == data[np.maximum(before[1:] - 1, 0)])
    carried[1:] &= room[np.maximum(before[1:], 0)] == room[np.maximum(before[1:] - 1, 0)] - 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
    length = np.zeros(n, np.int64)
    live = np.flatnonzero(~carried & (before >= 0))
    done = 0
    while len(live):
        other = before[live]
        most = np.minimum(room[live], room[other])
        inside = most > done
        diff = word[np.minimum(live + done, n - 1)] ^ word[np.minimum(other + done, n - 1)]
        same = np.full(len(live), 8, np.int64)
        for j in range(7, -1, -1):
            same[(diff >> np.uint64(8 * (7 - j))) & np.uint64(255) != 0] = j
        length[live] = np.minimum(most, length[live] + np.where(inside, same, 0))
        live = live[inside & (same == 8)]
        done += 8
    index = np.arange(n)
    start = np.maximum.accumulate(np.where(carried, -1, index))
    plcp = np.maximum(length[np.maximum(start, 0)] - (index - start), 0)
    return plcp[order]


def around_anchors(data: np.ndarray, order: np.ndarray, common: np.ndarray, at: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each anchor (its place, its hash as `kind`, the start of its context): the longest stretch around it that it shares with a neighbour of its kind in the suffix order."""
    rank = np.empty(len(data), np.int64)
    rank[order] = np.arange(len(data))
    line = np.lexsort((rank[at], kind))
    ranks, kinds = rank[at[line]], kind[line]
    pair = np.flatnonzero(kinds[1:] == kinds[:-1])  # neighbours of one kind
    out = np.zeros(len(at), np.int64)
    if not len(pair):
        return out
    cuts = np.stack([ranks[pair] + 1, ranks[pair + 1] + 1], axis=1).reshape(-1)
    ahead = np.minimum.reduceat(np.r_[common, 0], cuts)[::2]
    one, two = line[pair], line[pair + 1]
    room = np.minimum(at[one] - starts[one], at[two] - starts[two])
    live, done = np.arange(len(pair)), np.zeros(len(pair), np.int64)
    while len(live):  # byte by byte backward, all pairs that still agree
        live = live[done[live] < room[live]]
        live = live[data[at[one[live]] - 1 - done[live]] == data[at[two[live]] - 1 - done[live]]]
        done[live] += 1
    np.maximum.at(out, one, ahead + done)
    np.maximum.at(out, two, ahead + done)
    return out


def repeated_starts(texts: list[bytes], size: int, at_once: int = PIECE_BYTES, anchors: list[tuple[int, int]] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text, whether each of its windows of `size` bytes starts twice or more in all of them;
    and what its anchor (hash, offset) shares with another text of the same piece (see around_anchors)."""
    if not texts:
        return [], np.zeros(0, np.int64)
    shared = np.zeros(len(texts), np.int64)
    pieces, held = [[]], 0
    for i, t in enumerate(texts):
        if held and held + len(t) > at_once:
            pieces.append([])
            held = 0
        pieces[-1].append(i)
        held += len(t)
    marks, prints = [], []
    for piece in pieces:
        joined = b"".join(texts[i] for i in piece)
        data = np.frombuffer(joined, np.uint8)
        lengths = np.array([len(texts[i]) for i in piece], np.int64)
        room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
        order = suffix_order(packed(data, room, 8, 8), 8, room, size)
        common = common_prefixes(data, room, order)
        if anchors:
            begin = np.cumsum(lengths) - lengths
            kind, offset = (np.array([anchors[i][j] for i in piece], t) for j, t in ((0, np.uint64), (1, np.int64)))
            shared[piece] = around_anchors(data, order, common, begin + offset, kind, begin)
        close = common >= size
        mark = np.zeros(len(data), bool)
        mark[order] = close | np.r_[close[1:], False]
        marks.append((mark, room >= size, lengths))
        if len(pieces) > 1:  # sorted fingerprints, for the binary search
            full = np.flatnonzero(room >= size)
            own = A.Rolling(_VALUES[data], _BASES[1]).of(full, full + size)
            sort = np.argsort(own)
            prints.append((own[sort], full[sort], data))
    for i, (own, at, data) in enumerate(prints):
        for j, (other, other_at, other_data) in enumerate(prints):
            if i == j or not len(other):
                continue
            place = np.searchsorted(other, own)
            place[place == len(other)] = 0
            hit = np.flatnonzero((other[place] == own) & ~marks[i][0][at])
            for q in hit.tolist():
                p, a = int(place[q]), int(at[q])
                while p < len(other) and other[p] == own[q]:
                    b = int(other_at[p])
                    if np.array_equal(data[a : a + size], other_data[b : b + size]):
                        marks[i][0][a] = True
                        break
                    p += 1
    out = []
    for mark, full, lengths in marks:
        cuts = np.cumsum(lengths)[:-1]
        out += [m[f] for m, f in zip(np.split(mark, cuts), np.split(full, cuts), strict=True)]
    return out, shared


def substring_dedup(docs: DataFrame, size: int = 400, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, group_bytes: int = A.GROUP_BYTES, hot: int = A.HOT, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat, spans (start, end of the removed runs), kept (bytes, on demand)."""
    if size <= GRAM:
        raise ValueError(f"windows need more than {GRAM} bytes")
    rows, n_groups = A.grouped(docs, doc_id, text, group_bytes)
    n_shards = max(1, n_groups // 2)
    types = ("<u8", "<u8", "<u4")

    def twice_or_more(weight):
        return lambda order, heads: np.add.reduceat(weight[order].astype(np.int64), heads) > 1

    def ask(key, t):
        g, group = key[0].as_py(), Bytes(t, size)
        return A.messages([(s, g, A.pack(group.unique["h"][p], group.unique["c"][p], group.count[p].astype("<u4"))) for s, p in group.dealt(n_shards)])

    def judge(key, t):
        counts, (h, c, weight) = A.gathered(t, *types)
        return A.answers(key[0].as_py(), counts, A.vote(h, c, twice_or_more(weight), hot))

    def send(key, t, told):
        """Contexts ('c' first) to their anchor's shard; single windows ('w' first) to their fingerprint's."""
        g, group, out = key[0].as_py(), Bytes(t, size), []
        (code,) = group.answered(told, n_shards, np.uint8)
        squeeze = zstandard.ZstdCompressor(level=1)
        for s, places in group.dealt(n_shards):
            chosen = places[code[places] == A.SEND]
            if len(chosen):
                first, end = group.first[group.member[chosen]], group.last[group.member[chosen]] + size
                body = b"".join(group.raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True))
                offset = group.place[group.member[chosen]] - first
                head = np.array(len(chosen), "<u4").tobytes() + A.pack(group.unique["h"][chosen], group.unique["c"][chosen], (end - first).astype("<u4"), offset.astype("<u4"))
                out.append((s, g, b"c" + squeeze.compress(head + body)))
        spread = np.flatnonzero(code[group.of] == A.SPREAD)
        if len(spread):
            each, count = np.unique(group.prints(group.windows(spread)), return_counts=True)
            out += [(s, g, b"w" + A.pack(each["h"][p], each["c"][p], count[p].astype("<u4"))) for s, p in A.deal((each["h"] % np.uint64(n_shards)).astype(np.int64), n_shards)]
        return A.messages(out)

    def settle(key, asked, sent):
        """For each request the first and last repeated window start of its context; repeated single windows."""
        shard, expand = key[0].as_py(), zstandard.ZstdDecompressor()
        texts, keys, anchors, single, out = [], [], [], [], []
        for g, blob in zip(sent["g"].to_pylist(), sent["blob"].to_pylist(), strict=True):
            if blob[:1] == b"w":
                single.append((g, blob[1:]))
                continue
            body = expand.decompress(blob[1:])
            edge = 4 + 24 * int(np.frombuffer(body, "<u4", 1)[0])
            h, c, sizes, offset = A.unpack(body[4:edge], *types, "<u4")
            keys += zip(h.tolist(), c.tolist(), strict=True)
            anchors += zip(h.tolist(), offset.tolist(), strict=True)
            for m in sizes.tolist():
                texts.append(body[edge : edge + m])
                edge += m
        ranges = {}
        for k, mark, most in zip(keys, *repeated_starts(texts, size, piece_bytes, anchors), strict=True):
            at = np.flatnonzero(mark)
            ranges[k] = (*((int(at[0]), int(at[-1])) if len(at) else NONE), min(int(most), FULL))
        if asked.num_rows:
            counts, (h, c, weight) = A.gathered(asked, *types)
            code = A.vote(h, c, twice_or_more(weight), hot)
            lo, hi = np.full(len(h), NONE[0], "<u2"), np.full(len(h), NONE[1], "<u2")
            most = np.zeros(len(h), "<u2")
            lo[code == A.SPREAD] = SINGLY
            _, of = np.unique(A.paired(h, c), return_inverse=True)
            twice = np.bincount(of, weights=weight)[of] > 1
            lo[twice], hi[twice] = 0, FULL
            for i in np.flatnonzero(~twice & (code == A.SEND)).tolist():
                lo[i], hi[i], most[i] = ranges[int(h[i]), int(c[i])]
            most[twice] = size
            out.append(A.answers(shard, counts, lo, hi, most))
        if single:
            parts = [A.unpack(b, *types) for _, b in single]
            fa, fb, weight = (np.concatenate([x[i] for x in parts]) for i in range(3))
            _, of = np.unique(A.paired(fa, fb), return_inverse=True)
            twice = np.split(np.bincount(of, weights=weight)[of] > 1, np.cumsum([len(x[0]) for x in parts])[:-1])
            out.append(A.messages([(-1 - shard, g, A.pack(x[0][m], x[1][m])) for (g, _), x, m in zip(single, parts, twice, strict=True) if m.any()]))
        return pa.concat_tables(out) if out else A.messages([])

    def finish(key, t, told):
        group = Bytes(t, size)
        n = len(group.data)
        edge = np.zeros(n + 1, np.int64)
        alone = pa.array(np.array(told["shard"].to_pylist(), np.int64) < 0)
        lo, hi, most = (x[group.of].astype(np.int64) for x in group.answered(told.filter(pc.invert(alone)), n_shards, "<u2", "<u2", "<u2"))
        longest = np.zeros(len(group.lengths), np.int64)
        np.maximum.at(longest, np.searchsorted(group.ends, group.place, "right"), np.where(most >= size // 2, most, 0))
        some = lo <= hi
        np.add.at(edge, group.first[some] + lo[some], 1)
        np.add.at(edge, np.minimum(group.first[some] + hi[some], group.last[some]) + size, -1)
        singly = told.filter(alone)
        if singly.num_rows:
            parts = [A.paired(*A.unpack(b, "<u8", "<u8")) for b in singly["blob"].to_pylist()]
            starts = group.windows(np.flatnonzero((lo == SINGLY) & (hi == NONE[1])))
            starts = starts[np.isin(group.prints(starts), np.concatenate(parts))]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
        gone = np.cumsum(edge[:n]) > 0
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat", "spans", "kept")}
        for end, length, most in zip(group.ends.tolist(), group.lengths.tolist(), longest.tolist(), strict=True):
            mask, data = gone[end - length : end], group.data[end - length : end]
            change = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            left = data[~mask].tobytes()
            for k, v in zip(out, (length, int(mask.sum()), len(change) // 2, hashlib.sha256(left).hexdigest(), max(most, size if len(change) else 0), change.reshape(-1, 2).tolist(), left if keep_text else None), strict=True):
                out[k].append(v)
        return pa.table({"doc_id": group.rows["doc_id"], **out}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("longest_repeat", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
    by_group = rows.groupBy("g")
    asked = by_group.applyInArrow(ask, A.REQUEST).repartition(n_shards, "shard")
    codes = asked.groupBy("shard").applyInArrow(judge, A.REQUEST)
    sent = by_group.cogroup(codes.groupBy("g")).applyInArrow(send, A.REQUEST)
    settled = asked.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(settle, A.REQUEST)
    return by_group.cogroup(settled.groupBy("g")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_repeat long, spans array<array<long>>, kept binary")
