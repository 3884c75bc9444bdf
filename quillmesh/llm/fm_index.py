"""Substring dedup by words with a compressed FM-index per shard.

A window is `size` consecutive words of one document; words under a window that also starts in
a document with a smaller doc_id are removed. Anchors (see anchors.py, here over 5-word
shingles) tell where windows can repeat. The distinct contexts of repeated anchors go to the
shard of the anchor's hash, where they are indexed: suffix order, Burrows-Wheeler transform,
and a wavelet matrix (a bit vector with popcount directory for each bit of the word numbers).
Every window of the streamed contexts is then sought backward, word by word, through the
wavelet matrix, all of a shard's windows at once; the interval that is left at `size` matched
words holds every place of the window, and the smallest doc_id over it is the window's first
document. Matching statistics are cut at the threshold: a longer match is a run of windows.

Equal contexts of a group or of the whole input share one entry with the smallest doc_id. An
anchor with more than HOT distinct contexts is settled window by window, by 128-bit hashes
dealt over all shards.

Null texts have no words. Rows with a null doc_id come after all others: their windows may be
removed for any document's sake, and remove none of others. Rows with the same doc_id remove
nothing from each other; repeated rows give repeated results. A very long text is handled whole, in
the memory of one task. An empty table gives an empty one. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillmesh.llm import anchors as A
from quillmesh.llm.common import gram_hashes, mix64, utf8
from quillmesh.llm.suffixes import packed, suffix_order

GRAM = 5
LAST = np.iinfo(np.int64).max
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(5))
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; no word goes over a break."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix64(A.Rolling(_BYTE[data], _BASES[0]).of(a, b) + (b - a).astype(np.uint64)), a


class Words(A.Group):
    """A group's words, as hashes, with the anchors of its windows."""

    def __init__(self, rows: pa.Table, size: int):
        self.rows = A.in_order(rows)
        self.texts = utf8(self.rows["text"])
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))
        self.words, at = word_hashes(data, ends[:-1])
        upto = np.searchsorted(at, ends)
        super().__init__(size, GRAM, np.diff(np.r_[0, upto]))
        ids = np.array([LAST if x is None else x for x in self.rows["doc_id"].to_pylist()], np.int64)
        if len(self.starts):
            self.anchor(gram_hashes(self.words, GRAM), A.Rolling(self.words, _BASES[1]))
        self.doc = ids[np.searchsorted(self.ends, self.first, "right")]
        self.low, self.high = np.full(len(self.unique), LAST), np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.of, self.doc)
        np.maximum.at(self.high, self.of, self.doc)

    def prints(self, starts: np.ndarray) -> np.ndarray:
        """128-bit hashes of windows."""
        out = [np.zeros(len(starts), np.uint64) for _ in range(2)]
        for j in range(self.size):
            for o, base in zip(out, _BASES, strict=True):
                o *= np.uint64(base)
                o += mix64(self.words[starts + j] ^ np.uint64(base))
        return A.paired(mix64(out[0]), mix64(out[1]))

    def window_docs(self, some: np.ndarray) -> np.ndarray:
        """The document of every window of these anchors, in the order of windows()."""
        return np.repeat(self.doc[some], self.last[some] - self.first[some] + 1)


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector a level, with a count each 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(n_symbols)
        self.start = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for depth in range(self.levels):
            block, inside = place >> 6, (place & 63).astype(np.uint64)
            ones = self.counts[depth][block] + np.bitwise_count(self.bits[depth][block] & ((np.uint64(1) << inside) - np.uint64(1)))
            place = np.where(symbol >> (self.levels - 1 - depth) & 1, self.zeros[depth] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self.start[symbol]


class FMIndex:
    """Word contexts with a separator after each; symbol 0 separates and is never sought."""

    def __init__(self, contexts: list[np.ndarray]):
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.alphabet, ids = np.unique(np.concatenate(contexts), return_inverse=True)
        n = int(sizes.sum() + len(sizes))
        text, ends = np.zeros(n, np.int64), np.cumsum(sizes + 1)
        body = np.ones(n, bool)
        body[ends - 1] = False
        text[body] = ids + 1
        room = np.repeat(ends, sizes + 1) - np.arange(n)
        bits = max(1, int(len(self.alphabet)).bit_length())
        count = max(1, min(8, 63 // bits))
        order = suffix_order(packed(text, room, count, bits), count, room, int(sizes.max()) + 1)
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))]
        self.matrix = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.n, self.text, self.place = n, text, ends - sizes - 1

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of patterns (symbols) at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, j]
            base = self.smaller[symbol]
            lo, hi = base + self.matrix.rank(symbol, lo), base + self.matrix.rank(symbol, hi)
        return lo, hi


def first_docs(contexts: list[np.ndarray], low: np.ndarray, size: int) -> np.ndarray:
    """Of every window of the contexts, end to end: the smallest `low` of a context that holds it."""
    index = FMIndex(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    room = sizes - size + 1
    starts = np.repeat(index.place - (np.cumsum(room) - room), room) + np.arange(room.sum())
    patterns = index.text[starts[:, None] + np.arange(size)]
    _, member, of = np.unique(gram_hashes(mix64(index.text.astype(np.uint64)), size)[starts], return_index=True, return_inverse=True)
    lo, hi = index.intervals(patterns[member])
    docs = np.r_[low[index.owner], LAST]
    smallest = np.minimum.reduceat(docs, np.c_[lo, hi].reshape(-1))[::2]
    return smallest[of]


def word_dedup(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, group_bytes: int = A.GROUP_BYTES, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (first and last word + 1 of the removed runs), kept (text, on demand)."""
    if not GRAM < size <= GRAM + 59:
        raise ValueError(f"windows have {GRAM + 1} to {GRAM + 59} words")
    rows, n_groups = A.grouped(docs, doc_id, text, group_bytes)
    n_shards = max(1, n_groups // 2)
    types = ("<u8", "<u8", "<i8", "<i8")

    def two_docs(low, high):
        return lambda order, heads: np.minimum.reduceat(low[order], heads) < np.maximum.reduceat(high[order], heads)

    def smallest(pairs, low):
        """For each entry the smallest low of the entries with an equal pair."""
        _, of = np.unique(pairs, return_inverse=True)
        least = np.full(of.max() + 1 if len(of) else 0, LAST)
        np.minimum.at(least, of, low)
        return least[of]

    def ask(key, t):
        g, group = key[0].as_py(), Words(t, size)
        return A.messages([(s, g, A.pack(group.unique["h"][p], group.unique["c"][p], group.low[p], group.high[p])) for s, p in group.dealt(n_shards)])

    def judge(key, t):
        counts, (h, c, low, high) = A.gathered(t, *types)
        return A.answers(key[0].as_py(), counts, A.vote(h, c, two_docs(low, high), hot))

    def send(key, t, told):
        """Contexts ('c' first) to their anchor's shard; single windows ('w' first) to their hash's."""
        g, group, out = key[0].as_py(), Words(t, size), []
        (code,) = group.answered(told, n_shards, np.uint8)
        for s, places in group.dealt(n_shards):
            chosen = places[code[places] == A.SEND]
            if len(chosen):
                first, end = group.first[group.member[chosen]], group.last[group.member[chosen]] + size
                body = np.concatenate([group.words[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                out.append((s, g, b"c" + np.array(len(chosen), "<u4").tobytes() + A.pack(group.unique["h"][chosen], group.unique["c"][chosen], (end - first).astype("<u4")) + body.tobytes()))
        spread = np.flatnonzero(code[group.of] == A.SPREAD)
        if len(spread):
            each, of = np.unique(group.prints(group.windows(spread)), return_inverse=True)
            low = np.full(len(each), LAST)
            np.minimum.at(low, of, group.window_docs(spread))
            out += [(s, g, b"w" + A.pack(each["h"][p], each["c"][p], low[p])) for s, p in A.deal((each["h"] % np.uint64(n_shards)).astype(np.int64), n_shards)]
        return A.messages(out)

    def settle(key, asked, sent):
        """For each request: bits of the windows of its context that an earlier document has, by the request's own smallest doc_id."""
        shard, contexts, keys, single, out = key[0].as_py(), [], [], [], []
        for g, blob in zip(sent["g"].to_pylist(), sent["blob"].to_pylist(), strict=True):
            if blob[:1] == b"w":
                single.append((g, blob[1:]))
                continue
            edge = 5 + 20 * int(np.frombuffer(blob, "<u4", 1, 1)[0])
            h, c, sizes = A.unpack(blob[5:edge], "<u8", "<u8", "<u4")
            keys += zip(h.tolist(), c.tolist(), strict=True)
            contexts += np.split(np.frombuffer(blob, "<u8", -1, edge), np.cumsum(sizes)[:-1])
        if asked.num_rows:
            counts, (h, c, low, high) = A.gathered(asked, *types)
            code = A.vote(h, c, two_docs(low, high), hot)
            pairs = A.paired(h, c)
            least = smallest(pairs, low)
            bits = np.where((code == A.SAME) & (least < low), ALL, np.uint64(0))
            bits[code == A.SPREAD] = SINGLY
            if contexts:
                of_key = dict(zip(zip(h.tolist(), c.tolist(), strict=True), least.tolist(), strict=True))
                docs_of = np.array([of_key[k] for k in keys], np.int64)
                found = first_docs(contexts, docs_of, size)
                room = np.fromiter(map(len, contexts), np.int64, len(contexts)) - size + 1
                windows = dict(zip(keys, np.split(found, np.cumsum(room)[:-1]), strict=True))
                for i in np.flatnonzero((code == A.SEND) | (code == A.KNOWN)).tolist():
                    earlier = windows[int(h[i]), int(c[i])] < low[i]
                    if earlier.any():
                        bits[i] = np.uint64(int.from_bytes(np.packbits(earlier, bitorder="little").tobytes(), "little"))
            out.append(A.answers(shard, counts, bits))
        if single:
            parts = [A.unpack(b, "<u8", "<u8", "<i8") for _, b in single]
            fa, fb, low = (np.concatenate([x[i] for x in parts]) for i in range(3))
            earlier = np.split(smallest(A.paired(fa, fb), low) < low, np.cumsum([len(x[0]) for x in parts])[:-1])
            out.append(A.messages([(-1 - shard, g, A.pack(x[0][m], x[1][m])) for (g, _), x, m in zip(single, parts, earlier, strict=True) if m.any()]))
        return pa.concat_tables(out) if out else A.messages([])

    def finish(key, t, told):
        group = Words(t, size)
        n = len(group.words)
        alone = pa.array(np.array(told["shard"].to_pylist(), np.int64) < 0)
        (bits,) = group.answered(told.filter(pc.invert(alone)), n_shards, "<u8")
        spread = (bits == SINGLY)[group.of]
        # The anchors that stand in more than the group's smallest document of their context are repeats anyway.
        later = group.doc > group.low[group.of]
        known = np.isin(bits, [np.uint64(0), SINGLY])[group.of]
        some = np.flatnonzero(~spread & (later | ~known))
        starts = group.windows(some)
        shift = (starts - np.repeat(group.first[some], group.last[some] - group.first[some] + 1)).astype(np.uint64)
        each = np.where(later[some], ALL, bits[group.of[some]])
        starts = starts[np.repeat(each, group.last[some] - group.first[some] + 1) >> shift & np.uint64(1) == 1]
        if spread.any():
            some = np.flatnonzero(spread)
            windows, docs_of = group.windows(some), group.window_docs(some)
            prints = group.prints(windows)
            earlier = smallest(prints, docs_of) < docs_of
            parts = [A.paired(*A.unpack(b, "<u8", "<u8")) for b in told.filter(alone)["blob"].to_pylist()]
            if parts:
                earlier |= np.isin(prints, np.concatenate(parts))
            starts = np.concatenate([starts, windows[earlier]])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + size, -1)
        gone = np.cumsum(edge[:n]) > 0
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "spans", "kept")}
        for words, end, length in zip(group.texts, group.ends.tolist(), group.lengths.tolist(), strict=True):
            mask, words = gone[end - length : end], words.split()
            change = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            spans = change.reshape(-1, 2).tolist()
            for a, b in reversed(spans):
                del words[a:b]
            left = b" ".join(words)
            for k, v in zip(out, (length, length - len(words), hashlib.sha256(left).hexdigest(), spans, left.decode("utf-8", "replace") if keep_text else None), strict=True):
                out[k].append(v)
        return pa.table({"doc_id": group.rows["doc_id"], **out}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])
    by_group = rows.groupBy("g")
    asked = by_group.applyInArrow(ask, A.REQUEST).repartition(n_shards, "shard")
    codes = asked.groupBy("shard").applyInArrow(judge, A.REQUEST)
    sent = by_group.cogroup(codes.groupBy("g")).applyInArrow(send, A.REQUEST)
    settled = asked.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(settle, A.REQUEST)
    return by_group.cogroup(settled.groupBy("g")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept string")


#: Answers in bits: all windows; "settled window by window".
ALL, SINGLY = ~np.uint64(0) >> np.uint64(1), np.uint64(1) << np.uint64(63)
