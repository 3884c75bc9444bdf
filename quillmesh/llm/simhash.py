"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 bits: a bit is set if over half of the text's shingle hashes have it.
Distinct fingerprints meet in tables keyed by pairs of bit bands: at most four differing bits
touch at most four of six bands, so two bands are equal in any pair that links. In each key's
group the fingerprints stand as vertical bit planes (one 64-bit word holds one bit of 64
fingerprints); differing bits of 64 pairs at once go through carry-save counters, and a block
of lanes is abandoned once every lane exceeds the radius. Groups give a spanning forest of
their links, not all pairs, and components come from min-label contraction of those edges.

Where a similarity is asked for, `similar_groups` takes each text's set of distinct shingles and
verifies every link by the sets' Jaccard similarity (exact up to collisions of 64-bit hashes).
Candidates are the fingerprints' links, found as above, and, as 64 bits tell a similarity too coarsely to
find all pairs, those of MinHash besides: 24 bands of 5 hashes, of which a pair at exactly 0.8 misses all in 7
of 100,000 cases. Documents of one band hang together as a candidate component, whose sets are
then compared pair by pair.

A text without words has the fingerprint zero. Null texts count as empty, rows with a null
doc_id get a fingerprint and the component of their fingerprint's rows (null if it has no
other). Repeated rows give repeated results. Very long texts are shingled whole. An empty table
gives an empty one. Extra columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_batches, column, distinct, mix64, release, shared_dir, slices, utf8, written
from quillmesh.sources.shared import passing

BANDS = 6
RADIUS = 4
#: Fingerprints of one key that one task compares; larger groups are cut and compared part by part.
PART = 8192
#: Groups up to this size are compared many at once, larger ones each by its own planes.
SMALL = 24
#: MinHash bands of a set, and the hashes of each.
TABLES, ROWS = 24, 5
#: Shingles of one candidate component that one task compares; larger components are cut and compared part by part.
SET_PART = 400_000
#: Rows of the band tables that one task sorts.
BUCKET_ROWS = 200_000
_TURNS = mix64(np.arange(1, TABLES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k consecutive lower-cased words joined by a space; of all words if there are fewer."""
    words = text.lower().split()  # bytes: only A-Z change
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = max(1, n - k + 1)
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(starts[:m].tolist(), ends[n - m :].tolist(), strict=True)), np.uint64, m)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    picked = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(x, k)) for x in utf8(column(batch, "text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return picked.mapInArrow(run, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical form of rows of 64-bit words: plane b holds bit b of all rows, 64 rows a word."""
    n, width = values.shape
    padded = np.zeros((-(-n // 64) * 64, width), np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def add(a, b, c):
    """Carry-save adder over lanes: sum and carry of three bits."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def exceeds(digits: list, number: int):
    """Lanes whose binary number (low digit first) is greater than that."""
    over, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for j in range(len(digits) - 1, -1, -1):
        if number >> j & 1:
            equal = equal & digits[j]
        else:
            over = over | (equal & digits[j])
            equal = equal & ~digits[j]
    return over


def beyond(diff_of, shape: tuple, radius: int, bits: int) -> np.ndarray:
    """Sliced over lanes: a lane's bit is 1 if its pair differs in more than `radius` bits, of 7 at most.

    diff_of(b) gives plane b of the differences. Eight planes at a time go through a tree of
    carry-save adders into counters of ones, twos and fours; what carries out of the fours is more
    than the radius. The work ends once all lanes exceed it.
    """
    if radius > 7 or bits % 8:
        raise ValueError("the counters hold a radius of 7 over whole octets of planes")
    ones, twos, fours, over = (np.zeros(shape, np.uint64) for _ in range(4))
    for b in range(0, bits, 8):
        halves = []
        for at in (b, b + 4):
            ones, left = add(ones, diff_of(at), diff_of(at + 1))
            ones, right = add(ones, diff_of(at + 2), diff_of(at + 3))
            twos, half = add(twos, left, right)
            halves.append(half)
        fours, eights = add(fours, *halves)
        over |= eights
        out = over | exceeds([ones, twos, fours], radius)
        if (out == ~np.uint64(0)).all():
            break
    return out


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, others) -> None:
        roots = {self.root(i), *(self.root(int(j)) for j in others)}
        low = min(roots)
        for r in roots:
            self.up[r] = low


def link_small(fps: np.ndarray, group: np.ndarray, radius: int, forest: Forest, rows: np.ndarray) -> None:
    """Groups as runs of equal `group`: row i against row i + s for each shift s within the run."""
    n = len(fps)
    idx, s = np.arange(n), 1
    while True:
        idx = idx[idx + s < n]
        idx = idx[group[idx] == group[idx + s]]
        if not len(idx):
            return
        for at in range(0, len(idx), 1 << 16):
            part = idx[at : at + (1 << 16)]
            diff = planes(fps[part] ^ fps[part + s])
            near = np.unpackbits((~beyond(diff.__getitem__, diff.shape[1:], radius, len(diff))).view(np.uint8), bitorder="little")[: len(part)]
            part = part[near > 0]
            for i in part.tolist():
                forest.join(int(rows[i]), [rows[i + s]])
        s += 1


def link_block(left: np.ndarray, right: np.ndarray, radius: int, forest: Forest, left_at: np.ndarray, right_at: np.ndarray) -> None:
    """Every left fingerprint against the bit planes of all right ones."""
    sliced = planes(right)
    full = ~np.uint64(0)
    step = max(1, (1 << 17) // max(1, sliced.shape[1]))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        mask = lambda b: np.where(some[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), full, np.uint64(0))[:, None]  # noqa: B023, E731
        near = ~beyond(lambda b: sliced[b][None, :] ^ mask(b), (len(some), sliced.shape[1]), radius, len(sliced))  # noqa: B023
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            hits = np.flatnonzero(np.unpackbits(near[q].view(np.uint8), bitorder="little")[: len(right)])
            if len(hits):
                forest.join(int(left_at[at + q]), right_at[hits])


def band_keys(fp, table: int, pair: tuple[int, int]):
    """Spark column: the key of a band table."""
    edges = [round(64 * i / BANDS) for i in range(BANDS + 1)]
    cut = lambda i: F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    return F.lit(table << 44).cast("long") + F.shiftleft(cut(pair[0]), 16) + cut(pair[1])


def met(rows: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by a shuffle of both sides, so that none of the many joins of a run is gathered and sent out by the driver."""
    return rows.join(other.hint("merge"), on, how)


def links(keyed: DataFrame, radius: int, n_rows: int) -> DataFrame:
    """keyed: (node, fp as an array of longs, key). Edges (a, b) of nodes; their components are those
    of all pairs that share a key and lie within the radius. n_rows: of keyed, for sizing."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = met(keyed, sizes, "key")
    # A group of more than PART fingerprints is cut by hash; each part meets itself and all others.
    n_parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("node"), n_parts).cast("int")
    rows = rows.select("node", "fp", "key", own.alias("own"), n_parts.alias("n_parts"))
    rows = rows.select("node", "fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other"))
    rows = rows.select("node", "fp", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    buckets = max(1, n_rows // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.when(F.col("lo") + F.col("hi") > 0, F.xxhash64("key", "lo", "hi")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lo", "hi"], kind="stable")
        every, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        fp = np.stack(pdf["fp"].to_list()).astype(np.int64).view(np.uint64)
        key = pdf[["key", "lo", "hi"]].to_numpy()
        own, lo, hi = (pdf[c].to_numpy() for c in ("own", "lo", "hi"))
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[change[1:], len(pdf)]
        group = np.repeat(np.arange(len(change)), ends - change)
        small = np.repeat(ends - change <= SMALL, ends - change) & (lo == hi)
        forest = Forest(len(every))
        link_small(fp[small], group[small], radius, forest, at[small])
        for a, b in zip(change.tolist(), ends.tolist(), strict=True):
            if not small[a]:
                left = own[a:b] == lo[a]
                right = own[a:b] == hi[a]
                link_block(fp[a:b][left], fp[a:b][right], radius, forest, at[a:b][left], at[a:b][right])
        root = np.array([forest.root(i) for i in range(len(every))], np.int64)
        other = root != np.arange(len(every))
        return pd.DataFrame({"a": every[other], "b": every[root[other]]})

    return rows.groupBy("bucket").applyInPandas(compare, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all pairs within the radius."""
    if not 0 <= radius <= BANDS - 2:
        raise ValueError(f"the band tables find all pairs up to {BANDS - 2} differing bits")
    pairs = list(combinations(range(BANDS), 2))
    keyed = fps.select(F.col("fp").alias("node"), F.array("fp").alias("fp"), F.explode(F.array(*(band_keys(F.col("fp"), i, p) for i, p in enumerate(pairs)))).alias("key"))
    return links(keyed, radius, fps.count() * len(pairs))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component by value) of every node of an edge.

    Alternating star contraction: every node takes the smallest label in its neighbourhood and
    hands it on, until nothing changes; rounds grow with the logarithm of a component's
    diameter. Only a minimum per node is aggregated, so hubs combine on the map side, and each
    round is written to the shared folder, so a lost executor costs no earlier round.
    """
    spark = edges.sparkSession
    links = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node link to its smallest neighbour.
        large = met(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: of what a node links to below it, all link to the smallest.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = met(down, least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, shared_dir(spark))
        if after.count() == links.count() and after.exceptAll(links).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select("v", "v").distinct())
        links = after


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    fps = written(fingerprints(docs, k, doc_id, text))
    of_fp = written(lowest_linked(fps, "doc_id", radius))
    return fps.join(of_fp, "fp").select("doc_id", "fp", F.col("lowest").alias("component_id"))


def lowest_linked(fps: DataFrame, name: str, radius: int = RADIUS) -> DataFrame:
    """fps: (fp, name). fp, lowest: the smallest name among the rows of the fingerprint and of those that it is linked to."""
    distinct = written(fps.groupBy("fp").agg(F.min(name).alias("low")))
    roots = components(fingerprint_links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    classes = met(distinct, roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    smallest = classes.groupBy("root").agg(F.min("low").alias("lowest"))
    return met(classes, smallest, "root").select("fp", "lowest")


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return distinct(shingle_hashes(text, k))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """MinHash bands: TABLES hashes, of which sets of Jaccard similarity J share each with chance J ** ROWS."""
    least = np.full(len(_TURNS), ~np.uint64(0))
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _TURNS).min(axis=0), out=least)
    rows, key = least.reshape(TABLES, ROWS), np.arange(TABLES, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def link_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, forest: Forest, at: np.ndarray) -> None:
    """Joins each pair (left, right) whose sets are as similar as that; pairs that hang together already are left out.

    left and right: places in sets; at: each place's node in the forest.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = np.split(ids, ends[:-1])
    inside = np.zeros(len(every), bool)
    right = right[sizes[right] > 0]
    for i in left.tolist():
        n = sizes[i]
        some = right[(right > i) | ~np.isin(right, left)]
        some = some[(np.minimum(sizes[some], n) >= similarity * np.maximum(sizes[some], n) - 1e-9)]
        root = forest.root(int(at[i]))
        some = some[[forest.root(int(at[j])) != root for j in some.tolist()]] if len(some) else some
        if not len(some):
            continue
        inside[ids[i]] = True
        for first in range(0, len(some), 512):
            part = some[first : first + 512]
            starts = np.cumsum(sizes[part]) - sizes[part]
            common = np.add.reduceat(inside[np.concatenate([ids[j] for j in part.tolist()])], starts, dtype=np.int64)
            near = part[common >= similarity * (n + sizes[part] - common) - 1e-9]
            if len(near):
                forest.join(int(at[i]), at[near])
        inside[ids[i]] = False


def verified(members: DataFrame, similarity: float) -> DataFrame:
    """members: (node, root, n, shingles) of candidate components. Edges (a, b) whose components are
    those of all pairs of one root with a Jaccard similarity of the sets as high as that."""
    sizes = members.groupBy("root").agg(F.sum("n").alias("size"))
    rows = members.join(sizes, "root")
    # A component of more than SET_PART shingles is cut by hash; each part meets itself and all others.
    n_parts = F.ceil(F.col("size") / SET_PART).cast("int")
    own = F.pmod(F.xxhash64("node"), n_parts).cast("int")
    rows = rows.select("node", "root", "shingles", own.alias("own"), n_parts.alias("n_parts"))
    rows = rows.select("node", "root", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other"))
    rows = rows.select("node", "root", "shingles", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    buckets = max(1, int(members.agg(F.sum("n")).first()[0] or 0) // SET_PART)
    rows = rows.withColumn("bucket", F.when(F.col("lo") + F.col("hi") > 0, F.xxhash64("root", "lo", "hi")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets))))

    def compare(key, t):
        t = t.sort_by([("root", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("node", "ascending")])
        node, root, own, lo, hi = (t[c].to_numpy() for c in ("node", "root", "own", "lo", "hi"))
        change = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        every, at = np.unique(node, return_inverse=True)
        forest = Forest(len(every))
        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(node)], strict=True):
            sets = [np.frombuffer(x, "<u8") for x in t["shingles"][a:b].to_pylist()]
            link_sets(sets, np.flatnonzero(own[a:b] == lo[a]), np.flatnonzero(own[a:b] == hi[a]), similarity, forest, at[a:b])
        up = np.array([forest.root(i) for i in range(len(every))], np.int64)
        other = up != np.arange(len(every))
        return pa.table({"a": every[other], "b": every[up[other]]})

    return rows.groupBy("bucket").applyInArrow(compare, "a long, b long")


def text_hash(text: str):
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, root of every row (root: its group's number): groups of documents whose k-word shingle sets are as similar as that.

    Fingerprints and sketches only tell which documents to compare; each link is verified by the sets themselves.
    """
    picked = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("text_hash"))

    def sketches(batches):
        for batch in slices(batches):
            nodes, keys, fps = [], [], []
            for x in utf8(column(batch, "text")):
                hashes = shingle_hashes(x, k)
                shingles = distinct(hashes)
                fps.append(fingerprint(hashes))
                nodes.append(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes()))
                keys.append(sketch(shingles))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_hash"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "fp", "keys"])
        release()

    def sets(batches):
        for batch in slices(batches):
            found = [shingle_set(x, k) for x in utf8(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "root"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["node", "root", "n", "shingles"])
        release()

    # Sketches and sets go at once; only the groups stay for what comes after.
    path = shared_dir(docs.sparkSession)
    with passing(docs.sparkSession):
        fps = written(picked.mapInArrow(sketches, "doc_id long, text_hash long, node long, fp long, keys array<long>"))
        nodes = written(fps.groupBy("node").agg(F.first("keys").alias("keys")))
        prints = written(fps.select("fp", "node").distinct())
        linked = met(prints, lowest_linked(prints, "node"), "fp").select(F.col("node").alias("a"), F.col("lowest").alias("b"))
        keyed = nodes.select("node", F.explode("keys").alias("key"))
        # A key's documents hang on its smallest one: only their component matters, as that is compared in full.
        lows = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("key", "b")
        maybe = written(components(keyed.join(lows, "key").select(F.col("node").alias("a"), "b").union(linked)).select("node", "root"))
        # Sets are made again for one row of each candidate, which takes less room than to keep all.
        chosen = fps.select("node", "doc_id", "text_hash").join(maybe, "node").groupBy("node", "root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
        chosen = written(chosen.select("node", "root", F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash")))
        texts = picked.join(chosen, (picked["text_hash"] == chosen["__hash"]) & picked["doc_id"].eqNullSafe(chosen["__id"])).select("node", "root", "text")
        members = texts.mapInArrow(sets, "node long, root long, n long, shingles binary").groupBy("node", "root").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
        roots = components(verified(written(members), similarity))
        groups = fps.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
        return written(groups, path)


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all its columns.

    Of several rows with that doc_id in the group one stays, an arbitrary one of equal texts; rows of
    other groups are not touched by it. Rows with a null doc_id have nothing to be known by and stay.
    """
    found = similar_groups(docs, k, similarity, doc_id, text).where("doc_id IS NOT NULL")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select(F.col("row.doc_id").alias("__kept"), F.col("row.text_hash").alias("__hash"))
    # The rows as one column, so that no name of theirs can clash.
    known = docs.where(F.col(doc_id).isNotNull()).select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), text_hash(text).alias("hash"))
    stay = known.join(kept, (known["id"] == kept["__kept"]) & (known["hash"] == kept["__hash"]), "left_semi")
    return stay.dropDuplicates(["id", "hash"]).select("row.*").unionByName(docs.where(F.col(doc_id).isNull()))
