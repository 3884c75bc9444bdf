"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, tell which words stand in an n-gram that
the same text holds twice or more; the share of characters inside such n-grams and inside
repeated lines decides. Symbols are counted and do not decide. Each text is judged alone, so the
operator needs no shuffle.

Null and empty texts have no words and fail the base rule; very long ones are measured whole, in
memory of some times their size. A null doc_id is passed through.
Rows are judged one by one: repeated rows give repeated results. Extra columns are kept by
`quality_filter` and never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.anchors import Rolling
from quillmesh.llm.common import bounded_batches, column, mix64, release, slices, utf8

#: n-gram length -> largest share of characters inside n-grams of that length found twice or more.
LIMITS = {5: 0.25, 8: 0.20, 10: 0.15}
MAX_DUP_LINE_CHARS = 0.30
MIN_WORDS = 10
#: Of the rolling hashes; odd.
BASE = 0xA24BAED4963EE407
MAX_REPEAT_WORDS_PCT = 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("dup_line_chars", T.LongType()), *((f"dup_chars_{k}", T.LongType()) for k in LIMITS), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
]


def covered(roll: Rolling, n: int, k: int) -> np.ndarray:
    """Which of n words stand in a window of k words that occurs twice or more."""
    out = np.zeros(n, bool)
    if n <= k:
        return out
    hashes = roll.every(k)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return out
    twice = np.zeros(n + 1, np.int32)
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + k, -1)
    return np.cumsum(twice[:n]) > 0


def measure(text: bytes) -> tuple:
    """STATS of one text."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    n = len(words)
    starts_char = (raw & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(starts_char & ~_SPACE[raw]))
    n_symbols = int(np.count_nonzero(_SYMBOL[raw]))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = mix64(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.uint64, n))
    chars = None
    inside, repeat, roll = [], 0, Rolling(ids, BASE)
    for k in LIMITS:
        mask = covered(roll, n, k)
        if k == 5:
            repeat = int(np.count_nonzero(mask))
        if mask.any():
            if chars is None:
                chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
            inside.append(int(chars[mask].sum()))
        else:
            inside.append(0)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_WORDS_PCT * n
    kept = not failed and dup_line_chars <= MAX_DUP_LINE_CHARS * word_chars and all(x <= share * word_chars for x, share in zip(inside, LIMITS.values(), strict=True))
    return n, word_chars, n_symbols, n_dup_lines, repeat, dup_line_chars, *inside, failed, kept


def repetition_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and STATS of every row."""
    picked = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([picked.schema["doc_id"], *(T.StructField(a, b) for a, b in STATS)])

    def run(batches):
        for batch in slices(batches):
            rows = [measure(x) for x in utf8(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(list(x)) for x in zip(*rows, strict=True))], names=schema.names)

    return picked.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def run(batches):
        for batch in slices(batches, text=text):
            yield batch.filter(pa.array([measure(x)[-1] for x in utf8(column(batch, text))], pa.bool_()))
        release()

    return bounded_batches(docs).mapInArrow(run, docs.schema)
