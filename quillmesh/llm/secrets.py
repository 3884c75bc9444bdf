"""Secret scans with an incremental blob ledger.

Every version's content is addressed by SHA-256. The ledger is a Parquet table of
(blob, rules, findings, scan), one row for each scanned pair of blob and rule version, with or
without findings. A scan reads the ledger, keeps the pairs that it lacks, scans each such blob
once however many versions or paths hold it, appends, and joins the findings back to all paths.
`scan` is the label of the scan that found them. Two scans at a time may both add a pair; one row
of each is read.

Before the text is shuffled each task drops the blobs it has already sent on, so a blob that a
third of all rows hold gives one row a task.

Of what the patterns beyond the base match, a token must look random (entropy of its characters),
a JSON web token's head must decode, and a Base64 key must not be hexadecimal or a word.

Null contents are the empty blob. Null paths are kept. Repeated rows give repeated rows. Very long
texts are scanned whole. An empty table adds nothing to the ledger. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_batches, column, slices

#: name, pattern, group that holds the secret, least characters of it; the first three are the base.
RULES = [
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{22,}", 0, 33),
    ("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}", 0, 26),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0),
    ("google", r"\bAIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("npm", r"\bnpm_[A-Za-z0-9]{36}", 0, 40),
    ("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:([^\s/:@]{3,256})@", 1, 3),
    ("upper_hex", r"\b[0-9A-F]{32,}\b", 0, 32),
]
BASE = ("assign", "access", "hex")
#: Changes with the rules, so that a changed rule set scans all blobs again.
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
#: A cheap test that every match of a rule passes.
_HEX_RUN = re.compile(r"[0-9a-f]{32}")
_NEEDS = {"access": "AKIA", "pem": "-----BEGIN", "github": "gh", "slack": "xox", "jwt": "eyJ", "google": "AIza", "github_pat": "github_pat_", "gitlab": "glpat-", "stripe": "k_", "npm": "npm_", "url_login": "://"}
#: Bits for each character that a random-looking token has at least.
LEAST_ENTROPY = 3.0
_RANDOM = {"github", "github_pat", "gitlab", "slack", "google", "stripe", "npm"}
_COMPILED = [(name, re.compile(p), group, least) for name, p, group, least in RULES]
LEDGER = "blob string, rules string, scan string, n_assign long, n_access long, n_hex long, base string, spans string"


def entropy(token: str) -> float:
    """Bits for each character, by the token's own frequencies."""
    n = len(token)
    return -sum(c / n * log2(c / n) for c in Counter(token).values())


def holds(name: str, token: str) -> bool:
    """Whether a match of a rule beyond the base stands up to a closer look."""
    if name == "jwt":
        head = token.split(".")[0]
        try:
            return b'"alg"' in base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
        except (binascii.Error, ValueError):
            return False
    return name not in _RANDOM or entropy(token) >= LEAST_ENTROPY


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans and all spans (kind, start, end), each ordered by start, then kind as listed."""
    out = []
    for rank, (name, pattern, group, least) in enumerate(_COMPILED):
        if name in _NEEDS and _NEEDS[name] not in text or name == "hex" and not _HEX_RUN.search(text):
            continue
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least and (name in BASE or holds(name, m[group]))]
    out = [(RULES[rank][0], start, end) for start, rank, end in sorted(out)]
    return [x for x in out if x[0] in BASE], out


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _first_of_each(batches):
    """Drops the blobs that this task has had."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for blob in column(batch, "blob").to_pylist():
            keep.append(blob not in seen)
            seen.add(blob)
        yield batch.filter(pa.array(keep, pa.bool_()))


def scan(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", label: str = "") -> DataFrame:
    """Brings the ledger (a folder that all executors share) up to date with the versions.

    Returns path, blob and the ledger's columns for every row of versions.
    """
    spark: SparkSession = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = bounded_batches(versions).select(F.sha2(body, 256).alias("blob"), body.alias("text"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    once = blobs.mapInArrow(_first_of_each, blobs.schema).repartition("blob")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == VERSION).select("blob")
        once = once.join(known, "blob", "left_anti")

    def run(batches):
        for batch in slices(_first_of_each(batches)):
            rows = []
            for blob, text in zip(column(batch, "blob").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                base, spans = find(text)
                count = lambda k: sum(x[0] == k for x in base)  # noqa: B023, E731
                rows.append((blob, VERSION, label, count("assign"), count("access"), count("hex"), _told(base), _told(spans)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    schema = pa.schema([("blob", pa.string()), ("rules", pa.string()), ("scan", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.string()), ("spans", pa.string())])
    once.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == VERSION).drop("rules").groupBy("blob").agg(*(F.min(c).alias(c) for c in ("scan", *(f"n_{k}" for k in BASE), "base", "spans")))
    paths = versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"))
    return paths.join(found, "blob")
