"""Model surface: embedders, rerankers, chat models and extraction, with deterministic stand-ins.

Models are reached over callables, so that a cluster brings its own client. Calls run inside
mapInPandas in batches; a row whose call fails keeps an error and the others go on. A task may
run twice, so a call must not do harm when repeated; outputs are keyed by content hash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import prompts
from quillmesh.operators.enrich import SPO_STRENGTH, TRIPLE_STRENGTH, TYPE_PRIORITY, UNKNOWN_PRIORITY

BATCH = 100
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Chat = Callable[[str, str], str]


class ModelError(Exception):
    """kind: auth (401, 403), server (5xx) or request (all else)."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status
        self.kind = "auth" if status in (401, 403) else "server" if status >= 500 else "request"


class ParseError(ValueError):
    """A model answered, but not in the shape that was asked for; such rows go to the fallback queue."""


class HashEmbedder:
    """Signed feature hashing of words; deterministic, needs no model."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.model = dimensions, f"hash-{dimensions}"

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                d = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(d[:4], "little") % self.dimensions] += 1 if d[4] & 1 else -1
        return out.tolist()


def overlap_reranker(query: str, ids: Sequence[str], texts: Sequence[str], scores: Sequence[float]) -> list[tuple[int, float]]:
    """Share of the query's words in each text; ties keep their order."""
    wanted = set(query.lower().split())
    held = [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]
    return sorted(enumerate(held), key=lambda x: (-x[1], x[0]))


def top_n(ranked: Sequence[tuple[int, float]], n: int) -> list[tuple[int, float]]:
    """Ranked by score, then index; the first n, or all if n is not positive."""
    ranked = sorted(ranked, key=lambda x: (-x[1], x[0]))
    return ranked[:n] if n > 0 else ranked


def embedded(texts: DataFrame, embed: Embed, model: str) -> DataFrame:
    """texts: (id, content_hash, text). id, content_hash, model, dims, embedding, error."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                try:
                    found = embed(part["text"].tolist())
                    if len(found) != len(part):
                        raise ModelError(f"{len(found)} vectors for {len(part)} texts")
                    vectors, error = [list(map(float, v)) for v in found], ""
                except Exception as e:  # one failed batch must not lose the others
                    vectors, error = [None] * len(part), f"{getattr(e, 'kind', 'request')}: {e}"
                yield pd.DataFrame({"id": part["id"], "content_hash": part["content_hash"], "model": model, "dims": [len(v) if v else 0 for v in vectors], "embedding": vectors, "error": error})

    return texts.select("id", "content_hash", "text").mapInPandas(run, "id string, content_hash string, model string, dims int, embedding array<float>, error string")


def repaired(text: str) -> str:
    """JSON of a small model, mended where it breaks in a known way; JSON that is whole comes back as it is.

    One scan outside strings keeps a stack of open brackets: a closing bracket takes the kind of
    the one that it closes; a brace that is left open at the end alone is closed; `}, {` at the
    top, between two halves of one answer, joins them. Keys without a closing quote or a colon
    are recognised by name.
    """
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    # A list key without its quote or colon; a field key without its closing quote.
    text = re.sub(r'"(entities|relationships)"?\s*\[', r'"\1": [', text)
    text = re.sub(r'([{,]\s*)"(name|type|subject|predicate|object):"', r'\1"\2":"', text)
    out, stack, at = [], [], 0
    string = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
    while at < len(text):
        c = text[at]
        if c == '"':
            m = string.match(text, at)
            out.append(m[0])
            at = m.end()
            continue
        if c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            c = "}" if stack.pop() == "{" else "]"
            join = re.match(r"\s*,\s*\{", text[at + 1 :]) if c == "}" and not stack else None
            if join and re.search('"(?:entities|relationships)"', text[at + 1 :]):
                stack.append("{")
                out.append(",")
                at += 1 + join.end()
                continue
        out.append(c)
        at += 1
    return "".join(out) + ("}" if stack == ["{"] else "")


def unfenced(text: str) -> str:
    m = re.fullmatch(r"\s*```[^\n]*\n(.*?)\n?```\s*", text, re.S)
    return (m[1] if m else text).strip()


def scalar(value) -> str:
    """A string, or the first string of a list that is not blank."""
    if isinstance(value, str):
        return value
    return next((x for x in value if isinstance(x, str) and x.strip()), "") if isinstance(value, list) else ""


def most_frequent(roles: Sequence[str]) -> str:
    counts = Counter(r for r in roles if r)
    return min(counts, key=lambda r: (-counts[r], TYPE_PRIORITY.get(r, UNKNOWN_PRIORITY), r), default="").lower()


def parse_object(text: str) -> dict:
    """The JSON object of an answer, mended if it must be; ParseError with the answer's start."""
    try:
        raw = json.loads(repaired(unfenced(text)))
        if not isinstance(raw, dict):
            raise ValueError("not an object")
    except ValueError as e:
        raise ParseError(f"{e}\nraw: {text[:500]}") from e
    return raw


def parse_generic(text: str) -> dict:
    """An answer that already has the result's own fields."""
    raw = parse_object(text)
    strings = lambda rows: [str(x) for x in rows or [] if isinstance(x, str)]
    objects = lambda rows: [x for x in rows or [] if isinstance(x, dict)]
    entities = [{"name": scalar(e.get("name")).strip(), "role": scalar(e.get("role") or e.get("type")).strip(), "aliases": strings(e.get("aliases"))} for e in objects(raw.get("entities"))]
    edges = [{"target": scalar(r.get("target")).strip(), "type": scalar(r.get("type")).strip(), "strength": float(r.get("strength") or 0)} for r in objects(raw.get("relationships"))]
    return {"entity_type": scalar(raw.get("entity_type")).strip().lower(), "summary": scalar(raw.get("summary")).strip(), "entities": entities, "relationships": edges, "semantic_hints": strings(raw.get("semantic_hints")), "possible_questions": strings(raw.get("possible_questions"))}


def parse_triples(text: str) -> dict:
    """An answer with `entities_and_triples`: "[n], TYPE:name" items, and "(n, predicate, m)" items between them."""
    items = [x for x in parse_object(text).get("entities_and_triples") or [] if isinstance(x, str)]
    names, entities, edges = {}, [], []
    for m in filter(None, (re.match(r"\[(.*?)\], ([^:]*):(.*)$", x, re.S) for x in items)):
        names[m[1]] = m[3].strip()
        entities.append({"name": m[3].strip(), "role": m[2].strip()})
    for x in items:
        parts = [p.strip() for p in x.removeprefix("(").removesuffix(")").split(", ")] if x.startswith("(") else []
        if len(parts) == 3 and parts[0] in names and parts[2] in names:
            edges.append({"target": names[parts[2]], "type": parts[1], "strength": TRIPLE_STRENGTH})
    counts = Counter(e["role"] for e in entities)
    kind = min(counts, key=lambda r: (-counts[r], r), default="")
    return {"entity_type": kind.lower(), "summary": "", "entities": entities, "relationships": edges}


def parse_extraction(text: str) -> dict:
    """entity_type, summary, entities (name, role) and relationships (target, type, strength) of a model's answer with subject, predicate and object; either list may be missing."""
    raw = parse_object(text)
    entities = [{"name": str(e.get("name") or "").strip(), "role": scalar(e.get("type")).strip()} for e in raw.get("entities") or [] if isinstance(e, dict)]
    entities = [e for e in entities if e["name"]]
    known = {e["name"].lower(): e["name"] for e in entities}
    edges = []
    for r in raw.get("relationships") or []:
        target, kind = (scalar(r.get(k)).strip() for k in ("object", "predicate")) if isinstance(r, dict) else ("", "")
        if target and kind:
            edges.append({"target": known.get(target.lower(), target), "type": kind, "strength": SPO_STRENGTH})
    kind = scalar(raw.get("entity_type")).strip().lower() or most_frequent([e["role"] for e in entities])
    first = lambda rows, key: list({key(r): r for r in reversed(rows)}.values())[::-1]
    return {"entity_type": kind, "summary": scalar(raw.get("summary")).strip(), "entities": first(entities, lambda e: (e["name"].lower(), e["role"].lower())), "relationships": first(edges, lambda r: (r["target"].lower(), r["type"].lower()))}


EXTRACTION = "entity_type string, summary string, entities array<struct<name:string,role:string,aliases:array<string>>>, relationships array<struct<target:string,type:string,strength:double>>, semantic_hints array<string>, possible_questions array<string>"


#: Parsers of the shapes of an answer.
PARSERS: dict[str, Callable[[str], dict]] = {"spo": parse_extraction, "generic": parse_generic, "triples": parse_triples}
_NOTHING = {"entity_type": "", "summary": "", "entities": [], "relationships": [], "semantic_hints": [], "possible_questions": []}


def is_two_part_model(name: str) -> bool:
    """Whether a model of this name is asked for entities and relationships in its own form."""
    return name.lower().rsplit("/", 1)[-1].startswith(TEMPLATE_MODELS)


#: Fixed value: how the names of models begin that fill templates.
TEMPLATE_MODELS = "nuextract-2.0-"


def shape_for(model: str = "", endpoint: str = "", wanted: str = "", triples_endpoint: str = "") -> str:
    """The shape to ask for: the one that is wanted, else by the model's name, else by the endpoint, else generic."""
    if wanted:
        if wanted not in PARSERS:
            raise ValueError(f"no shape {wanted!r}, only {', '.join(PARSERS)}")
        return wanted
    if is_two_part_model(model):
        return "spo"
    return "triples" if triples_endpoint and endpoint == triples_endpoint else "generic"


def in_flight(docs: DataFrame, workers: int) -> tuple[DataFrame, int]:
    """docs in so few partitions, and the calls of each at a time, that the whole job has at most `workers` calls in flight. Not positive: a call a task."""
    if workers <= 0:
        return docs, 1
    tasks = min(workers, docs.sparkSession.sparkContext.defaultParallelism)
    return docs.repartition(tasks), workers // tasks


def called(call: Callable, items: Sequence, workers: int) -> list:
    """call(item) of all items in their order, `workers` at a time."""
    if workers <= 1:
        return [call(x) for x in items]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(call, items))


def extracted(docs: DataFrame, chat: Chat, prompt: str = "", shape: str = "spo", message: Callable[[str], str] = str, workers: int = 0) -> DataFrame:
    """docs: (id, body). id, status (ok, parse-error, model-error), error, and the fields of EXTRACTION.

    shape: which of PARSERS reads the answer; message: what is sent for a body. With workers, that many calls of the whole job
    are in flight at a time.
    """
    parse = PARSERS[shape]
    docs, at_once = in_flight(docs.select("id", "body"), workers)

    def one(row):
        try:
            found = _NOTHING | {k: v for k, v in parse(chat(prompt, message(row[1]))).items() if k in _NOTHING}
            found["entities"] = [{"aliases": [], **e} for e in found["entities"]]
            return {"id": row[0], "status": "ok", "error": "", **found}
        except Exception as e:  # one failed row must not lose the others
            return {"id": row[0], "status": "parse-error" if isinstance(e, ParseError) else "model-error", "error": str(e), **_NOTHING}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(called(one, list(zip(pdf["id"], pdf["body"], strict=True)), at_once))

    return docs.mapInPandas(run, f"id string, status string, error string, {EXTRACTION}")


def summarised(pages: DataFrame, chat: Chat, workers: int = 0) -> DataFrame:
    """pages: (id, title, entity_type, tags, body). id, summary, error; white space and quotation marks around an answer are dropped."""
    from quillmesh.functions.text import body_preview

    docs, at_once = in_flight(pages.select("id", "title", "entity_type", "tags", body_preview(F.col("body"), prompts.SUMMARY_WORDS).alias("preview")), workers)

    def one(row):
        try:
            told = chat(prompts.SUMMARY_PROMPT, prompts.summary(row.title, row.entity_type, list(row.tags), row.preview))
            return {"id": row.id, "summary": told.strip().strip("\"'"), "error": ""}
        except Exception as e:
            return {"id": row.id, "summary": "", "error": str(e)}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(called(one, list(pdf.itertuples(index=False)), at_once), columns=["id", "summary", "error"])

    return docs.mapInPandas(run, "id string, summary string, error string")


def recovered(failed: DataFrame, chat: Chat, prompt: str = "", max_files: int = 0, workers: int = 0) -> DataFrame:
    """The fallback over a queue (ord, id, body): the first max_files rows (all if not positive), with recovered and token estimates."""
    from quillmesh.functions.text import approx_tokens

    queue = failed.orderBy("ord").limit(max_files) if max_files > 0 else failed
    n = approx_tokens(F.col("body")).alias("input_tokens")
    return extracted(queue, chat, prompt, workers=workers).join(queue.select("id", "ord", n), "id").withColumn("recovered", F.col("status") == "ok")
