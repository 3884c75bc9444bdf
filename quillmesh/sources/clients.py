"""HTTP clients of embedding, reranking and chat endpoints, with the standard library only.

They are plain callables in the shapes that `operators.models` and `operators.search` take, hold
nothing but settings, and so travel to Python workers. A call has no effect but its answer, so a
task may run twice.
"""

from __future__ import annotations

import ipaddress
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit, urlunsplit

from quillmesh.operators.models import BATCH, ModelError, top_n

#: Name suffixes of hosts in a private network.
PRIVATE_SUFFIXES = (".local", ".lan", ".home", ".internal")


def post(url: str, body: dict, key: str = "", timeout: float = 300.0) -> dict:
    """The JSON answer; ModelError by status, and for whatever is no JSON."""
    headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise ModelError(f"status {e.code}: {e.read().decode('utf-8', 'replace')}", e.code) from e
    except (OSError, ValueError) as e:
        raise ModelError(f"{url}: {e}") from e


@dataclass(frozen=True)
class Endpoint:
    """key goes before token."""

    endpoint: str
    model: str = ""
    key: str = ""
    token: str = ""
    timeout: float = 300.0

    def call(self, path: str, body: dict) -> dict:
        return post(self.endpoint.rstrip("/") + path, body, self.key or self.token, self.timeout)


@dataclass(frozen=True)
class EmbeddingClient(Endpoint):
    """Vectors of texts, `batch` texts a request, put in order by the answer's indexes."""

    dimensions: int = 0
    batch: int = BATCH

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            data = self.call("/v1/embeddings", {"input": part, "model": self.model}).get("data") or []
            by_index = {d["index"]: d["embedding"] for d in data}
            if len(data) != len(part) or set(by_index) != set(range(len(part))):
                raise ModelError(f"{len(part)} vectors were asked for, not those of {sorted(by_index)}")
            out += [by_index[i] for i in range(len(part))]
        return out


@dataclass(frozen=True)
class RerankClient(Endpoint):
    """(index, score) pairs, best first. Both wire formats answer with results of index and relevance_score."""

    limit: int = 0

    def __call__(self, query: str, ids: Sequence[str], texts: Sequence[str], scores: Sequence[float]) -> list[tuple[int, float]]:
        if not texts:
            return []
        n = self.limit if 0 < self.limit <= len(texts) else len(texts)
        found = self.call("/v1/rerank", {"query": query, "documents": list(texts), "model": self.model, "top_n": n}).get("results") or []
        return top_n([(i, s) for i, s in {r["index"]: float(r["relevance_score"]) for r in found}.items() if 0 <= i < len(texts)], n)


def request_body(core: dict, extra: dict | None = None) -> dict:
    """core with the extra keys that it lacks."""
    return (extra or {}) | core


@dataclass(frozen=True)
class ChatClient(Endpoint):
    """The first choice of a chat; an empty prompt sends no system message."""

    extra: dict = field(default_factory=dict)

    def __call__(self, prompt: str, text: str, extra: dict | None = None) -> str:
        messages = ([{"role": "system", "content": prompt}] if prompt else []) + [{"role": "user", "content": text}]
        answer = self.call("/v1/chat/completions", request_body({"model": self.model, "messages": messages}, self.extra | (extra or {})))
        if not answer.get("choices"):
            raise ModelError("the model returned no choices")
        return answer["choices"][0]["message"]["content"]


def rejects_schema(error: Exception) -> bool:
    """Whether an endpoint refused the wanted answer's schema, and not the request as such."""
    told = str(error).lower()
    return "status 400" in told and ("response_format" in told or "schema" in told)


#: What this process has learnt: whether an endpoint takes a schema.
_TAKES_SCHEMA: dict[str, bool] = {}


@dataclass(frozen=True)
class SchemaChat:
    """A chat that asks for an answer of a JSON schema, and without one once its endpoint has refused that."""

    client: ChatClient
    schema: dict
    name: str = "extraction"

    def __call__(self, prompt: str, text: str) -> str:
        where = normalised_endpoint(self.client.endpoint)
        if not _TAKES_SCHEMA.get(where, True):
            return self.client(prompt, text)
        form = {"type": "json_schema", "json_schema": {"name": self.name, "strict": True, "schema": self.schema}}
        try:
            answer = self.client(prompt, text, {"response_format": form})
        except ModelError as e:
            if not rejects_schema(e):
                raise
            _TAKES_SCHEMA[where] = False
            return self.client(prompt, text)
        _TAKES_SCHEMA[where] = True
        return answer


@dataclass(frozen=True)
class TwoCalls:
    """Entities and relationships asked for one after the other, put together as one answer."""

    chat: Callable[[str, str], str]
    entities: str = "entities"
    relationships: str = "relationships"

    def __call__(self, prompt: str, text: str) -> str:
        from quillmesh.operators.models import ParseError, parse_object

        out = {}
        for part, ask in (("entities", self.entities), ("relationships", self.relationships)):
            answer = self.chat(f"{prompt}\n{ask}".strip(), text)
            try:
                out[part] = parse_object(answer).get(part) or []
            except ParseError:
                return answer  # as it is, so that the row is told to be unreadable
        return json.dumps(out)


def host_of(endpoint: str) -> str:
    """The host of an address with or without a scheme; an IPv6 address without its brackets."""
    text = endpoint.strip()
    try:
        return urlsplit(text if "://" in text else f"//{text}").hostname or ""
    except ValueError:
        return text.lower()


def _address(host: str):
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        return None


def is_local(endpoint: str) -> bool:
    """An endpoint on this machine, or none at all."""
    if not endpoint.strip():
        return True
    host = host_of(endpoint)
    address = _address(host)
    return host in ("", "localhost") or bool(address and address.is_loopback)


def transport(endpoint: str) -> str:
    """manual for endpoints of this machine or a private network, native for all others."""
    host = host_of(endpoint)
    address = _address(host)
    inside = host in ("localhost", "0.0.0.0") or host.endswith(PRIVATE_SUFFIXES) or bool(address and (address.is_private or address.is_loopback or address.is_link_local))
    return "manual" if inside else "native"


def normalised_endpoint(endpoint: str) -> str:
    """Equal addresses as equal strings: scheme and host in lower case, no usual port, closing slash, query or fragment."""
    text = endpoint.strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return text.lower().rstrip("/")
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    return urlunsplit((parts.scheme, host + (f":{port}" if port and port != usual else ""), parts.path.rstrip("/"), "", ""))


def fallback_cap(endpoint: str, wanted: int | None = None, cloud: int = 50) -> int:
    """How many files a fallback takes: all (0) on a local endpoint, `cloud` on others, if nothing else is wanted."""
    return wanted if wanted is not None else 0 if is_local(endpoint) else cloud


def looks_like_path(text: str) -> bool:
    """A folder that is there, or anything with a separator."""
    return bool(text) and (os.path.isdir(text) or "/" in text or text.endswith(os.sep))
