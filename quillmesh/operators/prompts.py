"""What a model is asked for: extraction in three shapes, and a page's summary."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

#: Predicates that are offered where the settings name none.
PREDICATES = ("related-to", "derived-from", "implements", "depends-on", "created-by", "part-of", "used-by")
#: Words of a body that go into a summary's prompt.
SUMMARY_WORDS = 500

#: Fixed value: what models that are tuned for triples have been trained to see, to the letter.
TRIPLES = """Perform Named Entity Recognition (NER) and extract knowledge graph triplets from the text. NER identifies named entities of given entity types, and triple extraction identifies relationships between entities using specified predicates.

**Entity Types:**
{types}

**Predicates:**
{predicates}

**Text:**
{body}"""

GENERIC = """You turn a text into entries of a knowledge graph.

Answer with one JSON object and nothing else, neither a fence nor a comment. It has these keys:
- "entity_type": the kind of thing that the text is about, one of: {types}
- "entities": what the text names, as a list of {{"name", "role", "aliases"}}, where aliases is a list of strings
- "relationships": what the text's subject has to do with others, as a list of {{"target", "type", "strength"}}; target in lower case with hyphens, type one of: {predicates}; strength from 0.0 to 1.0
- "semantic_hints": two to five phrases that say what the text is about
- "possible_questions": two to five questions that the text answers"""

SUMMARY_PROMPT = "You write one plain sentence on what an entry of a knowledge graph stands for."
SUMMARY = """Say in one sentence what this page stands for: the thing itself, and not how the page is laid out.

Title: {title}
Entity type: {entity_type}
Tags: {tags}
Beginning of the body: {preview}

Give the sentence alone, without quotation marks."""


def template(types: Sequence[str], predicates: Sequence[str], parts: Sequence[str] = ("entities", "relationships")) -> str:
    """The template that models of the two-part kind fill, of both parts or of one."""
    whole = {"entities": [{"name": "verbatim-string", "type": list(types)}], "relationships": [{"subject": "verbatim-string", "predicate": list(predicates), "object": "verbatim-string"}]}
    return json.dumps({p: whole[p] for p in parts}, separators=(",", ":"), ensure_ascii=False)


def extraction(shape: str, types: Sequence[str], predicates: Sequence[str] = ()) -> tuple[str, Callable[[str], str]]:
    """The system prompt of a shape (spo, triples or generic; empty for none), and what makes a body the user's message."""
    predicates = predicates or PREDICATES
    if shape == "generic":
        return GENERIC.format(types=", ".join(types), predicates=", ".join(predicates)), str
    if shape == "triples":
        told = json.dumps({"entity_types": list(types)}, separators=(",", ":"), ensure_ascii=False), json.dumps({"predicates": list(predicates)}, separators=(",", ":"), ensure_ascii=False)
        return "", lambda body: TRIPLES.format(types=told[0], predicates=told[1], body=body)
    if shape == "spo":
        form = template(types, predicates)
        return "", lambda body: f"# Template:\n{form}\n# Context:\n{body}"
    raise ValueError(f"no shape {shape!r}")


def summary(title: str, entity_type: str, tags: Sequence[str], preview: str) -> str:
    return SUMMARY.format(title=title, entity_type=entity_type, tags=", ".join(tags) or "(none)", preview=preview)
