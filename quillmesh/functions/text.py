"""Text functions, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
SPACES = r"(?U)\s+"
#: A heading of level one, hashtags, links to pages, addresses, and what opens a page's header.
HEADING = r"(?dm)^#\s+(.+)$"
HASHTAG = r"(?:^|\s)#([a-zA-Z][a-zA-Z0-9_-]*)"
WIKILINK = r"\[\[([^\]]+)\]\]"
ADDRESS = r"https?://[^\s\)>\]]+"
HEADER = r"(?s)\A\s*---\n(.+?)\n---\n?(.*)"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def reconcile_key(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, none at the ends; may be empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def slugify(text: Column) -> Column:
    key = reconcile_key(text)
    return F.when(key == "", F.lit("untitled")).otherwise(key)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """Last part of the path without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


#: A fence line, the lines up to the next one, and that one; possessive, so that long texts need no stack.
FENCED = r"(?Udm)^[^\S\n]*+```[^\n]*+\n(?:(?![^\S\n]*+```)[^\n]*+\n)*+(?:[^\S\n]*+```[^\n]*+\n)?+"


def strip_code_fences(body: Column) -> Column:
    """Drops fence lines and what stands between them; every line that stays ends in a newline."""
    return F.regexp_replace(F.concat(body, F.lit("\n")), FENCED, "")


def strip_code(body: Column) -> Column:
    """Also drops spans between paired backticks; what follows an unpaired one stays."""
    parts = F.split(strip_code_fences(body), "`", -1)
    last = F.size(parts) - 1
    kept = F.filter(parts, lambda _, i: (i % 2 == 0) | ((i == last) & (last % 2 == 1)))
    return F.array_join(kept, "")


def extract_title(body: Column, base: Column) -> Column:
    """First heading of level one outside fences, else the file's name."""
    heading = F.regexp_extract(strip_code_fences(body), HEADING, 1)
    named = trimmed(F.regexp_replace(base, "[-_]", " "))
    return F.when(heading == "", named).otherwise(trimmed(heading))


def extract_hashtags(body: Column) -> Column:
    found = F.regexp_extract_all(strip_code_fences(body), F.lit(HASHTAG), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def extract_wikilinks(body: Column) -> Column:
    """Distinct slugs of [[links]] outside code, as edges of type related-to and strength 0.5."""
    found = F.regexp_extract_all(strip_code(body), F.lit(WIKILINK), F.lit(1))
    slugs = F.array_distinct(F.transform(found, slugify))
    return F.transform(slugs, lambda s: F.struct(s.alias("target"), F.lit("related-to").alias("type"), F.lit(0.5).alias("strength")))


def extract_urls(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(ADDRESS), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:!?"))))


def directory_tags(path: Column, root: str) -> Column:
    """Lower-case names of the folders between root and the file."""
    prefix = root.rstrip("/") + "/"
    inner = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    parts = F.split(inner, "/")
    return F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower), lambda p: (p != "") & (p != "."))


def strip_related(body: Column) -> Column:
    """Without the generated section of links and all that follows it."""
    return trimmed(F.regexp_replace(body, r"(?m)^## Related\s*\n[\s\S]*$", ""))


def body_preview(body: Column, n: int) -> Column:
    """First n words; the text itself if it has no more."""
    return F.when(F.size(words(body)) <= n, body).otherwise(F.array_join(F.slice(words(body), 1, n), " "))


def first_bytes(text: Column, n: int) -> Column:
    """What the first n bytes of the UTF-8 text decode to."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(first_bytes(text, n), F.lit("...")))


def one_line(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[\r\n]+", " "))


def strip_fence(text: Column) -> Column:
    """The inside of a text that is fenced as a whole."""
    clean = trimmed(text)
    return F.when(clean.startswith("```"), trimmed(F.regexp_replace(F.regexp_replace(clean, r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))).otherwise(clean)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * 13 / 10).cast("long")


def embedding_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), body)


def has_frontmatter(text: Column) -> Column:
    return text.rlike(HEADER)


def is_entity_type(kind: Column) -> Column:
    from quillmesh.schema import ENTITY_TYPES

    return F.lower(kind).isin(ENTITY_TYPES)


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def raw_of_error(error: Column) -> Column:
    """What an error message quotes after 'raw: '."""
    return F.regexp_extract(error, r"(?s)raw: (.*)$", 1)
