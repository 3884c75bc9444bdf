"""Markdown files with YAML frontmatter: scan, parse, render, write.

YAML needs a Python parser (PyYAML, over libyaml where it is there), so parsing runs in mapInPandas,
behind all filters on the path. All scalars are read as text, so dates and numbers in text fields stay as they are written.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.schema import FRONTMATTER, PAGE

#: Fixed value: where the frontmatter ends and the body begins.
SPLIT = re.compile(r"\A\s*---\n(.+?)\n---\n?(.*)", re.S)
#: Folders that no scan enters.
PRUNED = ".knowledge"
#: Text keys of the file format for the fields of FRONTMATTER, where they differ.
KEYS = {f.name: f.name.replace("_", "-") for f in FRONTMATTER}

#: The same loader over libyaml, where PyYAML was built with it.
_FAST = getattr(yaml, "CBaseLoader", None)

if _FAST is not None:

    class _Nodes(_FAST):
        """Nodes without tags, as all scalars are text."""

        def resolve(self, kind, value, implicit):
            return ""

        def descend_resolver(self, current_node, current_index):
            pass

        def ascend_resolver(self):
            pass


def _built(node, made: dict):
    """What a node holds; made: what its anchors' nodes hold already."""
    if isinstance(node, yaml.ScalarNode):
        return node.value
    if id(node) not in made:
        made[id(node)] = None
        if isinstance(node, yaml.SequenceNode):
            made[id(node)] = [_built(x, made) for x in node.value]
        else:
            made[id(node)] = {_built(k, made): _built(v, made) for k, v in node.value}
    elif made[id(node)] is None:
        raise yaml.YAMLError("a node holds itself")
    return made[id(node)]


def load_yaml(text: str):
    if _FAST is not None:
        try:
            loader = _Nodes(text)
            node = loader.get_single_node()
            return None if node is None else _built(node, {})
        except (yaml.YAMLError, TypeError):
            pass  # whether and why it can't be read is for the plain parser to say
    try:
        return yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ValueError(f"cannot read the frontmatter: {e}") from e


def _text(value) -> str:
    if isinstance(value, (list, dict)):
        raise ValueError(f"text expected, got {value!r}")
    return "" if value is None else str(value)


def _number(value) -> float:
    return float(value) if value not in (None, "") else 0.0


def _typing(kind):
    """A function that brings a YAML value to the form of a Spark type; a value of another shape is an error."""
    if isinstance(kind, T.ArrayType):
        item = _typing(kind.elementType)

        def items(value):
            if value in (None, ""):
                return []
            if not isinstance(value, list):
                raise ValueError(f"a list expected, got {value!r}")
            return [item(v) for v in value]

        return items
    if isinstance(kind, T.StructType):
        fields = [(f.name, f.name.replace("_", "-"), _typing(f.dataType)) for f in kind]

        def mapped(value):
            if value in (None, ""):
                value = {}
            if not isinstance(value, dict):
                raise ValueError(f"a map expected, got {value!r}")
            return {name: typed(value.get(key, value.get(name))) for name, key, typed in fields}

        return mapped
    return _number if isinstance(kind, T.DoubleType) else _text


#: The fields of a page out of its frontmatter.
_fields = _typing(FRONTMATTER)


def parse(text: str, strict: bool = True) -> dict:
    """A page as a dict of PAGE's columns.

    Strict: no frontmatter is an error, the body is trimmed and loses a heading that repeats the
    title. Permissive: a text without frontmatter is all body, and bodies stay as they are.
    """
    m = SPLIT.match(text)
    if m is None:
        if strict:
            raise ValueError("no valid frontmatter found")
        return _fields({}) | {"body": text, "source_path": ""}
    page = _fields(load_yaml(m[1]) or {})
    body = m[2]
    if strict:
        body = body.strip()
        heading = f"# {page['title']}"
        if page["title"] and (body == heading or body.startswith(heading + "\n")):
            body = body[len(heading) :].strip()
    return page | {"body": body, "source_path": ""}


_SAFE = re.compile(r"[A-Za-z][\w ./()-]*")
_RESERVED = {"yes", "no", "true", "false", "null", "on", "off", "y", "n"}


def _plain(value: str) -> str:
    safe = _SAFE.fullmatch(value) and value.strip() == value and value.lower() not in _RESERVED
    return value if safe else json.dumps(value, ensure_ascii=False)


def number(x: float) -> str:
    return f"{x:g}"


def _emitting(kind: T.StructType, indent: int):
    """A function that gives the lines of a struct; fields that are empty stand as "", 0 or []."""
    pad = " " * indent
    fields = []
    for f in kind:
        below = None
        if isinstance(f.dataType, T.StructType):
            below = _emitting(f.dataType, indent + 4)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            below = _emitting(f.dataType.elementType, indent + 6)
        fields.append((f.name, f"{pad}{f.name.replace('_', '-')}:", type(f.dataType), below))

    def emit(value) -> list[str]:
        out = []
        for name, key, shape, below in fields:
            v = value[name]
            if shape is T.StringType:
                out.append(f"{key} {_plain(v)}")
            elif shape is T.DoubleType:
                out.append(f"{key} {number(v)}")
            elif shape is T.StructType:
                out += [key, *below(v)]
            elif not len(v):
                if name != "semantic_relationships":
                    out.append(f"{key} []")
            elif below is None:
                out += [key, *(f"{pad}    - {_plain(x)}" for x in v)]
            else:
                out.append(key)
                for x in v:
                    lines = below(x)
                    out += [f"{pad}    - {lines[0].lstrip()}", *lines[1:]]
        return out

    return emit


_lines = _emitting(FRONTMATTER, 0)


def frontmatter(page: dict) -> str:
    return "\n".join(_lines(page)) + "\n"


def render(page: dict) -> str:
    """The file of a page: frontmatter, heading, body, and a list of links made from its edges."""
    body = page["body"]
    if "## Related" in body:
        body = re.sub(r"^## Related\s*\n[\s\S]*$", "", body, flags=re.M)
    body = body.strip()
    out = f"---\n{frontmatter(page)}---\n\n"
    if page["title"]:
        out += f"# {page['title']}\n\n"
    if body:
        out += body + "\n"
    if len(page["relationships"]):
        links = "".join(f"- [[{r['target']}]] (type: {r['type']}, strength: {number(r['strength'])})\n" for r in page["relationships"])
        out += ("\n" if body else "") + "## Related\n\n" + links
    return out


def prepended(page: dict, body: str) -> str:
    return f"---\n{frontmatter(page)}---\n{body}"


def replaced(page: dict, text: str) -> str:
    """text with its frontmatter, and any further blocks stacked on it, replaced; doing it twice changes nothing."""
    m = SPLIT.match(text)
    while m:
        text = m[2]
        m = SPLIT.match(text.lstrip(" \t\n\r"))
    return prepended(page, text)


def write_file(path: str, text: str) -> None:
    """Whole or not at all, also where two attempts of a task write it."""
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(made, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(made, path)


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of all files below root by name pattern; hidden folders are passed by, as Spark does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.where(~F.col("path").contains(f"/{PRUNED}/")).select(F.regexp_replace("path", "^file:", "").alias("path"), F.decode("content", "UTF-8").alias("text"))


def parsed(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, text) as PAGE's columns with `error`, empty for those that can be read."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    rows.append(parse(text, strict) | {"source_path": path, "error": ""})
                except Exception as e:  # the row stays, with what is wrong with it
                    rows.append(_fields({}) | {"body": "", "source_path": path, "error": str(e)})
            yield pd.DataFrame(rows)

    return files.select("path", "text").mapInPandas(run, T.StructType([*PAGE, T.StructField("error", T.StringType())]))


def load(spark: SparkSession, root: str, pattern: str = "*.md", ignore_errors: bool = True, auto_enrich: bool = False) -> tuple[DataFrame, DataFrame]:
    """pages and warnings (path, message) of a folder.

    auto_enrich: files that can't be read strictly are read permissively and get what can be
    extracted from them; nothing is written back, that is a sink's work.
    """
    files = scan(spark, root, pattern)
    if not ignore_errors and not auto_enrich and (first := parsed(files).where("error <> ''").select("source_path", "error").first()):
        raise ValueError(f"{first['source_path']}: {first['error']}")
    return read_pages(files, root, auto_enrich)


def read_pages(files: DataFrame, root: str, auto_enrich: bool = False) -> tuple[DataFrame, DataFrame]:
    """pages and warnings (path, message) of (path, text)."""
    from quillmesh.operators.enrich import merge_frontmatter, tier1

    strict = parsed(files)
    bad = strict.where("error <> ''")
    pages = strict.where("error = ''").drop("error")
    warnings = bad.select(F.col("source_path").alias("path"), F.col("error").alias("message"))
    if auto_enrich:
        again = parsed(files.join(warnings.select("path"), "path", "left_semi"), strict=False)
        filled = merge_frontmatter(tier1(again.where("error = ''").drop("error"), root)).drop("extracted")
        pages = pages.unionByName(filled)
    return pages, warnings


def rendered(pages: DataFrame) -> DataFrame:
    """(path, text): the file of every page."""
    names = [f.name for f in PAGE]

    def run(batches):
        for pdf in batches:
            rows = [row.asDict(recursive=True) if hasattr(row, "asDict") else row for row in pdf.to_dict("records")]
            yield pd.DataFrame({"path": [r["source_path"] for r in rows], "text": [render(r) for r in rows]})

    return pages.select(*names).mapInPandas(run, "path string, text string")


def replaced_in(pages: DataFrame, key: str = "ord") -> DataFrame:
    """pages: PAGE's columns, key and the file's text. (key, text): the file with its frontmatter replaced by the page's."""

    def run(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame({key: [r[key] for r in rows], "text": [replaced(r, r["text"]) for r in rows]})

    return pages.mapInPandas(run, T.StructType([pages.schema[key], T.StructField("text", T.StringType())]))


def dry_run(pages: DataFrame) -> DataFrame:
    """(path, text): what would stand in each page's frontmatter, under its path; nothing is written."""
    names = [f.name for f in PAGE]

    def run(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame({"path": [r["source_path"] for r in rows], "text": [f"--- {r['source_path']} ---\n{frontmatter(r)}\n" for r in rows]})

    return pages.select(*names).mapInPandas(run, "path string, text string")


def read_file(path: str, strict: bool = True) -> dict:
    """One file as a page's fields."""
    with open(path, encoding="utf-8", newline="") as f:
        return read(f, strict) | {"source_path": path}


def read(stream, strict: bool = True) -> dict:
    """What a text stream holds, as a page's fields."""
    return parse(stream.read(), strict) | {"source_path": ""}


def enriched_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of the files that only read permissively, with the frontmatter that can be extracted: the write-back of `load`'s auto_enrich, for write_files."""
    from quillmesh.operators.enrich import merge_frontmatter, tier1

    files = scan(spark, root, pattern)
    bad = parsed(files).where("error <> ''").select(F.col("source_path").alias("path"))
    again = parsed(files.join(bad, "path", "left_semi"), strict=False).where("error = ''").drop("error")
    filled = merge_frontmatter(tier1(again, root)).drop("extracted")
    held = filled.join(files.withColumnRenamed("path", "source_path"), "source_path")
    return replaced_in(held.select(*[f.name for f in PAGE], "text"), "source_path").select(F.col("source_path").alias("path"), "text")


def write_files(files: DataFrame, root: str) -> None:
    """Writes (path, text) below a root that all executors share; each file is replaced as a whole, so a task may run twice."""

    def run(rows):
        for r in rows:
            path = os.path.join(root, r["path"].lstrip("/"))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            write_file(path, r["text"])

    files.select("path", "text").foreachPartition(run)
