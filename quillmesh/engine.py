"""One object with the tools of the engine: what a command line or a tool server would call.

Settings come from three layers, later ones over earlier ones where they are set: a global
file's values, a local one's, and the environment (QUILLMESH_<NAME>).
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import content_hash, embedding_text, strip_fence
from quillmesh.operators import enrich, models, prompts, search, traverse, validation
from quillmesh.operators.graph import KnowledgeGraph
from quillmesh.schema import ENTITY_TYPES
from quillmesh.sources import markdown, store
from quillmesh.sources.shared import written

PREFILTER = 20


@dataclass(frozen=True)
class Settings:
    root: str = ""
    depth: int = 2
    embedding_model: str = "hash-64"
    embedding_weight: float = search.EMBEDDING_WEIGHT
    rerank_top_n: int = 0
    parallel: bool = False
    parallel_workers: int = 0
    entity_types: tuple[str, ...] = field(default=())
    predicates: tuple[str, ...] = field(default=())
    chat_model: str = ""
    chat_endpoint: str = ""
    extraction_format: str = ""
    triples_endpoint: str = ""

    @classmethod
    def cascade(cls, *layers: dict, environment: dict | None = None) -> Settings:
        """Values of the layers in order, then the environment; a layer's explicit empty list clears an inherited one."""
        out, known = cls(), {f.name: f for f in fields(cls)}
        env = os.environ if environment is None else environment
        layers = (*layers, {n: env[f"QUILLMESH_{n.upper()}"] for n in known if env.get(f"QUILLMESH_{n.upper()}")})
        for layer in layers:
            for name, value in layer.items():
                if name not in known:
                    continue
                kind = type(getattr(cls(), name))
                if kind is tuple:
                    value = tuple(value.split(",") if isinstance(value, str) else value)
                elif kind is bool:
                    value = str(value).lower() in ("1", "true", "yes")
                else:
                    value = kind(value)
                    if value == kind():
                        continue
                out = replace(out, **{name: value})
        return out


    @classmethod
    def of_files(cls, *paths: str, environment: dict | None = None) -> Settings:
        """The cascade of YAML files, global before local; one that is not there is empty."""
        import yaml

        layers = []
        for path in paths:
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    held = yaml.safe_load(f) or {}
                if not isinstance(held, dict):
                    raise ValueError(f"{path} holds no settings")
                layers.append({str(k).replace("-", "_"): v for k, v in held.items() if v is not None})
        return cls.cascade(*layers, environment=environment)

    def save(self, path: str) -> None:
        """Those that differ from the defaults, as YAML."""
        import yaml

        mine = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v != getattr(Settings(), k)}
        markdown.write_file(path, yaml.safe_dump(mine, sort_keys=True))


class Engine:
    def __init__(self, spark: SparkSession, pages: DataFrame, warnings: DataFrame | None = None, settings: Settings | None = None, vectors: DataFrame | None = None, embed: models.Embed | None = None, reranker=None):
        self.spark, self.settings, self.vectors, self.embed, self.reranker = spark, settings or Settings(), vectors, embed or models.HashEmbedder(64), reranker
        self.warnings = warnings
        self.graph = KnowledgeGraph.build(pages, self.settings.root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, auto_enrich: bool = True, **options) -> Engine:
        pages, warnings = markdown.load(spark, root, auto_enrich=auto_enrich)
        return cls(spark, pages, warnings, replace(options.pop("settings", Settings()), root=root), **options)

    def reload(self) -> Engine:
        """A new engine over the folder as it is now; this one stays as it is."""
        return Engine.open(self.spark, self.settings.root, settings=self.settings, vectors=self.vectors, embed=self.embed, reranker=self.reranker)

    @property
    def hashed(self) -> DataFrame:
        """Pages with the hash of the content that a vector would be made of."""
        return self.graph.pages.withColumn("content_hash", content_hash(F.col("title"), F.col("body")))

    def search(self, query: str, limit: int = 0, min_score: float = 0.0, semantic: bool = False, now: Column | None = None) -> DataFrame:
        now = F.current_timestamp() if now is None else now
        if not (semantic and self.vectors is not None):
            return search.search(self.graph.pages, query, now, limit, min_score, reranker=self.reranker)
        try:
            vector = list(self.embed([query])[0])
        except models.ModelError:  # without the model the words still count
            return search.search(self.graph.pages, query, now, limit, min_score, reranker=self.reranker)
        return search.search(self.hashed, query, now, limit, min_score, self.vectors, vector, self.settings.embedding_weight, self.reranker)

    def get_page(self, path_or_id: str) -> DataFrame:
        return self.graph.lookup(path_or_id)

    def traverse(self, root: str, depth: int | None = None, direction: str = "forward", types: list[str] | None = None, strategy: str = "bfs"):
        depth = self.settings.depth if depth is None else depth
        if strategy == "dfs":
            return traverse.depth_first(self.graph, root, depth, direction, types)
        return traverse.breadth_first(self.graph, root, depth, direction, types)

    def get_structure(self, **filters) -> tuple[DataFrame, DataFrame]:
        return self.graph.summary_stats(**filters), self.graph.summary_nodes(**filters)

    def check(self) -> DataFrame:
        """pages, errors, files and dangling edges; anything but zeros after the pages is a failure."""
        return validation.check_totals(self.graph.pages).crossJoin(self.graph.dangling.agg(F.count(F.lit(1)).alias("dangling")))

    def embed_pending(self) -> DataFrame:
        """Vectors for the pages that lack one of their present content."""
        held = self.vectors if self.vectors is not None else self.spark.createDataFrame([], store.VECTORS)
        texts = self.hashed.withColumn("text", embedding_text(F.col("title"), F.col("body")))
        return models.embedded(texts.join(store.pending(texts, held), ["id", "content_hash"], "left_semi"), self.embed, self.settings.embedding_model)

    def embed_all(self, kb: store.Store) -> DataFrame:
        """Embeds what is pending and saves it: id, content_hash, error of each page that was taken up.

        A first call tells whether the model answers, and its dimensions; vectors of another model
        are dropped. Pages whose call failed stay pending.
        """
        dims = len(self.embed(["probe"])[0])
        kb.ensure_model(self.settings.embedding_model, dims)
        texts = self.hashed.withColumn("text", embedding_text(F.col("title"), F.col("body")))
        todo = texts.join(store.pending(texts, kb.vectors(self.settings.embedding_model, dims)), ["id", "content_hash"], "left_semi")
        made = written(models.embedded(todo, self.embed, self.settings.embedding_model))
        kb.save_vectors(made.where("error = ''"))
        return made.select("id", "content_hash", "error")

    def embed_file(self, path_or_id: str) -> DataFrame:
        one = self.hashed.join(self.graph.lookup(path_or_id).select("id"), "id", "left_semi")
        return models.embedded(one.withColumn("text", embedding_text(F.col("title"), F.col("body"))), self.embed, self.settings.embedding_model)

    def embed_status(self) -> DataFrame:
        held = self.vectors if self.vectors is not None else self.spark.createDataFrame([], store.VECTORS)
        return store.embed_status(self.hashed, held)

    def enrich(self, force: bool = False, chat: models.Chat | None = None, fallback: models.Chat | None = None, max_files: int = 0) -> DataFrame:
        """Pages after extraction and, with a model, its merge; `status` is skipped, enriched, recovered or failed.

        The model is asked in the shape of its settings; where no summary comes of that, a call of its own asks for one. With `parallel`,
        parallel_workers calls (4 if not set) are in flight at a time.
        A page whose model call failed keeps what extraction found and an empty summary, so that the next run takes it up again.
        """
        own = self.settings
        workers = (own.parallel_workers or 4) if own.parallel else 0
        todo = enrich.needs_enrichment(tier2=chat is not None) | F.lit(force)
        pages = self.graph.pages.withColumn("status", F.when(todo, "enriched").otherwise("skipped"))
        merged = enrich.merge_frontmatter(enrich.tier1(pages.where("status = 'enriched'"), self.settings.root), force=force).drop("extracted")
        if chat is not None:
            shape = models.shape_for(own.chat_model, own.chat_endpoint, own.extraction_format, own.triples_endpoint)
            prompt, message = prompts.extraction(shape, own.entity_types or ENTITY_TYPES, own.predicates)
            found = written(models.extracted(merged.select("id", "body"), chat, prompt, shape, message, workers))  # a call is paid for once
            good = found.where("status = 'ok'").withColumn("outcome", F.lit("enriched"))
            if fallback is not None:
                queue = found.where("status = 'parse-error'").select("id").join(merged.select("id", "body"), "id").withColumn("ord", F.col("id"))
                good = good.unionByName(models.recovered(queue, fallback, max_files=max_files, workers=workers).where("recovered").withColumn("outcome", F.lit("recovered")).select(*good.columns))
            model = F.struct("entity_type", "summary", F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["aliases"].alias("aliases"), e["role"].alias("role"))).alias("entities"), "relationships", "semantic_hints", "possible_questions")
            both = merged.join(good.select("id", model.alias("model"), "outcome"), "id", "left")
            done = enrich.merge_model(both.where("model IS NOT NULL"), force=force).withColumn("status", F.col("outcome"))
            done = self._summarised(written(done.select(*merged.columns)), chat, force, workers)
            merged = done.unionByName(both.where("model IS NULL").withColumn("status", F.lit("failed")).select(*merged.columns))
        return merged.unionByName(pages.where("status = 'skipped'").select(*merged.columns))

    def _summarised(self, pages: DataFrame, chat: models.Chat, force: bool, workers: int) -> DataFrame:
        """pages with the summaries that they lack; one that fails stays empty, for the next run."""
        lacking = pages.where(F.lit(force) | (F.col("summary") == ""))
        told = written(models.summarised(lacking, chat, workers)).select("id", F.col("summary").alias("__new"))
        both = pages.join(told, "id", "left")
        return enrich.merge_summary(both, F.coalesce("__new", F.lit("")), force).select(*pages.columns)

    @staticmethod
    def enrich_totals(found: DataFrame) -> DataFrame:
        """One row: how many of enrich's pages are enriched, skipped, recovered and failed."""
        return found.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("enriched", "skipped", "recovered", "failed")))

    def enriched_files(self, found: DataFrame) -> DataFrame:
        """(path, text): the files of enrich's pages with their new frontmatter, for markdown.write_files.

        Failed pages are among them: what was extracted is kept, and their empty summary queues them for the next run.
        """
        files = markdown.scan(self.spark, self.settings.root).withColumnRenamed("path", "source_path")
        done = found.where("status <> 'skipped'").join(files, "source_path").withColumn("ord", F.lit(0))
        texts = markdown.replaced_in(done.select(*[f.name for f in markdown.PAGE], "ord", "text"), "source_path")
        return texts.select(F.col("source_path").alias("path"), "text")

    def reason(self, question: str, chat: models.Chat, max_pages: int = PREFILTER, now: Column | None = None) -> DataFrame:
        """Pages that a chat model picks out of a summary of the graph around the best matches, with `place`.

        The summary is the whole neighbourhood of the best max_pages pages, as the prompt needs it. Where nothing matches the
        question the model sees the first max_pages pages, and not the whole graph.
        """
        pages = self.graph.pages
        if pages.limit(max_pages + 1).count() > max_pages:
            seeds = self.search(question, limit=max_pages, now=now).select("id")
            around = written(traverse.grown(self.graph, seeds))
            nodes = self.graph.summary_nodes(max_pages=max_pages) if around.isEmpty() else self.graph.summary_nodes(page_ids=around)
        else:
            nodes = self.graph.summary_nodes()
        told = "\n".join(r["j"] for r in nodes.select(F.to_json(F.struct("*")).alias("j")).collect())
        answer = chat('Which pages answer the question? Reply with JSON: {"pages": [ids]}.', f"{question}\n\n{told}")
        clean = self.spark.range(1).select(strip_fence(F.lit(answer)).alias("a")).first()["a"]
        try:
            picked = [str(x) for x in json.loads(models.repaired(clean))["pages"]]
        except (ValueError, KeyError, TypeError):
            picked = []
        chosen = self.spark.createDataFrame(list(enumerate(picked)), "place int, id string")
        return pages.join(F.broadcast(chosen.groupBy("id").agg(F.min("place").alias("place"))), "id").orderBy("place")

    def export(self, body: bool = False) -> DataFrame:
        return self.graph.export(body)

    def export_to(self, stream, body: bool = False) -> int:
        """Writes export's objects to a text stream, a line each, and returns how many; the driver holds one partition at a time."""
        n = 0
        for n, row in enumerate(self.export(body).toLocalIterator(), 1):
            stream.write(row["json"] + "\n")
        return n


def ignore_store(root: str, entry: str = f"{markdown.PRUNED}/") -> None:
    """Adds the store's folder to the ignore file of a knowledge base under version control, once."""
    path, held = os.path.join(root, ".gitignore"), ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            held = f.read()
    if entry not in map(str.strip, held.split("\n")):
        markdown.write_file(path, held + ("" if held.endswith("\n") or not held else "\n") + f"{entry}\n")


def scaffold(root: str) -> None:
    """A small knowledge base to start from."""
    os.makedirs(root, exist_ok=True)
    ignore_store(root)
    pages = {
        "welcome": {"id": "welcome", "title": "Welcome", "entity_type": "document", "confidence": 1.0, "relationships": [{"target": "first-topic", "type": "introduces", "strength": 0.8}]},
        "first-topic": {"id": "first-topic", "title": "First topic", "entity_type": "concept", "confidence": 0.8, "tags": ["sample"]},
    }
    empty = markdown.parse("", strict=False)
    for name, page in pages.items():
        markdown.write_file(os.path.join(root, f"{name}.md"), markdown.render(empty | page | {"body": f"About {page['title'].lower()}."}))
