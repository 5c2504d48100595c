"""All asked questions answered from a graph: three vector indices, trails from each question's seeds, chunks under a budget.

Every step works on all questions at once and keeps them apart by ``query_id``; what
one question holds is bounded by its parameters, so lists are collected only of that.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.functions import text as T
from brookwell.operators import context, embedding, graph, models, packing
from brookwell.operators.kept import kept

MODES = ("local", "global", "hybrid", "mix")
#: A question shorter than this stands for its own keywords if the model names none.
SHORT = 50


@dataclass(frozen=True)
class Parameters:
    """What a question may ask for; the defaults are the survey's."""

    mode: str = "mix"
    top_k: int = 40
    chunk_top_k: int | None = 20
    hops: int = 2
    neighbours: int = 30
    entity_tokens: int = 6000
    relation_tokens: int = 8000
    total_tokens: int = 30_000
    related_chunks: int = 5
    threshold: float = 0.2
    response_type: str = "Multiple Paragraphs"
    user_prompt: str = ""

    @property
    def chunk_budget(self) -> int:
        return max(self.total_tokens - self.entity_tokens - self.relation_tokens, 2000)


class Index:
    """Tables that are written when they are first asked for, so that a mode makes those that it reads.

    entities: name, type, description, sources, v, n. relations: src, tgt (src < tgt),
    weight, keywords, description, sources, v, n. chunks: chunk_id, content, file_path,
    tokens, v, n. Sources are arrays of chunk ids. edges and texts are relations and
    chunks without vectors. Where ``sources`` is given, relations have none, and it gives
    (src, tgt, sources) of the pairs (src, tgt) that were found.
    """

    def __init__(self, entities: Callable[[], DataFrame], relations: Callable[[], DataFrame], chunks: DataFrame, edges: Callable[[], DataFrame] | None = None, sources: Callable[[DataFrame], DataFrame] | None = None):
        self._entities, self._relations, self._edges, self.texts, self.sources = entities, relations, edges or relations, chunks, sources

    @cached_property
    def entities(self) -> DataFrame:
        said = F.concat_ws("\n", "name", "description")
        return kept(embedding.embedded_texts(self._entities(), said), "entity-index")

    @cached_property
    def relations(self) -> DataFrame:
        told = F.concat(F.col("keywords"), F.lit("\t"), F.col("src"), F.lit("\n"), F.col("tgt"), F.lit("\n"), F.col("description"))
        return kept(embedding.embedded_texts(self._relations(), told), "relation-index")

    @cached_property
    def edges(self) -> DataFrame:
        return self.relations if "relations" in self.__dict__ else self._edges()

    @cached_property
    def chunks(self) -> DataFrame:
        return kept(embedding.embedded_texts(self.texts, F.col("content")), "chunk-index")


def built(entities: DataFrame | Callable[[], DataFrame], relations: DataFrame | Callable[[], DataFrame], chunks: DataFrame, edges: Callable[[], DataFrame] | None = None, sources: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The three indices, each row embedded once: an entity by name and description, a relation by keywords, ends and description, a chunk by its content. ``edges`` may give src, tgt and weight of the relations at less cost, and ``sources`` those of the pairs that are asked for."""
    later = lambda x: x if callable(x) else lambda: x
    return Index(later(entities), later(relations), chunks, edges, sources)


def judged(questions: DataFrame) -> DataFrame:
    """Questions (query_id, text, low, high) with ``failed`` and the keywords that will be used: a short question without keywords asks by its own words, an empty one and a long one fail."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    nothing = (F.size("low") == 0) & (F.size("high") == 0)
    own = nothing & ~empty & (F.length("text") < SHORT)
    return questions.select("query_id", "text", F.when(own, F.array("text")).otherwise(F.col("low")).alias("low"), "high", (empty | (nothing & ~own)).alias("failed"))


def _asked(questions: DataFrame, words: Column) -> DataFrame:
    """Query vectors of the questions that have something to ask with."""
    said = questions.select("query_id", words.alias("said")).where("said <> ''")
    return kept(embedding.embedded_texts(said, F.col("said")).drop("said"), "asked")


def _sources(found: DataFrame, part: int) -> DataFrame:
    return found.select("query_id", F.lit(part).alias("part"), "rank", F.posexplode("sources").alias("pos", "chunk_id"))


class Retrieved:
    """What questions find, as tables that are written when they are first asked for.

    verdicts: query_id, text, low, high, failed. entities: query_id, rank, name, type,
    description, kind (seed or neighbour), hops, score. relations: query_id, rank, src,
    tgt, weight, keywords, description. chunks: query_id, rank, chunk_id, content,
    file_path, origin (graph or vector).
    """

    def __init__(self, questions: DataFrame, index: Index, p: Parameters):
        self._index, self._p, self._like = index, p, questions
        self.verdicts = kept(judged(questions), "verdicts")
        self._open = self.verdicts.where("NOT failed")

    @cached_property
    def _relations(self) -> DataFrame | None:
        if self._p.mode not in ("global", "hybrid", "mix"):
            return None
        keyed = self._index.relations.withColumn("pair", T.pair_key(F.col("src"), F.col("tgt")))
        return kept(embedding.nearest(keyed, _asked(self._open, F.array_join("high", ", ")), self._p.top_k, "pair", self._p.threshold), "found-relations")

    @cached_property
    def _sourced(self) -> DataFrame | None:
        """The relations with their sources."""
        if self._relations is None or self._index.sources is None:
            return self._relations
        return self._relations.join(self._index.sources(self._relations.select("src", "tgt").distinct()), ["src", "tgt"])

    @cached_property
    def _entities(self) -> DataFrame | None:
        p, index = self._p, self._index
        if p.mode not in ("local", "hybrid", "mix"):
            return None
        seeds = embedding.nearest(index.entities, _asked(self._open, F.array_join("low", ", ")), p.top_k, "name", p.threshold)
        seeds = kept(seeds.select("query_id", "rank", "name", "type", "description", "sources", F.lit("seed").alias("kind"), F.lit(0).cast("long").alias("hops"), F.col("similarity").alias("score")), "seeds")
        if p.hops == 0:
            return seeds
        around = graph.expand_sets(seeds.select("query_id", F.col("name").alias("entity_id")), index.edges, p.hops, p.neighbours)
        around = around.join(index.entities.select(F.col("name").alias("entity_id"), "type", "description", "sources"), "entity_id", "left")
        unknown = F.array().cast(seeds.schema["sources"].dataType)
        around = kept(around.select("query_id", (F.col("rank") + p.top_k).alias("rank"), F.col("entity_id").alias("name"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("sources", unknown).alias("sources"), F.lit("neighbour").alias("kind"), "hops", "score"), "neighbours")
        return seeds.union(around)

    @cached_property
    def entities(self) -> DataFrame:
        schema = "query_id long, rank long, name string, type string, description string, kind string, hops long, score double"
        return self._entities.drop("sources") if self._entities is not None else df_of(self._like, schema)

    @cached_property
    def relations(self) -> DataFrame:
        schema = "query_id long, rank long, src string, tgt string, weight double, keywords string, description string"
        return self._relations.select("query_id", "rank", "src", "tgt", "weight", "keywords", "description") if self._relations is not None else df_of(self._like, schema)

    @cached_property
    def chunks(self) -> DataFrame:
        p = self._p
        found = [self._sourced, self._entities]  # the relations' index has the edges, too
        listed = [_sources(rows, part) for rows, part in zip(found, (1, 0), strict=True) if rows is not None]
        seen = listed[0] if len(listed) == 1 else listed[0].union(listed[1])
        first = seen.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "rank", "pos")).alias("first"))
        order = Window.partitionBy("query_id").orderBy("first")
        some = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * p.related_chunks).drop("first")
        texts = some.join(self._index.texts, "chunk_id").where("content <> ''")
        chunks = packing.token_prefix(texts, ["query_id"], ["rank"], F.col("tokens"), p.chunk_budget).withColumn("origin", F.lit("graph"))
        columns = ["query_id", "rank", "chunk_id", "content", "file_path", "origin"]
        chunks = chunks.select(*columns)
        if p.mode == "mix":
            near = embedding.nearest(self._index.chunks, _asked(self._open, F.col("text")), p.chunk_top_k or p.top_k, "chunk_id", p.threshold).where("content <> ''")
            chunks = chunks.union(near.withColumn("rank", F.col("rank") + 2 * p.related_chunks).withColumn("origin", F.lit("vector")).select(*columns))
        return kept(packing.first_seen(chunks.withColumn("__digest", F.md5("content")), ["query_id"], "__digest", ["rank"]).drop("__digest"), "found-chunks")


def retrieved(questions: DataFrame, index: Index, p: Parameters = Parameters()) -> Retrieved:
    """What each question (query_id, text, low, high) finds by ``p.mode``.

    Low keywords find entities, whose neighbours by trails follow; high keywords
    find relations; with ``mix`` the question's text finds chunks as well. The chunks
    of entities, neighbours and relations follow in that order, each once, twice
    ``related_chunks`` at most and within the budget, then the vector's chunks whose
    content is not there yet.
    """
    return Retrieved(questions, index, p)


def df_of(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def contexts(found: Retrieved, p: Parameters) -> DataFrame:
    """(query_id, text, low, high, failed, context, paths): the context is null where nothing was found; paths are the distinct files of its chunks in order."""

    def gathered(rows: DataFrame, into: str, **fields: str | Column) -> DataFrame:
        row = F.struct("rank", *(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in fields.items()))
        drop_rank = lambda x: F.struct(*(x[k].alias(k) for k in fields))
        return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(row)), drop_rank).alias(into))

    relations = gathered(found.relations, "relations", src="src", tgt="tgt", weight=F.col("weight").cast("decimal(18,2)"))
    entities = gathered(found.entities, "entities", name="name", type="type", description="description")
    chunks = gathered(found.chunks, "chunks", content="content", file_path="file_path")
    met = found.verdicts.join(entities, "query_id", "left").join(relations, "query_id", "left").join(chunks, "query_id", "left")
    full = {c: F.coalesce(F.col(c), F.array().cast(met.schema[c].dataType)) for c in ("entities", "relations", "chunks")}
    # Without entities, relations and vector chunks there is no context, whatever the graph's chunks
    any_ = (F.size(full["entities"]) > 0) | (F.size(full["relations"]) > 0) | (F.size(full["chunks"]) > 0)
    said = context.graph_context(full["entities"], full["relations"], full["chunks"], p.entity_tokens, p.relation_tokens)
    return met.select("query_id", "text", "low", "high", "failed", F.when(~F.col("failed") & any_, said).alias("context"), context.references(full["chunks"]).alias("paths"))


def args_key(p: Parameters) -> Column:
    """The cache key of a question: its parameters, text and keywords."""
    parts = [F.lit(p.mode), F.col("text"), F.lit(p.response_type), F.lit(p.top_k), F.lit(p.entity_tokens), F.lit(p.relation_tokens), F.lit(p.total_tokens), F.array_join("high", ", "), F.array_join("low", ", "), F.lit(p.user_prompt)]
    return F.concat(F.lit("query:"), T.args_hash(*parts))


def answers(made: DataFrame, cache: DataFrame, p: Parameters = Parameters(), model: models.Model = models.first_words) -> tuple[DataFrame, DataFrame]:
    """((query_id, answer, cached, paths) of ``contexts``, new rows of the cache (key, content)).

    A failed question has the refusal, one without context the fixed sentence; equal
    questions reach the model once, and none that the cache has. The new rows are written.
    """
    rows = made.withColumn("key", F.when(F.col("context").isNotNull(), args_key(p)))
    extra = p.user_prompt or "n/a"
    asked = rows.where("key IS NOT NULL").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    prompts = asked.select("key", context.prompt(F.col("context"), F.col("text"), p.response_type, extra).alias("prompt"))
    new = kept(prompts.select("key", T.without_thoughts(models.answered(F.col("prompt"), model)).alias("content")), "answers")
    known = cache.select("key", "content", F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    out = rows.join(known, "key", "left")
    said = F.when(F.col("failed"), context.NO_ANSWER).when(F.col("context").isNull(), context.NOTHING_FOUND).otherwise(F.coalesce("content", F.lit("")))
    return out.select("query_id", said.alias("answer"), F.coalesce("cached", F.lit(False)).alias("cached"), F.when(F.col("key").isNotNull(), F.col("paths")).otherwise(F.array().cast("array<string>")).alias("paths")), new


def with_mode(p: Parameters, mode: str) -> Parameters:
    return replace(p, mode=mode)
