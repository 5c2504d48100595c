"""Context of an answer: found rows as indented JSON, chunks without repeats, numbered references."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookwell.functions.text import json_quoted

#: Fixed value: what is answered when nothing was found.
NOTHING_FOUND = "I don't have enough information in the knowledge base to answer this question."
#: Fixed value: what is answered to an empty question, or a long one without keywords.
NO_ANSWER = "Sorry, I'm not able to provide an answer to that question.[no-context]"


def indented(rows: Column, fields: dict[str, bool]) -> Column:
    """An array of structs as a JSON list, indented by two; ``fields`` in order, true for those that are numbers. Nulls stay."""

    def one(x: Column) -> Column:
        value = lambda f, number: F.coalesce(x[f].cast("string"), F.lit("null")) if number else json_quoted(x[f])
        lines = [F.concat(F.lit(f'    "{f}": '), value(f, number)) for f, number in fields.items()]
        return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))

    return F.when(F.size(rows) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(rows, one), ",\n"), F.lit("\n]"))).otherwise(F.lit("[]"))


def distinct_chunks(chunks: Column) -> Column:
    """Chunks (content, file_path) in order without blank and repeated contents; the path of a chunk without one is ``unknown``."""
    kept = F.filter(chunks, lambda x: F.coalesce(x["content"], F.lit("")) != "")
    contents = F.transform(kept, lambda x: x["content"])
    first = F.filter(kept, lambda x, i: F.array_position(contents, x["content"]) == i + 1)
    return F.transform(first, lambda x: F.struct(x["content"].alias("content"), F.coalesce(x["file_path"], F.lit("unknown")).alias("file_path")))


def references(chunks: Column) -> Column:
    """The distinct paths of chunks in order."""
    return F.array_distinct(F.filter(F.transform(chunks, lambda x: x["file_path"]), lambda x: F.coalesce(x, F.lit("")) != ""))


def numbered(paths: Column, otherwise: str = "N/A") -> Column:
    lines = F.array_join(F.transform(paths, lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x)), "\n")
    return F.when(F.size(paths) > 0, lines).otherwise(F.lit(otherwise))


def _part(title: str, body: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{title}:\n\n```{kind}\n"), body, F.lit("\n```\n"))


def graph_context(entities: Column, relations: Column, chunks: Column, entity_budget: int = 6000, relation_budget: int = 8000) -> Column:
    """Entities (name, type, description), relations (src, tgt, weight) and distinct chunks; a quarter of each budget is how many rows it admits."""
    entities, relations = F.slice(entities, 1, max(1, entity_budget // 4)), F.slice(relations, 1, max(1, relation_budget // 4))
    parts = [
        _part("Knowledge Graph Data (Entities)", indented(entities, {"name": False, "type": False, "description": False}), "json"),
        _part("Knowledge Graph Data (Relationships)", indented(relations, {"src": False, "tgt": False, "weight": True}), "json"),
        _part("Document Chunks", indented(chunks, {"content": False, "file_path": False}), "json"),
        _part("Reference Document List", numbered(references(chunks)), ""),
    ]
    return F.concat(F.lit("\n"), F.concat_ws("\n", *parts), F.lit("\n"))


def naive_context(chunks: Column) -> Column:
    parts = [_part("Document Chunks", indented(chunks, {"content": False, "file_path": False}), "json"), _part("Reference Document List", numbered(references(chunks)), "")]
    return F.concat(F.lit("\n"), F.concat_ws("\n", *parts), F.lit("\n"))


def prompt(context: Column, question: Column, response_type: str = "Multiple Paragraphs", extra: str = "n/a") -> Column:
    """What a model would be sent for a question."""
    system = F.concat(F.lit(f"Answer from the context only. Response style: {response_type}. Additional instructions: {extra}\n\n---Context---\n\n"), context)
    return F.concat_ws("\n\n", system, F.lit("---User Query---"), question)
