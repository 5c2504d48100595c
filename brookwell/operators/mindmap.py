"""Mind maps from retrieved contexts: a root topic and a tree of topics, each by a call of a model that answers in JSON."""

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwell.functions import text as T
from brookwell.operators import models, tree
from brookwell.operators.kept import kept

#: Characters of the context that each call sees, topics below the root, below another and in all depths.
ROOT_CHARS, TREE_CHARS = 6000, 32_000
MOST_THEMES, MOST_CHILDREN, MOST_DEPTH = 8, 7, 5
#: Why a map is refused.
NO_CONTENT = "No content retrieved for this file. Ensure the file is fully processed."
TOO_SHALLOW = "Document too short for a useful mindmap — fewer than 2 top-level topics found."
#: Characters of a topic and of a description.
TOPIC, DESCRIPTION = (2, 120), (20, 400)

STRING = r'"((?:[^"\\]|\\.)*)"'
NAME = f'    "name": {STRING}'
ENTITY = f'    "name": {STRING},\n    "type": {STRING},\n    "description": {STRING}\n'
RELATION = f'    "src": {STRING},\n    "tgt": {STRING},\n    "weight": '
CHUNK = f'    "content": {STRING},\n    "file_path": '
FILE, SHOWN = "FILENAME: ", "DOCUMENT CONTEXT:\n"
WORDS = r"[^ \t\n\v\f\r]+"
SAYS = "As the context says: "


def root_prompt(context: Column, file: Column) -> Column:
    return F.concat(F.lit(f"Name the core topic in 2 to 5 words, then describe it.\n\n{FILE}"), F.coalesce(file, F.lit("unknown")), F.lit(f"\n\n{SHOWN}"), F.substring(context, 1, ROOT_CHARS))


def tree_prompt(context: Column) -> Column:
    rules = f"Build a hierarchical mindmap: 2 to {MOST_THEMES} themes, 2 to {MOST_CHILDREN} topics below a topic that has any, at most {MOST_DEPTH} levels."
    return F.concat(F.lit(f"{rules}\n\n{SHOWN}"), F.substring(context, 1, TREE_CHARS))


def _found(pattern: str, text: str) -> list[tuple[str, ...]]:
    rows = re.findall(pattern, text)
    return [tuple(json.loads(f'"{x}"', strict=False) for x in (r if isinstance(r, tuple) else (r,))) for r in rows]


def _node(topic: str, said: str, children: list[dict]) -> dict:
    return {"topic": topic[: TOPIC[1]], "description": (SAYS + said)[: DESCRIPTION[1]], "children": children}


def named(prompts: list[str]) -> list[str]:
    """The offline model of the root: the first three names that the context has."""
    out = []
    for p in prompts:
        head, _, context = p.partition(f"\n\n{SHOWN}")
        names = [x for (x,) in _found(NAME, context)[:3]]
        node = _node(" ".join(names), f"{', '.join(names)} in {head.partition(FILE)[2]}.", [])
        out.append(json.dumps({k: node[k] for k in ("topic", "description")}))
    return out


def outlined(prompts: list[str]) -> list[str]:
    """The offline model of the tree: kinds of at least two entities, their first entities, and what at least two relations of those lead to. An entity is described by the first chunk that names it, else by itself."""
    out = []
    for p in prompts:
        context = p.partition(SHOWN)[2]
        entities = [e for e in _found(ENTITY, context) if e[1] != "UNKNOWN"]
        relations, chunks = _found(RELATION, context), [x for (x,) in _found(CHUNK, context)]
        kinds = {k: [e for e in entities if e[1] == k] for k in dict.fromkeys(e[1] for e in entities)}
        themes = []
        for kind, rows in [(k, r) for k, r in kinds.items() if len(r) >= 2][:MOST_THEMES]:
            below = []
            for name, _, description in rows[:MOST_CHILDREN]:
                others = list(dict.fromkeys(b if a == name else a for a, b in relations if name in (a, b)))[:MOST_CHILDREN]
                leaves = [_node(x, f"{name} and {x} are related.", []) for x in others] if len(others) >= 2 else []
                said = next((" ".join(re.findall(WORDS, c)[:12]) for c in chunks if name in c), description.partition(T.SEP)[0])
                below.append(_node(name, said, leaves))
            themes.append(_node(kind, rows[0][2].partition(T.SEP)[0], below))
        out.append(json.dumps({"children": themes}))
    return out


def _schema(depth: int) -> str:
    children = f", children: array<{_schema(depth - 1)}>" if depth > 1 else ""
    return f"struct<topic: string, description: string{children}>"


def _fits(nodes: Column, depth: int) -> Column:
    """Whether all nodes have topics, descriptions and children of allowed lengths."""
    good = lambda x: F.coalesce(F.length(x["topic"]).between(*TOPIC) & F.length(x["description"]).between(*DESCRIPTION), F.lit(False))
    if depth > 1:
        return F.forall(nodes, lambda x: good(x) & (F.size(F.coalesce(x["children"], F.array())) <= MOST_CHILDREN) & F.coalesce(_fits(x["children"], depth - 1), F.lit(True)))
    return F.forall(nodes, good)


def maps(contexts: DataFrame, file: str, namer: models.Model = named, outliner: models.Model = outlined) -> DataFrame:
    """(query_id, node_id, topic, description, depth, has_children) of each of ``contexts`` (query_id, context, ``file``): ``n_root``, then the nodes in pre-order.

    Both models see the head of the whole context. What is refused has one row, whose
    node_id is ``refused`` and whose topic says why: no context, fewer than two themes,
    or an answer of another form.
    """
    said = contexts.select("query_id", models.answered(root_prompt(F.col("context"), F.col(file)), namer).alias("root"), models.answered(tree_prompt(F.col("context")), outliner).alias("tree"), F.col("context").isNull().alias("none"))
    read = kept(said.select("query_id", "none", F.from_json("root", _schema(1)).alias("root"), F.from_json("tree", f"struct<children: array<{_schema(MOST_DEPTH)}>>")["children"].alias("children")), "outlines")
    themes = F.size(F.coalesce("children", F.array()))
    wrong = ~(_fits(F.array("root"), 1) & F.coalesce(_fits(F.col("children"), MOST_DEPTH), F.lit(False)) & (themes <= MOST_THEMES))
    why = F.when(F.col("none"), NO_CONTENT).when(themes < 2, TOO_SHALLOW).when(wrong, "The outline has another form than was asked for.")
    read = kept(read.withColumn("why", why), "judged")
    none = F.lit(None).cast("string")
    whole = read.where("why IS NULL")
    refused = read.where("why IS NOT NULL").select("query_id", F.lit("refused").alias("node_id"), F.col("why").alias("topic"), none.alias("description"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("has_children"))
    roots = whole.select("query_id", F.lit("n_root"), F.trim("root.topic"), F.trim("root.description"), F.lit(0).cast("long"), F.lit(True))
    level, nodes = whole.select("query_id", F.lit("").alias("id"), "children"), None
    for left in range(MOST_DEPTH, 0, -1):
        level = level.select("query_id", F.col("id").alias("parent"), F.posexplode("children").alias("pos", "x"))
        level = level.select("query_id", F.concat("parent", F.lit("/"), "pos").alias("id"), "parent", "pos", "x.*")
        rows = level.select("query_id", "id", F.when(F.col("parent") != "", F.col("parent")).alias("parent"), "pos", F.trim("topic").alias("topic"), F.trim("description").alias("description"))
        nodes = rows if nodes is None else nodes.union(rows)
        if left > 1:
            level = level.select("query_id", "id", "children")
    numbered = tree.preorder(nodes, "query_id", "id", "parent", "pos")
    return refused.union(roots).union(numbered.select("query_id", "node_id", "topic", "description", "depth", "has_children"))
