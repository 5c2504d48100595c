"""Chunking, nearest neighbours, token budgets and naive retrieval over the standard tables."""

from pyspark.sql import functions as F

from brookwell.functions.text import word_count
from brookwell.operators import chunking, packing, vectors
from brookwell.plans.base import CHUNKS, DOCS, VECTORS, asked, chunks, documents, query, table
from brookwell.plans.base import vectors as vector_table

#: Unit-free similarity of vectors to the asked one, as the operators round it.
SIM = "round((1 + list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))) / 2, 6)"
ASKED = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {})"
#: One question, where answering one is the feature, and the stated query set.
ONE, MANY = ASKED.format("vec_id = 7"), ASKED.format("vec_id % 50 = 0")


def scored(keep: str = "true") -> str:
    return f"s AS (SELECT q.query_id, v.vec_id, v.file_path, v.content, v.label, {SIM} AS similarity FROM vecs v, q WHERE {keep})"


def top(k: int, source: str = "s", name: str = "t") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM {source}) WHERE rank <= {k})"


@query("l01_token_chunk", f"WITH {CHUNKS} SELECT doc_id, chunk_order_index, tokens, chunk_id FROM chunks")
def l01(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_order_index", "tokens", "chunk_id")


@query(
    "l01_separator_chunk",
    rf"""WITH {DOCS}, p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
t AS (SELECT doc_id, pos, regexp_extract_all(p, '\S+') AS t FROM p),
w AS (SELECT doc_id, pos, 0 AS i, t AS c FROM t WHERE len(t) <= 40 UNION ALL SELECT doc_id, pos, i, t[i * 30 + 1:i * 30 + 40] FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / 30.0) AS BIGINT))) AS i FROM t WHERE len(t) > 40))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS BIGINT) AS chunk_order_index, CAST(len(c) AS BIGINT) AS tokens, 'chunk-' || md5(array_to_string(c, ' ')) AS chunk_id FROM w""",
)
def l01_separator(spark, d):
    return chunking.token_chunks(documents(spark, d), size=40, overlap=10, separator="\n").select("doc_id", "chunk_order_index", "tokens", "chunk_id")


@query("b18_min_tokens", f"WITH {CHUNKS} SELECT chunk_id, tokens FROM chunks WHERE tokens >= 30")
def b18(spark, d):
    return chunks(spark, d).where("tokens >= 30").select("chunk_id", "tokens")


@query("a36_chunk_dump", rf"WITH {CHUNKS} SELECT doc_id, chunk_order_index, CAST(len(regexp_extract_all(content, '\S+')) AS BIGINT) AS words, left(content, 120) AS preview FROM chunks")
def a36(spark, d):
    return chunks(spark, d).orderBy("doc_id", F.coalesce("chunk_order_index", F.lit(0))).select("doc_id", "chunk_order_index", word_count(F.col("content")).alias("words"), F.substring("content", 1, 120).alias("preview"))


@query("j01_similarity", f"WITH {VECTORS}, {MANY}, {scored()} SELECT query_id, vec_id, similarity FROM s")
def j01(spark, d):
    return vectors.scored(vector_table(spark, d), asked(spark, d), "vec_id")


@query("j02_cosine", "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def j02(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return vectors.pair_similarity(pairs, "embedding", "next").select("vec_id", "cosine")


@query("b16_threshold", f"WITH {VECTORS}, {MANY}, {scored()} SELECT query_id, vec_id, similarity FROM s WHERE similarity >= 0.55")
def b16(spark, d):
    return vectors.scored(vector_table(spark, d), asked(spark, d), "vec_id", least=0.55)


@query("b10_file_eq", f"WITH {VECTORS}, {MANY}, {scored('v.label = 3')}, {top(5)} SELECT query_id, vec_id, rank, similarity FROM t WHERE similarity >= 0.2")
def b10(spark, d):
    return vectors.top_k(vector_table(spark, d).where("label = 3").select("vec_id", "unit"), asked(spark, d), 5, "vec_id").select("query_id", "vec_id", "rank", "similarity")


@query("b11_file_member", f"WITH {VECTORS}, {MANY}, {scored()}, {top(40)}, m AS (SELECT * EXCLUDE (rank) FROM t WHERE similarity >= 0.2 AND list_contains(string_split(file_path || '<SEP>x', '<SEP>'), 'src3')), {top(10, 'm', 'u')} SELECT query_id, vec_id, rank, similarity FROM u")
def b11(spark, d):
    member = F.array_contains(F.split(F.concat("file_path", F.lit("<SEP>x")), "<SEP>"), "src3")
    return vectors.top_k_member(vector_table(spark, d), asked(spark, d), 10, "vec_id", member).select("query_id", "vec_id", "rank", "similarity")


@query("f03_vector_topk", f"WITH {VECTORS}, {MANY}, {scored()}, {top(20)} SELECT query_id, vec_id, similarity FROM t")
def f03(spark, d):
    return vectors.top_k(vector_table(spark, d).select("vec_id", "unit"), asked(spark, d), 20, "vec_id", threshold=-1.0).select("query_id", "vec_id", "similarity")


@query("c24_knn_cross", f"WITH {VECTORS}, {MANY}, {scored()}, {top(10)} SELECT query_id, vec_id, rank FROM t")
def c24(spark, d):
    return vectors.top_k(vector_table(spark, d).select("vec_id", "unit"), asked(spark, d), 10, "vec_id", threshold=-1.0).select("query_id", "vec_id", "rank")


@query("l03_vec_query", f"WITH {VECTORS}, {MANY}, {scored()}, {top(20)} SELECT query_id, vec_id, rank, similarity FROM t WHERE similarity >= 0.5")
def l03(spark, d):
    return vectors.top_k(vector_table(spark, d).select("vec_id", "unit"), asked(spark, d), 20, "vec_id", threshold=0.5).select("query_id", "vec_id", "rank", "similarity")


L2 = "d AS (SELECT q.query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.e, q.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM vecs v, q)"


@query("l04_legacy_search", f"WITH {VECTORS}, {MANY}, {L2} SELECT query_id, vec_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5")
def l04(spark, d):
    return vectors.by_distance(vector_table(spark, d).select("vec_id", "embedding"), asked(spark, d), 5, "vec_id").select("query_id", "vec_id", "rank", "distance")


@query("d20_confidence", f"WITH {VECTORS}, {MANY}, {L2}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5) SELECT query_id, CASE WHEN avg(distance) < 0.3 THEN 'high' WHEN avg(distance) < 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM t GROUP BY query_id")
def d20(spark, d):
    from brookwell.functions.scores import confidence

    found = vectors.by_distance(vector_table(spark, d).select("vec_id", "embedding"), asked(spark, d), 5, "vec_id")
    return found.groupBy("query_id").agg(confidence(F.avg("distance")).alias("confidence"))


PREFIX = r"p AS (SELECT *, sum(len(regexp_extract_all(content, '\S+'))) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM t)"


@query("e03_token_prefix", f"WITH {VECTORS}, {MANY}, {scored()}, {top(20)}, {PREFIX} SELECT query_id, vec_id FROM p WHERE total <= 3000")
def e03(spark, d):
    found = vectors.top_k(vector_table(spark, d), asked(spark, d), 20, "vec_id")
    return packing.token_prefix(found, ["query_id"], ["rank"], word_count(F.col("content")), 3000).select("query_id", "vec_id")


@query("e04_first_seen", f"WITH {VECTORS}, {MANY}, {scored()}, {top(20)} SELECT query_id, file_path, min(rank) AS rank FROM t GROUP BY query_id, file_path")
def e04(spark, d):
    found = vectors.top_k(vector_table(spark, d), asked(spark, d), 20, "vec_id")
    return packing.first_seen(found, ["query_id"], "file_path", ["rank"]).select("query_id", "file_path", "rank")


@query("k16_refs", f"WITH {VECTORS}, {MANY}, {scored()}, {top(20)}, f AS (SELECT query_id, file_path, min(rank) AS rank FROM t GROUP BY 1, 2) SELECT query_id, string_agg('[' || n || '] ' || file_path, chr(10) ORDER BY n) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM f) GROUP BY query_id")
def k16(spark, d):
    found = vectors.top_k(vector_table(spark, d), asked(spark, d), 20, "vec_id")
    return references(found)


def references(found):
    """Distinct file paths of each ranked list in order, numbered from 1, one a line."""
    seen = packing.first_seen(found, ["query_id"], "file_path", ["rank"])
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"])
    lines = F.transform(F.col("paths"), lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x))
    return seen.groupBy("query_id").agg(paths.alias("paths")).select("query_id", F.array_join(lines, "\n").alias("refs"))


NAIVE = f"WITH {VECTORS}, {ONE}, {scored()}, {top(20)}, {PREFIX.replace('FROM t', 'FROM t WHERE similarity >= 0.2 AND length(content) > 0')}"


@query("l24_naive", f"{NAIVE} SELECT rank, vec_id, file_path, similarity, CAST(total AS BIGINT) AS tokens_upto, content FROM p WHERE total <= 29500")
def l24(spark, d):
    """Naive retrieval: nearest chunks above the threshold, non-empty, within the token budget."""
    found = vectors.top_k(vector_table(spark, d), asked(spark, d, 7), 20, "vec_id").where(F.length("content") > 0)
    total = F.sum(word_count(F.col("content"))).over(packing.Window.partitionBy("query_id").orderBy("rank").rowsBetween(packing.Window.unboundedPreceding, 0))
    return found.withColumn("tokens_upto", total).where("tokens_upto <= 29500").select("rank", "vec_id", "file_path", "similarity", "tokens_upto", "content")


@query("p09_numbered_prompt", f"WITH {VECTORS}, {ONE}, {scored()}, {top(5)} SELECT query_id, string_agg('[Source ' || rank || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS prompt FROM t GROUP BY query_id")
def p09(spark, d):
    found = vectors.top_k(vector_table(spark, d), asked(spark, d, 7), 5, "vec_id", threshold=-1.0)
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return found.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("[Source "), x["rank"], F.lit("]\n"), x["content"])), "\n\n").alias("prompt"))


PACKED = """WITH RECURSIVE n AS (SELECT source, doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id, n_chars) AS k FROM documents),
b AS (SELECT source, doc_id, k, 0 AS bin, 1 AS held, size AS filled FROM n WHERE k = 1 UNION ALL
  SELECT n.source, n.doc_id, n.k, CASE WHEN filled + size > 12000 AND held > 1 THEN bin + 1 ELSE bin END, CASE WHEN filled + size > 12000 AND held > 1 THEN 1 ELSE held + 1 END, CASE WHEN filled + size > 12000 AND held > 1 THEN size ELSE filled + size END
  FROM b JOIN n ON n.source IS NOT DISTINCT FROM b.source AND n.k = b.k + 1)
SELECT source, doc_id, bin FROM b"""


@query("e06_greedy_pack", PACKED)
def e06(spark, d):
    """Greedy bins of each source's texts by length."""
    return packing.greedy_bin_rows(table(spark, d, "documents"), "source", "doc_id", "n_chars", 12_000)
