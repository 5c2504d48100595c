"""The queries of the training-data operators and their SQL."""

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwell.llm import chat, decontaminate, html_main, langid, merkle, mixing, nearjoin, quality, secret_scan, spelling, substrings, superminhash, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.where(part != 2))
    held_out = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    return langid.identify(held_out, model, carry=("held_out",))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_warc_reassembly": op1_warc_reassembly,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_entropy_balancing": op6_entropy_balancing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_site_style_tree": op9_site_style_tree,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_superminhash": op11_superminhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _crc32(values: str) -> str:
    """SQL for the crc32 of a list of bytes."""
    table = [0] * 256
    for b in range(256):
        table[255 ^ b] = zlib.crc32(bytes([b])) ^ 0xFF000000
    return f"xor(list_reduce({values}, lambda s, b: xor(s >> 8, {table}[(xor(s, b) & 255) + 1]), 4294967295), 4294967295)"


def _coded(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _reduced(leaves: str, out: str, levels: int) -> str:
    """SQL of the trees over ``leaves`` (id, key, k, top, f), k numbering the nodes of a key: table ``out`` (id, top, f, proof) of their roots and proofs."""
    steps = [f"{out}0 AS (SELECT *, '' AS proof FROM {leaves})"]
    for i in range(levels):
        others = "array_to_string(nodes[1:k % 16], '')", "array_to_string(nodes[k % 16 + 2:], '')"
        steps += [
            f"{out}r{i} AS (SELECT key, k // 16 AS run, list(top ORDER BY k) AS nodes, max(max(k)) OVER (PARTITION BY key) = 0 AS over FROM (SELECT DISTINCT key, k, top FROM {out}{i}) GROUP BY key, k // 16)",
            f"""{out}{i + 1} AS (SELECT id, key, run AS k, CASE WHEN over THEN top ELSE sha256(array_to_string(nodes, '')) END AS top, CASE WHEN over THEN f ELSE sha256({others[0]} || f || {others[1]}) END AS f,
  CASE WHEN over THEN proof ELSE proof || {others[0]} || {others[1]} END AS proof FROM {out}{i} t JOIN {out}r{i} USING (key) WHERE k // 16 = run)""",
        ]
    return ",\n".join([*steps, f"{out} AS (SELECT id, top, f, proof FROM {out}{levels})"])


SQL: dict[str, str] = {
    "op1_warc_reassembly": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to, true AS intact
FROM q LEFT JOIN k USING (payload_digest)
""",
    "op2_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(0, n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN it USING (r)
""",
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, text AS raw FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, i + unnest(range(0, 3)) AS p FROM tri SEMI JOIN twice USING (r, g)) GROUP BY r),
l AS (SELECT r, raw, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), '\s+', ' ', 'g'), '\d+', '0', 'g') AS norm FROM (SELECT r, raw, source, unnest(string_split(t, chr(10))) AS line FROM d)),
lw AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
tot AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
freq AS (SELECT source, norm, count(DISTINCT raw) AS n FROM lw GROUP BY source, norm),
common AS (SELECT f.source, norm FROM freq f JOIN tot ON f.source IS NOT DISTINCT FROM tot.source WHERE n > 20 AND n > 0.01 * docs),
lost AS (SELECT r, sum(lw.n) AS removed FROM lw JOIN common c ON lw.norm = c.norm AND lw.source IS NOT DISTINCT FROM c.source GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept FROM b
""",
    "op5_perspective_rotation": """
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(role) <> '' THEN role END AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker IS NOT NULL AND speaker <> 'system'),
j AS (SELECT s.conv_id, turn, speaker, text, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role FROM s JOIN v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN coalesce(speaker, 'unknown') END AS name, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM j),
g AS (SELECT *, CASE WHEN role = 'user' THEN '<|user name=' || replace(name, '<|', '< |') || '|>' || chr(10) ELSE '<|' || role || '|>' || chr(10) END AS head FROM h),
o AS (SELECT *, sum(length(head || body)) OVER w AS seg_end, row_number() OVER w - 1 AS position FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, head || body AS segment, CAST(seg_end - length(head || body) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
  CAST(CASE WHEN role = 'assistant' THEN seg_end - length(body) END AS BIGINT) AS mask_start, CAST(CASE WHEN role = 'assistant' THEN seg_end - 1 END AS BIGINT) AS mask_end
FROM o
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, list_aggregate(w[i:i+34], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, list(i) AS starts FROM win SEMI JOIN again USING (g) GROUP BY r),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM (SELECT r, unnest(starts) AS i FROM hit)),
n AS (SELECT r, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
""",
    "op11_superminhash": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT w, min(r) AS u FROM d WHERE len(w) > 0 GROUP BY w),
g AS (SELECT DISTINCT u, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t)),
n AS (SELECT u, count(*) AS n FROM g GROUP BY u),
x AS (SELECT a.u AS a, b.u AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.u < b.u GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.u = a JOIN n q ON q.u = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
c AS (WITH RECURSIVE reach AS (SELECT u, u AS v FROM n UNION SELECT reach.u, z.b FROM reach JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) z ON reach.v = z.a) SELECT u, min(v) AS head FROM reach GROUP BY u),
m AS (SELECT r, doc_id, head, n FROM d JOIN t USING (w) JOIN c USING (u) JOIN n USING (u)),
h AS (SELECT head, min(doc_id) AS component_id FROM m GROUP BY head),
o AS (SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM m JOIN h USING (head) UNION ALL SELECT doc_id, 0, doc_id FROM d WHERE len(w) = 0)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
q AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT run, n, {_crc32("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, ord(c) - 64] END))")} AS h FROM q),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.rest = w.word),
r AS (SELECT a AS word, b AS form, w.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS k FROM p JOIN w ON w.word = b),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN r ON r.word = w.word AND k = 1),
z AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(root, step) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN z USING (word) GROUP BY word, form, n, n_near, form_n
""",
    "op13_merkle_manifest": rf"""
WITH c AS (SELECT *, CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS found FROM documents),
h AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS key, sha256({" || ".join(map(_coded, ("doc_id", "source", "lang", "n_chars", "text")))}) AS top, sha256({" || ".join(map(_coded, ("doc_id", "source", "lang", "n_chars", "found")))}) AS f FROM c),
l AS (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, top) - 1 AS k, top, f FROM h),
{_reduced("l", "t", 6)},
s AS (SELECT id, '' AS key, dense_rank() OVER (ORDER BY h.key) - 1 AS k, t.top, t.f FROM t JOIN h USING (id)),
{_reduced("s", "u", 4)}
SELECT doc_id, h.top AS leaf, t.top AS subroot, u.top AS root, sha256(t.proof || u.proof) AS proof_sha256, u.f AS folded_root, u.f = u.top AS verified FROM h JOIN t USING (id) JOIN u USING (id)
""",
}
