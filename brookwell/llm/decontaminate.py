"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

``tokenize`` writes each text once as space-joined words; ``term_counts`` and
``postings`` build the index (term -> document, position) for the terms asked for.
A test window is looked up by its two rarest terms: their posting lists, each
shifted by the term's offset in the window, are intersected, and the surviving
places are compared with the full window. Frequent terms are counted but never
posted, so the index that a search needs stays a small share of the corpus.

Words are the runs of ASCII letters, digits and all non-ASCII characters, A-Z
lower-cased. A window is ``width`` consecutive words of an item; an item of fewer
words, but not none, is one window.

Defined cases: a null or empty text has no words; a null item text has no
windows; a null item id matches but is not listed; repeated items count once,
repeated documents each get the same row; null document ids are kept apart by
their texts; an empty benchmark leaves every document clean, and an
empty table of documents gives an empty one; a very long text is one row of words
and is exploded by its tasks only; other columns of the inputs are not looked at,
whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookwell.llm.work import attach, meet, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term tables of up to this many rows are broadcast to filter tokens; larger ones are joined by shuffle.
MOST_BROADCAST_TERMS = 1_000_000


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD), F.lit(0))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (id, text_hash, n_words, words): words joined by one space."""
    return written(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
        .select("id", "text_hash", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words")),
        "tokens",
    )


def _are_few(terms: DataFrame) -> bool:
    return terms.limit(MOST_BROADCAST_TERMS + 1).count() <= MOST_BROADCAST_TERMS


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` over all documents; 0 if there are none. Too many terms for a broadcast meet the counts of all words, not their occurrences."""
    words = tokens.where("n_words > 0").select(F.explode(F.split("words", " ")).alias("term"))
    found = words.join(F.broadcast(terms), "term", "left_semi") if _are_few(terms) else words
    return terms.join(found.groupBy("term").agg(F.count("*").alias("n")), "term", "left").na.fill(0, ["n"])


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Written index (term, n, id, text_hash, pos) of all places of ``terms`` (term, n), whose counts are known; pos counts from 0."""
    placed = tokens.where("n_words > 0").select("id", "text_hash", F.posexplode(F.split("words", " ")).alias("pos", "term"))
    if _are_few(terms):
        found = placed.join(F.broadcast(terms.select("term", "n")), "term")
    else:
        found = attach(placed, written(terms, "anchor-terms"), ["term"], "n", tokens.agg(F.sum("n_words")).first()[0] or 0)
    return written(found.select("term", "n", "id", "text_hash", "pos"), "postings")


def windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase, size) of each distinct window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("p")).select("item", F.array_join("p", " ").alias("phrase"), F.size("p").alias("size")).distinct()


def anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, size, a, a_at, a_n, b, b_at, b_n): each window's two rarest terms, their offsets and occurrences; windows with a term that no document has are left out. A window holds few terms, so its group is small."""
    terms = phrases.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("at", "term")).join(counts, "term")
    order = Window.partitionBy("phrase").orderBy("n", "at")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return ranked.groupBy("phrase", "size").agg(
        pick(1, "term").alias("a"), pick(1, "at").alias("a_at"), pick(1, "n").alias("a_n"),
        F.coalesce(pick(2, "term"), pick(1, "term")).alias("b"), F.coalesce(pick(2, "at"), pick(1, "at")).alias("b_at"), F.coalesce(pick(2, "n"), pick(1, "n")).alias("b_n"),
    ).where("a_n > 0")


def _places(posted: DataFrame, chosen: DataFrame, rank: str) -> DataFrame:
    """The places of each window's rarest term (rank ``a``) or second rarest (``b``) with the columns of ``chosen``."""
    total = posted.count()
    return meet(posted, chosen.select(F.col(rank).alias("term"), F.col(f"{rank}_n").alias("n"), *chosen.columns), ["term"], "n", total, ["id", "text_hash", "pos"])


def _search(docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text: str):
    tokens = tokenize(docs, id_col, text_col)
    wanted = written(windows(items, width, item_col, item_text), "windows")
    phrases = wanted.select("phrase", "size").distinct()
    terms = written(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "terms")
    counts = written(term_counts(tokens, terms), "counts")
    chosen = written(anchors(phrases, counts), "anchors")
    posted = postings(tokens, counts.join(chosen.select(F.col("a").alias("term")).union(chosen.select("b")).distinct(), "term"))
    return tokens, wanted, chosen, posted


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, text_hash, n_words, n_hit (words inside a window's occurrence), items (ids of matching items, sorted as strings), spans (start and size of each occurrence)."""
    tokens, wanted, chosen, posted = _search(docs, items, width, id_col, text_col, item_col, item_text)
    first = _places(posted, chosen, "a").select("id", "text_hash", (F.col("pos") - F.col("a_at")).alias("start"), "phrase", "size", "b", (F.col("pos") - F.col("a_at") + F.col("b_at")).alias("b_pos")).where("start >= 0")
    other = posted.select(F.col("term").alias("t"), F.col("id").alias("i"), F.col("text_hash").alias("h"), "pos")
    both = first.join(other, (F.col("b") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")) & (F.col("b_pos") == F.col("pos")))
    places = both.groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(F.array_sort(F.collect_set(F.struct("start", "size", "phrase"))).alias("places"))
    met = places.join(tokens, tokens.id.eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).select("id", "text_hash", "words", "places")
    # The words of a text are split once, as the variable of an outer function; a place and size have one phrase there.
    there = F.transform(F.array(F.split("words", " ")), lambda w: F.filter("places", lambda p: F.array_join(F.slice(w, p["start"] + 1, p["size"]), " ") == p["phrase"]))
    hits = met.select("id", "text_hash", F.get(there, F.lit(0)).alias("hits")).where(F.size("hits") > 0)
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            F.greatest(acc["upto"], p["start"] + p["size"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), p["start"] + p["size"] - F.greatest(acc["upto"], p["start"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    spans = F.transform("hits", lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size")))
    hits = written(hits.select("id", "text_hash", covered.alias("n_hit"), spans.alias("spans"), "hits").distinct(), "hits")
    named = written(hits.select("id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda p: p["phrase"]))).alias("phrase")), "named")
    # A passage may stand in a third of all documents, and in many items.
    often, total = written(named.groupBy("phrase").agg(F.count("*").alias("n")), "often"), named.count()
    named = meet(attach(named, often, ["phrase"], "n", total, merge=False), wanted.select("phrase", "item").join(often, "phrase"), ["phrase"], "n", total, ["id", "text_hash"])
    listed = named.groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda d: d.id.eqNullSafe(F.col("i")) & (d.text_hash == F.col("h"))
    found = listed.join(hits.select("id", "text_hash", "n_hit", "spans"), same(hits)).select("i", "h", "n_hit", "items", "spans")
    return tokens.select("id", "text_hash", "n_words").join(found, same(tokens), "left").select(
        F.col("id").alias(id_col), "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, phrase, start, gap): the two rarest terms of a window stand within ``slop`` words of their distance in it; gap is 0 where it is exact.

    Shifted places are matched by cells of ``slop + 1`` words and their neighbours, so that a document's places are not all paired.
    """
    _, wanted, chosen, posted = _search(docs, items, width, id_col, text_col, item_col, item_text)
    a = _places(posted, chosen, "a").select("id", "text_hash", "phrase", (F.col("pos") - F.col("a_at")).alias("start"))
    b = _places(posted, chosen, "b").select(F.col("id").alias("i"), F.col("text_hash").alias("h"), F.col("phrase").alias("p"), (F.col("pos") - F.col("b_at")).alias("b_start"))
    cell = lambda c: F.floor(F.col(c) / (slop + 1))
    b = b.withColumn("cell_b", F.explode(F.array(cell("b_start") - 1, cell("b_start"), cell("b_start") + 1)))
    near = a.withColumn("cell_a", cell("start")).join(b, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")) & (F.col("phrase") == F.col("p")) & (F.col("cell_a") == F.col("cell_b")))
    near = near.withColumn("gap", F.abs(F.col("start") - F.col("b_start"))).where(F.col("gap") <= slop)
    best = near.groupBy("id", "phrase", "start").agg(F.min("gap").alias("gap"))
    return best.join(wanted.select("phrase", "item"), "phrase").select(F.col("id").alias(id_col), "item", "phrase", "start", "gap").distinct()
