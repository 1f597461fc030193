"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window).  For a
document to hold a window it must hold every word of it, so of the window's words, ordered by rarity
over all documents, the first alone is a necessary prefix.  Documents are joined on that word; the
word's place in the window gives the only place the window can have in the document (positional bound),
which must lie inside the document (length bound); then the words are compared one by one (exact
containment).  Matched windows meet again per document as short intervals.

Inputs: documents (doc_id, text), benchmark (item_id, text); other columns are ignored.  Null and empty
texts have no words and are never hit; an item without words has no windows; repeated windows, items and
documents each count in their own right; empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

# What separates words, after lower-casing A-Z: all ASCII but digits and letters (fixed by the contract).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BLOCK_BYTES = 16 << 20


def words_of(text):
    """The words of ``text`` in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, at, win): each run of ``width`` words, or the whole of a shorter item."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    return w.select("item_id", "w", F.explode(F.expr(f"sequence(1, greatest(size(w) - {width} + 1, 1))")).alias("at")) \
        .select("item_id", "at", F.expr(f"slice(w, at, {width})").alias("win"))


def word_counts(docs: DataFrame, words: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How often each of ``words`` (word, distinct) occurs in all documents; 0 rows for words that don't.

    The words are broadcast while they hold at most ``block_bytes``; a larger set is joined by a shuffle
    after the documents' words are counted.
    """
    said = docs.select(F.explode_outer(words_of(F.col("text"))).alias("word"))
    held = words.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if held <= block_bytes:
        return said.join(F.broadcast(words), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return said.groupBy("word").agg(F.count("*").alias("n")).join(words, "word", "left_semi")


def prefix_index(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(prefix, back, win, items): each distinct window under its rarest word, which stands ``back`` words in.

    Ties go to the smaller word; of a word that the window repeats, its first place counts.
    """
    wins = written(item_windows(benchmark, width).groupBy("win")
                   .agg(F.sort_array(F.collect_set("item_id")).alias("items")), "decon-windows")
    vocab = written(wins.select(F.explode("win").alias("word")).distinct(), "decon-vocab")
    counts = word_counts(docs, vocab)
    first = wins.select("win", F.explode(F.array_distinct("win")).alias("word")).join(counts, "word", "left") \
        .groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("p")) \
        .where("p.n > 0")  # a window with a word that no document has occurs nowhere
    return wins.join(first, "win").select(F.col("p.word").alias("prefix"),
                                          (F.array_position("win", F.col("p.word")) - 1).cast("int").alias("back"),
                                          "win", "items")


def text_key(text):
    """128 bits of hash of the text; null is like the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def window_hits(docs: DataFrame, index: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_text, start, size, items): every place (from 0) where a document's text, named by its key, holds a window.

    The index is broadcast in blocks of about ``block_bytes`` of text, counted before, so that what is
    broadcast is bounded however long the benchmark is; each block meets all documents.
    """
    index = written(index, "decon-index")
    n = index.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-n // block_bytes))
    tokens = docs.select("text", words_of(F.col("text")).alias("w"))
    found = []
    for b in range(blocks):
        block = index.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        # plain functions all the way: scan, explode, join and comparison are one generated loop,
        # in which a document's words are never copied; the key is only made of texts that hold a window
        found.append(tokens.select("text", "w", F.posexplode_outer("w").alias("pos", "word")).join(
            F.broadcast(block.withColumn("size", F.size("win"))),
            F.expr("word = prefix and pos >= back and pos - back + size <= size(w)"
                   " and slice(w, greatest(pos - back + 1, 1), size) = win"))
            .select(text_key(F.col("text")).alias("_text"), (F.col("pos") - F.col("back")).alias("start"), "size", "items"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: its columns ``keep`` (doc_id), n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window; contaminated: n_hit > 0 and
    20 * n_hit >= n_words.  Hits are kept by a hash of the text, so that rows of the same doc_id, or of none, are judged
    each by its own text, and equal texts alike.
    """
    keep = ["doc_id"] if keep is None else keep
    hits = written(window_hits(docs, prefix_index(docs, benchmark, width)), "decon-hits")
    # a text's intervals are bounded by its length; the items are a set of the benchmark's
    spans = hits.groupBy("_text").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("s"))
    covered = F.expr("""aggregate(s, named_struct('n', 0L, 'till', 0),
        (a, x) -> named_struct('n', a.n + greatest(0, x.start + x.size - greatest(a.till, x.start)),
                               'till', greatest(a.till, x.start + x.size)), a -> a.n)""")
    items = hits.select("_text", F.explode("items").alias("item")).distinct() \
        .select("_text", F.col("item").cast("string").alias("item")) \
        .groupBy("_text").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    got = spans.select("_text", covered.alias("_hit")).join(items, "_text")
    n_words = F.size(words_of(F.col("text"))).cast("long")
    return docs.select(*keep, n_words.alias("_words"), text_key(F.col("text")).alias("_text")).join(got, "_text", "left").select(
        *keep, F.col("_words").alias("n_words"),
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256")) \
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"),
                         table(spark, sf_dir, "benchmark", "item_id", "text"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = (r"regexp_extract_all(translate(coalesce(text, ''), '" + _UP + "', '" + _LOW
             + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
RULE_SQL = f"""
iw AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(len(w), 13) AS size
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, {WORDS_SQL} AS w FROM docs),
dwin AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
         FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM dw, sizes
               WHERE len(w) >= size)),
occ AS (SELECT DISTINCT d.doc_id, d.i, d.size, win.item_id FROM dwin d JOIN win ON d.s = win.s AND d.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id),
judged AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id))"""
SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {RULE_SQL} SELECT * FROM judged"
