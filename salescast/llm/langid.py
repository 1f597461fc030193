"""Language identification with language-bitmask n-gram filters.

Training counts the letter trigrams of every learned document per language.  A language owns a trigram
whose share of its text is at least ``own`` of the largest share among the languages, so wrong or mixed
documents do not fill the filters as a corpus grows.  Owned trigrams go into one bit-sliced Bloom filter:
a cell holds one bit per language, and the AND of a trigram's cells returns at once every language that
contains it.  A text's per-language popcounts, each corrected for its slice's false-positive rate, decide.

Inputs: (doc_id, text, lang); other columns are ignored.  Null texts, and texts without a letter, are
``und`` with score 0, as is every text where nothing was learned.  Ties go to the alphabetically first
language; so does, with score 0, a text with letters none of whose trigrams is in any filter.  Rows with null lang or text teach nothing.
Texts are read whole, piece by piece.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, map_exact, mix, table, written

UND = "und"
PIECE = 1 << 20  # characters worked on at once


def _letters() -> np.ndarray:
    """Code point -> code point of the lower-case letter, or 32 for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x40000):  # no letters are assigned beyond the fourth plane
        s = chr(c)
        if unicodedata.category(s)[0] == "L" or unicodedata.category(s) == "Mn":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


LETTERS = _letters()


def trigrams(texts: list[str]):
    """(keys, doc): the trigrams of each text's letters, runs of other characters being one space.

    A text is framed by spaces.  Trigrams with a space in the middle are left out; a key is exact.
    """
    joined = "\0".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = LETTERS[codes]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])[:len(low)]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # one space for a run of them; the seam is one too
    low, doc = low[keep].astype(U64), doc[keep]
    low = np.concatenate([[U64(32)], low, [U64(32)]]).astype(U64)
    a, b, c = low[:-2], low[1:-1], low[2:]
    at = np.flatnonzero(b != 32)
    return (a[at] << U64(42)) | (b[at] << U64(21)) | c[at], doc[at]


def pieces(texts):
    """Lists of (text number, piece of at most PIECE characters) of about PIECE characters together."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(len(t), 1), PIECE):
            batch.append((i, t[s:s + PIECE]))
            size += len(batch[-1][1])
            if size >= PIECE:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def count_trigrams(batches):
    """Batches of (text, lang) -> batches of (lang, gram, n), summed within each batch of rows."""
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            for batch in pieces(part["text"].tolist()):
                grams, n = np.unique(trigrams([p for _, p in batch])[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})


@dataclass
class LanguageFilters:
    """cells[p, s]: bits of 64 languages, for slice s; rate[l]: share of a language's cells that are set."""

    langs: list[str]
    cells: np.ndarray
    rate: np.ndarray
    hashes: int


def places(grams: np.ndarray, k: int, cells: int) -> np.ndarray:
    return (mix(grams + U64(0x51ED270B * (k + 1))) & U64(cells - 1)).astype(np.int64)


def sized(owned: int, cells: int, hashes: int, wrong: float) -> tuple[int, int]:
    """(cells, hashes) of the smallest filter, of ``cells`` or a power of two times that, with rate ``wrong`` or less."""
    while True:
        for k in range(hashes, 9):
            if (1 - math.exp(-k * owned / cells)) ** k <= wrong:
                return cells, k
        cells *= 2


def fit(docs: DataFrame, own: float = 0.25, cells: int = 1 << 20, hashes: int = 2, wrong: float = 0.05) -> LanguageFilters:
    """Learn from all rows of ``docs`` (text, lang).

    ``cells`` (a power of two) and ``hashes`` are the least; both grow until the language with the most owned
    trigrams has false positives at a rate of ``wrong`` at most.  What reaches the driver is the filter
    itself, at most a row for each cell and slice; the rest is grouped in Spark.
    """
    counts = docs.where("lang is not null and text is not null").select("text", "lang") \
        .mapInPandas(count_trigrams, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "langid-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    if not langs:
        return LanguageFilters([], np.zeros((cells, 1), U64), np.zeros(0), hashes)
    slices = -(-len(langs) // 64)
    number = totals.select("lang", "total", F.array_position(F.lit(langs), F.col("lang")).alias("l"))
    share = counts.join(F.broadcast(number), "lang").select("gram", (F.col("l") - 1).cast("int").alias("l"),
                                                            (F.col("n") / F.col("total")).alias("p"))
    top = share.groupBy("gram").agg(F.max("p").alias("top"))
    owned = written(share.join(top, "gram").where(F.col("p") >= own * F.col("top")).select("gram", "l"), "langid-owned")
    most = owned.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    cells, hashes = sized(most, cells, hashes, wrong)
    owned = owned.groupBy("gram", F.expr("l div 64").alias("slice")).agg(F.expr("bit_or(shiftleft(1L, l % 64))").alias("mask"))

    def spread(batches):
        for pdf in batches:
            g = pdf["gram"].to_numpy().astype(U64)
            for k in range(hashes):
                yield pd.DataFrame({"cell": places(g, k, cells), "slice": pdf["slice"], "mask": pdf["mask"]})

    rows = owned.mapInPandas(spread, "cell long, slice long, mask long") \
        .groupBy("cell", "slice").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros((cells, slices), U64)
    out[rows["cell"].to_numpy(), rows["slice"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(U64)
    rate = np.array([((out[:, n // 64] >> U64(n % 64)) & U64(1)).mean() for n in range(len(langs))])
    return LanguageFilters(langs, out, rate, hashes)


def score_texts(texts: list[str], f: LanguageFilters):
    """(language, score) of each text; score: the winner's corrected share of the text's trigrams."""
    n_l, n = len(f.langs), len(texts)
    total, hits = np.zeros(n), np.zeros((n, n_l))
    for batch in pieces(texts):
        owner = np.array([i for i, _ in batch])
        grams, doc = trigrams([p for _, p in batch])
        doc = owner[doc]
        total += np.bincount(doc, minlength=n)
        if not n_l:
            continue
        masks = f.cells[places(grams, 0, len(f.cells))]
        for k in range(1, f.hashes):
            masks = masks & f.cells[places(grams, k, len(f.cells))]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
        for lang in range(n_l if len(cuts) else 0):
            bits = (masks[:, lang // 64] >> U64(lang % 64)) & U64(1)
            np.add.at(hits[:, lang], doc[cuts], np.add.reduceat(bits, cuts).astype(float))
    if not n_l:
        return [UND] * n, np.zeros(n)
    wrong = f.rate ** f.hashes
    fixed = np.clip((hits - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
    best = fixed.argmax(1)
    score = np.clip(fixed[np.arange(n), best] / np.maximum(total, 1), 0, 1)
    return [f.langs[b] if t else UND for b, t in zip(best, total)], score


def identify(docs: DataFrame, filters: LanguageFilters, keep: list[str],
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs``'s columns ``keep`` (none of them named as in ``names``) with the language and its score."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.select(*keep).schema
    out = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
    text = "text" if "text" in keep else "_text"

    def run(batches):
        for pdf in batches:
            langs, score = score_texts(pdf[text].fillna("").tolist(), held.value)
            yield pdf[keep].assign(**{names[0]: langs, names[1]: score})

    read = keep if text in keep else [*keep, F.col("text").alias(text)]
    return map_exact(docs.select(*read), run, f"{out}, `{names[0]}` string, `{names[1]}` double")


def held_out(divisor: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor == rest


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    filters = fit(docs.where(~held_out(4, 2)))
    return identify(docs.withColumn("held_out", held_out(4, 2)), filters, ["doc_id", "held_out"])
