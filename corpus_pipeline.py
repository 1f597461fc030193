"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and works on all that the one before kept; its
result is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of documents (doc_id, text, lang, source, n_chars).  Null and empty texts pass the near-duplicate,
decontamination and personal-data stages unchanged; language ID rejects them.  Other columns of ``docs``
are kept as they are up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.llm import decontaminate, langid, packing, pseudonyms, superminhash
from salescast.llm.common import table, written

KNOWN_WORDS = 200_000  # cached by a worker that packs: it has held other stages' data before
LEAST_SCORE = 0.3  # share of a text's trigrams that the predicted language must know


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; without any lang to learn from all stay."""
    filters = langid.fit(docs)
    if not filters.langs:
        return docs
    return langid.identify(docs, filters, docs.columns, ("_lang_pred", "_lang_score")) \
        .where((F.col("_lang_pred") != langid.UND) & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id."""
    gone = superminhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's windows."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=docs.columns)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text."""
    out = pseudonyms.pseudonymise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) \
        if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=KNOWN_WORDS)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("personal_data", personal_data),
          ("packing", packed)]

ORACLE_SQL = None  # trained filters, keyed pseudonyms and tokenisation are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
