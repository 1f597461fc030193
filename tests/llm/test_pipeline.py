"""The corpus pipeline, stage by stage, on rows made for it, and on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salescast.llm import pseudonyms
from conftest import SF001, SF01
from test_operators import brute_components


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "1234", "en", "s", 4),
                                   (10**6 + 2, "κάποιο κείμενο σε άλλη γλώσσα", None, "s", 9)], docs.schema)
    steps = [docs.union(extra)]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF01).persist())
    return steps


def test_columns_and_rows(kept):
    assert all(d.columns == kept[0].columns for d in kept[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5


def test_language_rejects(kept):
    assert kept[1].where("doc_id >= 1000000").count() == 0
    assert kept[1].count() >= 0.99 * (kept[0].count() - 3)


def test_one_of_each_group_stays(kept):
    texts = {r.doc_id: r.text for r in kept[1].select("doc_id", "text").collect()}
    comp, _ = brute_components(dict(random.Random(1).sample(sorted(texts.items()), 250)), 5, 80)
    left = {r.doc_id for r in kept[2].select("doc_id").collect()}
    assert left <= set(texts) and len(left) < len(texts)
    for top in set(comp.values()):  # of a group in the sample at most one is left
        assert len({i for i, c in comp.items() if c == top} & left) <= 1


def test_contaminated_go_and_values_change(kept):
    assert 0 < kept[2].count() - kept[3].count()
    both = kept[3].select("doc_id", F.col("text").alias("was")).join(kept[4], "doc_id").toPandas()
    assert len(both) == kept[3].count()
    assert all(m[0] not in now for was, now in zip(both.was, both.text) for m in pseudonyms.FOUND.finditer(was)
               if not m["card"] or pseudonyms.card_in(m[0]))
    assert (both.n_chars == both.text.str.len()).all()


def test_every_id_is_packed(kept):
    per = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per.count() == kept[4].count() and per.where("n <> t").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 0
