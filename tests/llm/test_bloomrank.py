"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from salescast.llm import bloomrank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def said(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    tfs = [(i, Counter(said(t))) for i, t in docs]
    tfs = [(i, tf, sum(tf.values())) for i, tf in tfs if tf]
    n, total = len(tfs), sum(x[2] for x in tfs)
    df = Counter(t for _, tf, _ in tfs for t in tf)
    out = []
    for item, text in items:
        got = []
        for i, tf, size in tfs:
            m = 10 + 90 * size * n // total
            got.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                             for t in set(said(text)) if tf[t]), -1 if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(x for x in got if x[0] < 0)[:top])]
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(f"W{int(rng.expovariate(0.02))}" for _ in range(rng.choice([3, 20, 20, 100, 900])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000 + i, docs[8][1] + f" x{i}") for i in range(30)]
    docs += [(5, "w1 w2 w3 w900"), (5, "w1 w2 w3 w900"), (None, "w5 w6 w7"), (None, "w5 w7"), (4, None), (6, ""), (7, "-- !"),
             (8, "é" * 2000 + " " + "w3 w4 Ünï " * 9000)]
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(12))) for i in range(12)]
    items += [(20, docs[7][1]), (21, docs[8][1]), (22, None), (23, "nowhere"), (24, "w5 w7"), (24, "w900 Ünï ünï"), (None, "w3")]
    return docs, items


@pytest.mark.parametrize("seed,blocks,small", [(1, bloomrank.BLOCK_BYTES, False), (2, 600, True)])
def test_against_brute_force(spark, monkeypatch, seed, blocks, small):
    if small:  # many blocks of few documents, and signatures so full that bounds are far too high
        monkeypatch.setattr(bloomrank, "MOST_DOCS", 16)
        monkeypatch.setattr(bloomrank, "BITS", 1)
    docs, items = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "q": F.lit("x")}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    got = bloomrank.search(d, q, block_bytes=blocks).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_bounds_are_never_too_low():
    docs, items = made(3)
    docs = [(i, bloomrank.terms(t)) for i, t in docs if bloomrank.terms(t)]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    queries = bloomrank.Queries([{"item_id": i, "text": t} for i, t in items], n, total, df)
    known, width = bloomrank.WordHashes(), 1 << 13
    block = bloomrank.Block(width)
    for i, t in docs:
        tf = Counter(t)
        h = known.of(list(tf))
        at = [bloomrank.places(h[[v >= 1 << k for v in tf.values()]], k, width).ravel() for k in range(14)]
        block.add(i, len(t), b"", bloomrank.np.unique(bloomrank.np.concatenate(at)))
    row = block.row()
    bounds = dict(queries.bounds(width, bloomrank.np.array(row["n"]), row["slices"]))
    for q in range(len(items)):
        for k, (_, t) in enumerate(docs):
            exact = queries.score(q, Counter(t), len(t))
            assert exact <= (bounds[q][k] if q in bounds else 0)


def test_empty(spark):
    docs, items = ("doc_id long, text string", "item_id long, text string")
    none, some = spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b")], docs)
    asked = spark.createDataFrame([(1, "a")], items)
    assert bloomrank.search(none, asked).count() == 0
    assert bloomrank.search(some, spark.createDataFrame([], items)).count() == 0
    assert [tuple(r) for r in bloomrank.search(some, asked).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]
