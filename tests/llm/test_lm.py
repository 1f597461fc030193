"""Language-model scores against a model of plain dictionaries, and the trie's parts on their own."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescast.llm import lm


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def brute(docs, mu=lm.MU):
    said = [(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False,
             [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]) for i, t in docs]
    uni, bi, tri = Counter(), Counter(), Counter()
    for _, held, w in said:
        if not held:
            uni.update(w)
            x = ["<s>", "<s>", *w]
            bi.update(zip(x, x[1:]))
            tri.update(zip(x, x[1:], x[2:]))
    n, v = sum(uni.values()), len(uni)
    uni["<s>"] = uni["</s>"]
    out = []
    for i, held, w in said:
        x, base, total = ["<s>", "<s>", *w], 0.0, 0.0
        for a, b, c in zip(x, x[1:], x[2:]):
            p1 = (uni[c] + 1) / (n + v + 1)
            p2 = (bi[b, c] + mu[0] * p1) / (uni[b] + mu[0])
            total += math.log10((tri[a, b, c] + mu[1] * p2) / (bi[a, b] + mu[1]))
            base += math.log10(p1)
        out.append((i, held, len(w), sum(uni[c] > 0 for c in w), n, base, total))
    return out


def made(seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(f"W{int(rng.expovariate(0.05))}" for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(200)]
    docs += [(9 + i, docs[3][1]) for i in range(40)] + [(2**53 + 1, "w1 w2"), (None, "w1  w3\tw4"), (None, "w1"), (4, None),
                                                       (6, ""), (7, " \n"), (8, "é É " + "w3 w4 " * 20_000)]
    return docs


def close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 0.0045 * w[2], (g, w)


@pytest.mark.parametrize("block,shard", [(lm.BLOCK, lm.SHARD), (400, 3000)])
def test_against_brute_force(spark, block, shard):
    docs = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"held": F.lit(1), "block": F.lit("x")})
    close([tuple(r) for r in lm.score_texts(df.repartition(3), held_out(), block=block, shard=shard).collect()], brute(docs))


def test_empty_and_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(none, held_out()).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_texts(one, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and abs(r.score) < 0.01


def test_text_order(spark):
    """Better than single words on held-out documents of the tables."""
    r = lm.op13_elias_fano_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# the trie

@pytest.mark.parametrize("top", [1, 5, 700, 10**6, 1 << 45])
def test_elias_fano(top):
    rng = np.random.default_rng(top)
    v = np.unique(rng.integers(0, top, 3000))
    e = lm.EliasFano(lm.EliasFano.of(v))
    assert (e.get(np.arange(len(v))) == v).all() and (e.find(v) == np.arange(len(v))).all()
    x = rng.integers(0, 2 * top, 3000)
    at = np.searchsorted(v, x)
    want = np.where((at < len(v)) & (v[np.minimum(at, len(v) - 1)] == x), at, -1)
    assert (e.find(x) == want).all()
    assert (lm.EliasFano(lm.EliasFano.of(np.repeat(v, 3))).get(np.arange(3 * len(v))) == np.repeat(v, 3)).all()
    if top > 10**5:  # some bits a number more than its share of the range, not eight bytes
        assert len(lm.EliasFano.of(v)) < len(v) * (math.log2(top / len(v)) + 4) / 8 + 100


def test_level():
    rng = np.random.default_rng(1)
    rows = sorted({(int(p), int(x)) for p, x in zip(rng.integers(0, 50, 2000), rng.integers(0, 300, 2000)) if p != 7})
    p, x = np.array(rows).T
    level = lm.Level(lm.Level.of(p, x, 50))
    assert (level.find(p, x) == np.arange(len(rows))).all()
    place = {r: k for k, r in enumerate(rows)}
    q = np.stack([rng.integers(-1, 50, 5000), rng.integers(0, 400, 5000)])
    assert level.find(*q).tolist() == [place.get(r, -1) for r in zip(*q.tolist())]


def test_pack():
    arrays = [np.arange(10), np.zeros(0), np.array([2**64 - 1], np.uint64), np.array([0, 255, 256, 65536])]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert a.astype(np.uint64).tolist() == b.tolist()


def test_distinct_grams_by_one_sort_and_by_two():
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 9, (3, 2000))
    one, two = lm.distinct_grams(b, c, a, 9), lm.distinct_grams(b, c, a, 1 << 21)
    for got, base in ((one, 9), (two, 1 << 21)):
        pairs, pair, up, first, gram = got
        assert (pairs[pair] == b * base + c).all() and (pairs[up[gram]] == b * base + c).all() and (first[gram] == a).all()
        assert (np.diff(pairs) > 0).all() and len({*zip(up.tolist(), first.tolist())}) == len(up) == len({*zip(a, b, c)})
    assert all((x == y).all() for x, y in zip(one[1:], two[1:]))


def test_buckets_longer_than_a_word():
    v = np.r_[np.arange(1000), 10**9 + np.arange(0, 5000, 7), 10**12]
    e = lm.EliasFano(lm.EliasFano.of(v))
    assert (e.find(v) == np.arange(len(v))).all() and (e.find(v + 10**8) == -1).all() and (e.all() == v).all()
