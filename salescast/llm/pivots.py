"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``near`` nearest reference points (pivots), nearest first.  It is entered in
the inverted lists of the first of them in pivot order that a match must reach: two vectors that share at
least ``shared`` of ``near`` pivots meet in the list of one of ``near - shared + 1``.  In a list the
shared pivots are counted, and pairs with enough of them are verified by cosine in double precision.

How many pivots there are and how many describe a vector is fitted, not fixed: on the sample that the pivots
come from, pairs that link, and vectors turned towards their neighbours and at random until they just link, must
share enough pivots (``recall`` of each kind, 0.99 by default).  Vectors in few tight clusters so get few
pivots, which all of a cluster share; spread ones get many.  With no more pivots than describe a vector no pair is lost.

Inputs: (vec_id, embedding, label); other columns are ignored.  Only vectors of equal, non-null label (and
equal length) are compared; a vector that is null, empty, zero or has null or non-finite components links
with nothing.  Equal vectors are one class before anything is compared, and each counts as a link of the
others.  A repeated vec_id counts as another vector in links.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

FIT_ROWS = 4096  # the pivots are fitted on so many vectors at most: those with the least hash of their components
NEAR, SHARED = (8, 12, 16), 2  # pivots that describe a vector: the least number that reaches the recall
RECALL = 0.99
BLOCK = 1024
CLASS = "label int, dim int, embedding array<float>, rep long, copies long"


def usable(embedding):
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(
        embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(
        embedding, lambda x: x != 0)


def classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct (label, vector): its smallest vec_id and its number of rows."""
    return vectors.where("label is not null").where(usable(F.col("embedding"))) \
        .groupBy("label", F.size("embedding").alias("dim"), "embedding") \
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm of large components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the ``near`` pivots nearest to each vector, nearest first; ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near]


def hard_pairs(x: np.ndarray, labels: np.ndarray, cosine: float, most: int = FIT_ROWS // 2,
               seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """(left, right) unit vectors that just link, by kind, at most ``most`` of each.

    Linked pairs of the sample (where there are 100), and vectors turned to the threshold: towards the nearest vector
    of the sample below it, towards another of the nearest 32, and in a random direction.
    """
    rng = np.random.default_rng(seed)
    some = rng.permutation(len(x))[:most]
    cos = x[some] @ x.T
    linked = (cos >= cosine) & (labels[some][:, None] == labels[None, :])
    linked[np.arange(len(some)), some] = False
    i, j = np.nonzero(linked)
    pick = rng.permutation(len(i))[:most]
    out = [(x[some[i[pick]]], x[j[pick]])] if len(pick) >= 100 else []
    cos[cos >= cosine] = -2  # what is nearer already needs no turning
    order = np.argsort(-cos, axis=1, kind="stable")[:, :32]
    part = x[some]
    for other in (x[order[:, 0]], x[order[np.arange(len(some)), rng.integers(0, order.shape[1], len(some))]],
                  rng.normal(size=part.shape)):
        side = other - (other * part).sum(1, keepdims=True) * part
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        ok = norm[:, 0] > 1e-9
        if ok.any():
            out.append((part[ok], cosine * part[ok] + np.sqrt(1 - cosine * cosine) * side[ok] / norm[ok]))
    return out


def common_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with the same row of ``b``; a row holds none twice."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(1)


def fit_pivots(reps: DataFrame, pivots: int, cosine: float, shared: int = SHARED, recall: float = RECALL,
               near: int | None = None, rows: int = FIT_ROWS) -> dict[int, tuple[np.ndarray, int]]:
    """Per length, (pivots, how many describe a vector), from a bounded sample.

    The pivots are spread over the sample: each is the farthest from those before it, so fewer of them are its
    first ones.  The number is halved until at most max(NEAR) of them describe a vector at the recall asked for;
    a given ``near`` is taken as it is.
    """
    got = reps.select("dim", "label", "embedding").orderBy(F.xxhash64("embedding"), "embedding", "label").limit(rows) \
        .toPandas()
    out = {}
    for dim, part in got.groupby("dim"):
        x = unit(part["embedding"])
        pick, best = [0], x @ x[0]
        while len(pick) < min(pivots, len(x)):
            pick.append(int(best.argmin()))
            best = np.maximum(best, x @ x[pick[-1]])
        if near is not None:
            out[int(dim)] = x[pick], near
            continue
        pairs = hard_pairs(x, part["label"].to_numpy(), cosine)
        n = len(pick)
        while int(dim) not in out:
            kinds = [[nearest(y, x[pick[:n]], max(NEAR)) for y in pair] for pair in pairs]
            fits = [k for k in NEAR if n <= k or all(
                (common_pivots(a[:, :k], b[:, :k]) >= shared).mean() >= recall for a, b in kinds)]
            if fits:
                out[int(dim)] = x[pick[:n]], min(fits[0], n)
            n //= 2
    return out


def index(reps: DataFrame, pivots: dict[int, tuple[np.ndarray, int]], shared: int) -> DataFrame:
    """The inverted lists: a row per vector and list, with the vector's nearest pivots in pivot order."""
    held = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                # a length the sample lacks: one list for all
                p, near = held.value.get(int(dim), (np.eye(1, int(dim)), 1))
                best = np.sort(nearest(unit(part["embedding"]), p, near), axis=1)
                lists = best[:, :max(best.shape[1] - shared + 1, 1)]
                out = part.loc[part.index.repeat(lists.shape[1])].copy()
                out["pivot"] = lists.ravel()
                out["nearest"] = list(np.repeat(best, lists.shape[1], axis=0).astype(np.int32))
                yield out

    return reps.mapInPandas(run, CLASS + ", pivot int, nearest array<int>")


def roots(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each member the least member it reaches over ``near`` (left x right)."""
    label = np.arange(max(left.max(), right.max()) + 1)
    while True:
        old = label.copy()
        a = np.where(near, label[right][None, :], len(label)).min(1, initial=len(label))
        np.minimum.at(label, left, a)
        b = np.where(near, label[left][:, None], len(label)).min(0, initial=len(label))
        np.minimum.at(label, right, b)
        if (label == old).all():
            return label


def shared_counts(described: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int) -> np.ndarray:
    """Shared pivots of each pair that meets first in the list of ``pivot``: 0 for pairs of an earlier list.

    Counted by running through the inverted lists of the two blocks' pivots, a list at a time.
    """
    count = np.zeros((len(left), len(right)), np.uint8)

    def lists(rows):
        flat = described[rows].ravel()
        order = np.argsort(flat, kind="stable")
        keys, start = np.unique(flat[order], return_index=True)
        return dict(zip(keys.tolist(), np.split(order // described.shape[1], start[1:])))

    a, b = lists(left), lists(right)
    both = sorted(a.keys() & b.keys())
    for p in (p for p in both if p >= pivot):
        count[np.ix_(a[p], b[p])] += 1
    for p in (p for p in both if p < pivot):
        count[np.ix_(a[p], b[p])] = 0
    return count


def alike(embedding, left: np.ndarray, right: np.ndarray, ask: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs asked for reach the cosine, in double precision; few pairs are computed one by one."""
    i, j = np.nonzero(ask)
    out = np.zeros_like(ask)
    if not len(i):
        return out
    x = unit(embedding)
    if 16 * len(i) > ask.size:
        return ask & (x[left] @ x[right].T >= cosine)
    for s in range(0, len(i), 65_536):
        a, b = i[s:s + 65_536], j[s:s + 65_536]
        out[a, b] = np.einsum("ij,ij->i", x[left[a]], x[right[b]]) >= cosine
    return out


def list_links(lists: DataFrame, cosine: float, shared: int) -> DataFrame:
    """(rep, links, root): links that one pair of blocks of one list finds for a vector, and a vector it reaches.

    A list is cut into blocks of about BLOCK rows that meet pair by pair.  A pair of vectors is handled in
    the list of its first shared pivot only, so each link counts once; what a block pair returns is a row
    per vector, not per link.
    """
    keys = ["label", "dim", "pivot"]
    size = lists.groupBy(*keys).agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
    rows = lists.join(size, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")) \
        .drop("blocks", "other")

    def run(pdf):
        none = pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")
        block, pivot = pdf["block"].to_numpy(), pdf["pivot"].iloc[0]
        left = np.flatnonzero(block == pdf["i"].to_numpy())
        right = np.flatnonzero(block == pdf["j"].to_numpy())
        if not len(left) or not len(right):
            return none
        described = np.stack(pdf["nearest"].to_list())
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        count = shared_counts(described, left, right, pivot)
        count[ids[left][:, None] == ids[right][None, :]] = 0
        near = alike(pdf["embedding"], left, right, count >= min(shared, described.shape[1]), cosine)
        links = np.zeros(len(pdf), np.int64)
        links[left] += near.astype(np.int64) @ copies[right]
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            links[right] += near.T.astype(np.int64) @ copies[left]
        root = roots(near, left, right)
        hit = links > 0
        return pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    return rows.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, near: int | None = None, shared: int = SHARED,
                 pivots: int | None = None, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    At most ``pivots`` are used, by default the square root of the number of classes, 128 at least and
    FIT_ROWS / 2 at most, so that lists grow as slowly as they can with a pivot table of bounded size; as many of
    them as keep the ``recall`` are, with ``near`` of them a vector (fitted where None).
    """
    reps = written(classes(vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label")))
                   .select("label", "dim", "embedding", "rep", "copies"), "pivot-classes")
    n = reps.count()
    fitted = fit_pivots(reps, pivots or int(min(max(128, n ** 0.5), FIT_ROWS // 2)), cosine, shared, recall, near)
    lists = written(index(reps, fitted, shared), "pivot-lists")
    links = written(list_links(lists, cosine, shared), "pivot-links")
    comp = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = reps.join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left") \
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    mine = vectors.select("vec_id", F.col("label").cast("int").alias("label"),
                          F.when(usable(F.col("embedding")), F.col("embedding")).alias("embedding"))
    return mine.join(counted.hint("merge"), ["label", "embedding"], "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.expr("vec_id = component_id"))


def op1_pivot_index(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT vec_id, vec_id AS x FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.x),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
m AS (SELECT vec_id, min(x) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM m LEFT JOIN n USING (vec_id)
"""
