"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In a chunk every byte becomes
a small learned vector, learned filters slide over them, and each filter's rectified outputs are
max-pooled (and averaged) over the chunk; a hidden layer makes one number of the pooled values.  The
text's chunk numbers are combined, by their mean and their lowest, into one probability.

Inputs: documents (doc_id, text) and labels (doc_id, quality 0/1); other columns are ignored.  The network
is fitted by gradient descent on a bounded sample of labelled rows (PER_CLASS rows of each class, of each
the CHUNKS chunks of least hash); it scores whole texts.  Null and empty texts are one empty chunk.  Rows
with null quality teach nothing; without rows of both classes every score is the share of class 1 (0.5 without any).
Repeated rows are scored alike.  Empty tables give no rows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_exact, table
from .langid import held_out

CHUNK, STEP = 128, 112
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 2, 32, 16
PER_CLASS, CHUNKS, EPOCHS, SEED = 1500, 8, 14, 7
AT_ONCE = 2048
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunk_starts(n: int) -> range:
    return range(0, max(n - (CHUNK - STEP), 1), STEP)


def chunks_of(data: bytes, starts) -> np.ndarray:
    """The chunks at ``starts``, padded with zeros at the text's end."""
    starts = np.asarray(starts)
    lo = int(starts[0])
    part = np.frombuffer(data[lo:int(starts[-1]) + CHUNK].ljust(int(starts[-1]) - lo + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(part, CHUNK)[starts - lo]


class Network:
    """Parameters by name; ``forward`` gives a number per chunk, ``score`` one probability per text."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, 0.2, (WIDTH * EMBED, FILTERS)),
                  "fb": np.zeros(FILTERS), "hidden": r.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "hb": np.zeros(HIDDEN),
                  "out": r.normal(0, 0.3, HIDDEN), "ob": np.zeros(1), "mean": np.ones(1), "low": np.full(1, 0.5),
                  "bias": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, chunks: np.ndarray):
        p, n = self.p, len(chunks)
        x = p["embed"][chunks].reshape(n, CHUNK * EMBED)
        win = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
        win = np.ascontiguousarray(win).reshape(n * POSITIONS, WIDTH * EMBED)
        act = (win @ p["filters"]).reshape(n, POSITIONS, FILTERS)
        act += p["fb"]
        np.maximum(act, 0, out=act)
        pooled = np.concatenate([act.max(1), act.mean(1)], 1)
        hid = np.maximum(pooled @ p["hidden"] + p["hb"], 0)
        return hid @ p["out"] + p["ob"], (win, act, pooled, hid)

    def backward(self, chunks, kept, grad):
        """Gradients of all but the combining parameters, from that of each chunk's number."""
        p, (win, act, pooled, hid), n = self.p, kept, len(chunks)
        g = {"out": hid.T @ grad, "ob": grad.sum(keepdims=True)}
        gh = grad[:, None] * p["out"] * (hid > 0)
        g |= {"hidden": pooled.T @ gh, "hb": gh.sum(0)}
        gp = gh @ p["hidden"].T
        ga = np.repeat(gp[:, None, FILTERS:] / POSITIONS, POSITIONS, 1)
        top = act.argmax(1)
        np.put_along_axis(ga, top[:, None], np.take_along_axis(ga, top[:, None], 1) + gp[:, None, :FILTERS], 1)
        ga *= act > 0
        ga = ga.reshape(-1, FILTERS)
        g |= {"filters": win.T @ ga, "fb": ga.sum(0)}
        gw = (ga @ p["filters"].T).reshape(n, POSITIONS, WIDTH, EMBED)
        gx = np.zeros((n, CHUNK, EMBED), np.float32)
        for k in range(WIDTH):
            gx[:, k:k + POSITIONS * STRIDE:STRIDE] += gw[:, :, k]
        ge = np.zeros((256, EMBED), np.float32)
        np.add.at(ge, chunks.ravel(), gx.reshape(-1, EMBED))
        return g | {"embed": ge}

    def combine(self, mean, low):
        return self.p["mean"] * mean + self.p["low"] * low + self.p["bias"]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Whole texts, AT_ONCE chunks at a time."""
        n = len(texts)
        total, count, low = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        held, owner = [], []

        def flush():
            if held:
                z, of = self.forward(np.concatenate(held))[0], np.concatenate(owner)
                np.add.at(total, of, z)
                np.add.at(count, of, 1)
                np.minimum.at(low, of, z)
                held.clear()
                owner.clear()

        size = 0
        for i, t in enumerate(texts):
            data = t.encode("utf-8", "surrogatepass")
            starts = chunk_starts(len(data))
            for s in range(0, len(starts), AT_ONCE):
                part = starts[s:s + AT_ONCE]
                held.append(chunks_of(data, part))
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        z = self.combine(total / np.maximum(count, 1), low)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(sample: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 64) -> Network:
    """Adam on the cross entropy of (label, chunks of a text), classes weighing the same."""
    net, r = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    label = np.array([y for y, _ in sample], np.float32)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
    step, steps = 0, max(1, epochs * -(-len(sample) // batch))
    for _ in range(epochs):
        order = r.permutation(len(sample))
        for s in range(0, len(order), batch):
            ids = order[s:s + batch]
            chunks = np.concatenate([sample[i][1] for i in ids])
            n = np.array([len(sample[i][1]) for i in ids])
            cut = np.cumsum(n) - n
            z, kept = net.forward(chunks)
            mean, low = np.add.reduceat(z, cut) / n, np.minimum.reduceat(z, cut)
            prob = 1 / (1 + np.exp(-np.clip(net.combine(mean, low), -30, 30)))
            gz = ((prob - label[ids]) * weight[ids] / len(ids)).astype(np.float32)
            of = np.repeat(np.arange(len(ids)), n)
            is_low = z == low[of]
            ties = np.add.reduceat(is_low.astype(np.float32), cut)
            grad = gz[of] * (net.p["mean"] / n[of] + net.p["low"] * is_low / ties[of])
            g = net.backward(chunks, kept, grad.astype(np.float32))
            g |= {"mean": np.array([(gz * mean).sum()]), "low": np.array([(gz * low).sum()]), "bias": np.array([gz.sum()])}
            step += 1
            rate = 0.006 * (1 - step / (steps + 1))
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, np.ndarray]]:
    """Bounded: the ``per_class`` labelled rows of least hash in each class, CHUNKS chunks of each."""
    clean = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    spark, ids = docs.sparkSession, []
    for q in (0, 1):  # only documents that exist can be learned from; ids alone cross the driver
        ids += [(r["doc_id"], q) for r in clean.where(F.col("quality") == q)
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return []
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int"))

    def cut(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                data = (t or "").encode("utf-8", "surrogatepass")
                starts = sorted(sorted(chunk_starts(len(data)), key=lambda s: crc32(b"%d" % s))[:CHUNKS])
                out.append(b"".join(chunks_of(data, [s]).tobytes() for s in starts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "chunks": out})

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(
        cut, "doc_id long, quality int, chunks binary").toPandas().sort_values(["doc_id", "quality", "chunks"])
    return [(int(q), np.frombuffer(c, np.uint8).reshape(-1, CHUNK))
            for q, c in zip(rows["quality"], rows["chunks"], strict=True)]


def score_quality(docs: DataFrame, sample: list[tuple[int, np.ndarray]], keep: list[str],
                  threshold: float = 0.3) -> DataFrame:
    """``docs``'s columns ``keep`` with score and predicted."""
    classes = {y for y, _ in sample}
    net = fit(sample) if len(classes) == 2 else float(classes.pop()) if classes else 0.5
    held = docs.sparkSession.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for pdf in batches:
            score = held.value.scores([t or "" for t in pdf["_text"]]) if isinstance(held.value, Network) \
                else np.full(len(pdf), held.value)
            yield pdf[keep].assign(score=score.astype(float), predicted=(score >= threshold).astype(np.int32))

    return map_exact(docs.select(*keep, F.col("text").alias("_text")), run, fields + ", score double, predicted int")


def op2_quality_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sample = training_sample(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out(5, 0)))
    return score_quality(docs.withColumn("held_out", held_out(5, 0)), sample, ["doc_id", "held_out"])
