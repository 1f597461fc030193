"""Language-model scores from Elias-Fano n-gram tries.

The model is a trigram model of words with Dirichlet smoothing (each order's counts are added to ``mu`` times
the order below): p(c | a b) = (n(abc) + mu p(c | b)) / (n(ab) + mu), likewise p(c | b), and p(c) adds one to
the counts of words.  Written as weight(ab) * (n(abc) / mu + p(c | b)), its two factors can be kept apart: a
trigram's node holds the quantised logarithm of the sum, a bigram's node that of its p and of its weight
as a context.

A shard of the trie holds the nodes of some middle words b, which have two kinds of children: the words c
that follow b, and, as contexts, the words a before b.  A context's successors are not words but their
ranks among the followers of b, small numbers.  Every level is a monotone Elias-Fano sequence (each
range of children goes on from the last value before it) with Elias-Fano pointers to its ranges; the
levels are flat buffers that are read in place, by selects and a binary search in a bucket.

Work goes by blocks of documents, each coded once with numbers of its own and kept in a bucketed table in the
shared folder, so that what comes back to a block meets it without moving it.  A block sends its distinct words to the shards of words, which count them and answer with counts
and numbers; then its distinct trigrams to the shards of middle words (a frequent middle word is dealt out
further, by the word that follows).  A shard sums the counts of learned documents, builds its part of the
trie, and answers every block's list with codes of a byte or two.  Nothing is broadcast, pruned or
collected but N, V and numbers of rows; what is shuffled grows with the distinct trigrams of blocks.

Inputs: (doc_id, text); other columns are ignored.  Null and empty texts hold the end only.  Each row is a
document of its own, also when doc_id repeats; a null doc_id is learned from.  Words are told apart
by a hash of 64 bits.  Without learned documents every probability is one.  Empty tables give no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.session import scratch_path

from .common import U64, mix, table, written

BLOCK, SHARD = 3 << 18, 3 << 18  # tokens of a block of documents, and of a shard, about
MU = 2.0, 3.0  # of bigrams and trigrams
OFFSET, STEP = 20.0, 256  # a code is (log10 + OFFSET) * STEP in 16 bits
START = 0  # the number of what stands before a text; words' numbers begin at 1
END = b""  # the word that ends a text; no word of a text is empty
SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.int64)


def pack(*arrays) -> bytes:
    """Whole numbers from 0, each array as planes of its lowest, second, ... bytes; compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        out += [np.array([len(a), width], "<u8").tobytes(), a.view(np.uint8).reshape(-1, 8).T[:width].tobytes()]
    return zstandard.compress(b"".join(out), 3)


def unpack(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(raw), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u8", 2, at).tolist()
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += 16 + n * width
    return out


def code(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((v + OFFSET) * STEP), 0, 65535).astype("<u2")


def decode(c: np.ndarray) -> np.ndarray:
    return c.astype(np.float64) / STEP - OFFSET


# the trie

class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with the number of ones before each 64."""

    def __init__(self, raw):
        self.n, self.l, low, high = np.frombuffer(raw, "<u8", 4).tolist()
        self.low = np.ndarray((max(low - 7, 0),), "<u8", raw, 32, (1,))  # a word from each byte on
        self.high = np.frombuffer(raw, "<u8", high, 32 + low)
        self.ones = np.frombuffer(raw, "<u4", high, 32 + low + 8 * high).astype(np.int64)
        self.zeros = 64 * np.arange(high) - self.ones

    @staticmethod
    def of(values: np.ndarray) -> bytes:
        v = np.asarray(values, U64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        low = [np.packbits((v[s:s + 65536, None] >> np.arange(l, dtype=U64) & U64(1)).astype(np.uint8), bitorder="little")
               .tobytes() for s in range(0, n if l else 0, 65536)]
        low = b"".join(low)
        low += bytes(16 - len(low) % 8)  # words can be read up to the last byte
        size = n + (top >> l) + 1
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[(v >> U64(l)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return np.array([n, l, len(low), len(high)], "<u8").tobytes() + low + high.tobytes() + ones.astype("<u4").tobytes()

    @staticmethod
    def select(words, before, k):
        """The place of the k-th one of ``words``, ``before`` counting the ones before each."""
        w = np.searchsorted(before, k, "right") - 1
        word, k, at = words[w], k - before[w], w * 64
        for shift in (32, 16, 8):
            low = word & U64((1 << shift) - 1)
            c = np.bitwise_count(low).astype(np.int64)
            on = k >= c
            k, at = k - c * on, at + shift * on
            word = np.where(on, word >> U64(shift), low)
        return at + SELECT[word.astype(np.int64), k]

    def low_bits(self, i):
        if not self.l:
            return np.zeros(len(i), U64)
        bit = i * self.l
        return self.low[bit >> 3] >> (bit & 7).astype(U64) & U64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(self.high, self.ones, i) - i) << self.l) | self.low_bits(i).astype(np.int64)

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - i
        return (high << self.l) | self.low_bits(i).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where ``x`` is, of a strictly increasing sequence; -1: nowhere."""
        out = np.full(len(x), -1)
        if not self.n:
            return out
        bucket = x >> self.l
        ask = np.flatnonzero(bucket <= int(self.get(np.array([self.n - 1]))[0]) >> self.l)
        bucket, want = bucket[ask], x[ask].astype(U64) & U64((1 << self.l) - 1)
        zeros = ~self.high  # a zero ends each bucket: its ones are between two zeros
        bit = np.where(bucket > 0, self.select(zeros, self.zeros, np.maximum(bucket - 1, 0)) + 1, 0)
        lo, rest = bit - bucket, zeros[bit >> 6] >> (bit & 63).astype(U64)
        ones = np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)  # up to the next zero of this word
        beyond = np.flatnonzero(rest == 0)
        ones[beyond] = self.select(zeros, self.zeros, bucket[beyond]) - bit[beyond]
        end = lo + ones
        some = lo < end
        ask, want, lo, hi = ask[some], want[some], lo[some], end[some] - 1
        while len(ask):  # the value is in lo to hi, if anywhere
            mid = (lo + hi) >> 1
            low = self.low_bits(mid)
            hit = low == want
            out[ask[hit]] = mid[hit]
            less = low < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid - 1)
            on = ~hit & (lo <= hi)
            ask, want, lo, hi = ask[on], want[on], lo[on], hi[on]
        return out


class Level:
    """Children of nodes: ranges of increasing values, one after another, each going on from the last one before."""

    def __init__(self, raw):
        n, m = np.frombuffer(raw, "<u8", 2).tolist()
        self.values = EliasFano(raw[16 + n + m:])
        self.start, self.base = EliasFano(raw[16:16 + n]).all(), EliasFano(raw[16 + n:16 + n + m]).all()

    @staticmethod
    def of(parent: np.ndarray, value: np.ndarray, parents: int) -> bytes:
        """``parent`` (sorted) and ``value`` (increasing for a parent, from 0) of each child."""
        start = np.searchsorted(parent, np.arange(parents + 1))
        has = np.diff(start) > 0
        most = np.zeros(parents, np.int64)
        most[has] = value[start[1:][has] - 1] + 1
        base = np.cumsum(most) - most
        pointers, bases = EliasFano.of(start), EliasFano.of(base)
        return np.array([len(pointers), len(bases)], "<u8").tobytes() + pointers + bases \
            + EliasFano.of(value + base[parent])

    def find(self, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The child of ``parent`` with ``value``; -1: none, also for parent -1."""
        out = np.full(len(parent), -1)
        ask = np.flatnonzero(parent >= 0)
        if len(ask) and self.values.n:
            up = parent[ask]
            at = self.values.find(value[ask] + self.base[up])
            out[ask] = np.where((at >= self.start[up]) & (at < self.start[up + 1]), at, -1)
        return out


class Trie:
    """A shard's levels, mapped from their buffers."""

    def __init__(self, levels: dict[str, bytes]):
        self.root = EliasFano(levels["root"])
        self.followers, self.contexts, self.successors = (Level(levels[k]) for k in ("followers", "contexts", "successors"))
        self.p2, self.weight, self.p3 = (np.frombuffer(levels[k], "<u2") for k in ("p2", "weight", "p3"))

    @staticmethod
    def levels(b, c, p2_of, pair, a, n, mu: float) -> dict[str, bytes]:
        """From lists: pairs (b, c), with ``p2_of`` (counts of pairs, places in the lists) -> p(c | b), and trigrams
        (pair, a) that occur ``n`` times.  Pairs and trigrams may repeat; those of n = 0 are not learned."""
        use = n > 0
        pair, a, n = pair[use], a[use], n[use].astype(np.float64)
        roots = np.unique(b[pair])
        root = np.searchsorted(roots, b[pair])
        pairs, some, at = np.unique(root << 40 | c[pair], return_index=True, return_inverse=True)
        n_pair = np.bincount(at, n, len(pairs))
        first = np.searchsorted(pairs >> 40, np.arange(len(roots)))
        contexts, ctx = np.unique(root << 40 | a, return_inverse=True)
        grams, gram = np.unique(ctx << 32 | (at - first[root]), return_inverse=True)
        n_gram = np.bincount(gram, n, len(grams))
        follower = np.zeros(len(grams), np.int64)
        follower[gram] = at
        p2 = p2_of(n_pair, pair[some])
        mask = (1 << 40) - 1
        return {"root": EliasFano.of(roots), "followers": Level.of(pairs >> 40, pairs & mask, len(roots)),
                "contexts": Level.of(contexts >> 40, contexts & mask, len(roots)),
                "successors": Level.of(grams >> 32, grams & ((1 << 32) - 1), len(contexts)),
                "p2": code(np.log10(p2)).tobytes(), "weight": code(np.log10(mu / (n_pair + mu))).tobytes(),
                "p3": code(np.log10(n_gram / mu + decode_p(code(np.log10(p2)))[follower])).tobytes()}

    def ask(self, b, times, c, p2_none, pair, a):
        """Codes of trigrams (pair, a), and of the weights of pairs as contexts; the next ``times`` c follow each b."""
        root = np.repeat(self.root.find(b), times)
        node = self.followers.find(root, c)
        p2, weight = code(np.log10(p2_none)), np.full(len(c), code(np.zeros(1))[0])
        p2[node >= 0], weight[node >= 0] = self.p2[node[node >= 0]], self.weight[node[node >= 0]]
        seen = np.flatnonzero(node[pair] >= 0)
        first = np.zeros(len(c), np.int64)
        first[root >= 0] = self.followers.start[root[root >= 0]]
        p3, up = p2[pair], pair[seen]
        at = self.successors.find(self.contexts.find(root[up], a[seen]), node[up] - first[up])
        p3[seen[at >= 0]] = self.p3[at[at >= 0]]
        return p3, weight


def decode_p(c):
    return 10.0 ** decode(c)


# blocks of documents

class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, held_out, tokens: int = BLOCK) -> DataFrame:
    """(block, ids, held, stream, words, n_words, n_tokens): coded documents, and each block's words by hash and count.

    ``words`` is in order of hash, held as differences; the stream tells which number each has in the block.
    """
    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())),
                            ("stream", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

        def fresh():
            return Numbers({END: 0}), [], [], [], []

        def row():
            stream, n = np.concatenate(coded), np.array([len(x) for x in coded])
            count = np.bincount(stream, np.repeat(~np.array(held), n), len(number))
            hashes = np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in number), "<u8")
            order = np.argsort(hashes)
            return pa.RecordBatch.from_pylist([{
                "block": base + k, "ids": ids, "held": held, "stream": pack(stream, n, order),
                "words": pack(np.diff(hashes[order], prepend=U64(0)), count[order]),
                "n_words": len(number), "n_tokens": len(stream)}], schema)

        number, ids, held, coded, _ = fresh()
        size = 0
        for batch in batches:
            for i, out, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                said = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                said.append(END)
                ids.append(i.as_py())
                held.append(out.as_py())
                coded.append(np.fromiter(map(number.__getitem__, said), np.uint32, len(said)))
                size += len(said)
                if size >= tokens:
                    yield row()
                    number, ids, held, coded, _ = fresh()
                    size, k = 0, k + 1
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("string"), F.coalesce(held_out, F.lit(False)), "text").mapInArrow(
        run, "block long, ids array<string>, held array<boolean>, stream binary, words binary, n_words long, n_tokens long")


def count_words(coded: DataFrame, shards: int) -> DataFrame:
    """(block, shard, answer, v, n): numbers and learned counts of each block's words; v and n for the shard's first row."""
    def ask(batches):
        schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("list", pa.binary())])
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step, count = unpack(raw)
                hashes = np.cumsum(step, dtype=U64)
                cuts = np.searchsorted((hashes >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64))
                for s in range(shards):
                    at = slice(cuts[s], cuts[s + 1])
                    if at.start < at.stop:
                        yield pa.RecordBatch.from_pylist([{"shard": s, "block": block, "list": pack(
                            np.diff(hashes[at], prepend=U64(0)), count[at])}], schema)

    def answer(pdf):
        got, shard = [unpack(x) for x in pdf["list"]], int(pdf["shard"].iloc[0])
        words, at = np.unique(np.concatenate([np.cumsum(h, dtype=U64) for h, _ in got]), return_inverse=True)
        count = np.bincount(at, np.concatenate([c for _, c in got]), len(words)).astype(np.int64)
        cuts = np.cumsum([len(h) for h, _ in got])[:-1]
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))  # small numbers for frequent words
        out = [pack(rank[x] * shards + shard + 1, count[x]) for x in np.split(at, cuts)]
        first = np.arange(len(got)) == 0
        return pd.DataFrame({"block": pdf["block"], "shard": shard, "answer": out, "v": first * int((count > 0).sum()),
                             "n": first * int(count.sum())})

    return coded.select("block", "words").mapInArrow(ask, "shard long, block long, list binary") \
        .groupBy("shard").applyInPandas(answer, "block long, shard long, answer binary, v long, n long")


def by_shard(shard: np.ndarray, shards: int):
    """Numbers in order of shard, and where each shard's begin."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def distinct_grams(b: np.ndarray, c: np.ndarray, a: np.ndarray, base: int):
    """(pairs, pair, up, first, gram) of trigrams a b c, numbers below ``base``: the distinct pairs b * base + c, the pair
    of each trigram, and of the distinct trigrams the pair and the a, and the place of each trigram among them."""
    if base ** 3 < 1 << 63:  # one sort for both
        key = (b * base + c) * base + a
        order = np.argsort(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        key = key[new]
        over = key // base
        other = np.r_[True, over[1:] != over[:-1]]
        up, gram = np.cumsum(other) - 1, np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        return over[other], up[gram], up, key - over * base, gram
    pairs, pair = np.unique(b * base + c, return_inverse=True)
    grams, gram = np.unique(pair * base + a, return_inverse=True)
    return pairs, pair, grams // base, grams % base, gram


class Grams:
    """A block's distinct pairs and trigrams, in the order in which shards are asked."""

    def __init__(self, stream: bytes, answers: list[bytes], shards: int, total: int):
        self.tokens, self.n, order = (x.astype(np.int64) for x in unpack(stream))
        got = [unpack(x) for x in answers]
        size = len(order)
        self.number, self.count = np.full(size + 1, START, np.int64), np.zeros(size + 1, np.int64)
        self.number[order], self.count[order] = (np.concatenate(x).astype(np.int64) for x in zip(*got))
        self.count[size] = self.count[0]  # as many texts begin as end
        self.first = np.cumsum(self.n) - self.n
        before = np.r_[size, self.tokens[:-1]]
        before[self.first] = size
        two = np.r_[size, before[:-1]]
        two[self.first] = size
        base = size + 1
        pairs, pair, up, two, self.gram = distinct_grams(before, self.tokens, two, base)
        b, c = pairs // base, pairs % base
        # a middle word of more than a quarter of a shard's tokens is dealt out by the word that follows
        parts = 1 + 4 * self.count[b] * shards // max(total, 1)
        part = (mix(self.number[c].astype(U64)) % parts.astype(U64)).astype(U64)
        shard = (mix(self.number[b].astype(U64) * U64(0x9E3779B97F4A7C15) + part) % U64(shards)).astype(np.int64)
        order, self.pair_cuts = by_shard(shard, shards)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.b, self.c, self.pair = b[order], c[order], place[pair]
        above = place[up]
        order = np.argsort(above, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.a, self.above, self.gram = two[order], above[order], place[self.gram]
        self.gram_cuts = np.searchsorted(self.above, self.pair_cuts)

    def lists(self, held: np.ndarray):
        """(shard, list) for each shard that has something to count or to answer."""
        learned = np.bincount(self.gram, np.repeat(~held, self.n), len(self.a))
        for s in range(len(self.pair_cuts) - 1):
            p, g = slice(*self.pair_cuts[s:s + 2]), slice(*self.gram_cuts[s:s + 2])
            if p.start == p.stop:
                continue
            b, c = self.b[p], self.c[p]
            new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])  # pairs of a middle word stand together
            yield s, pack(self.number[b[new]], self.count[b[new]], np.diff(np.r_[new, len(b)]), self.number[c], self.count[c],
                          np.bincount(self.above[g] - p.start, minlength=len(b)), self.number[self.a[g]], learned[g])


def answer_lists(lists: list[bytes], n: int, v: int, mu) -> list[bytes]:
    """A shard's part of the trie, built from the lists of all blocks, and its codes for each list."""
    parts, sizes, offset = [], [], 0
    for raw in lists:
        b, n_b, times, c, n_c, grams, a, learned = (x.astype(np.int64) for x in unpack(raw))
        parts.append((b, times, np.repeat(n_b, times), c, n_c, np.repeat(np.arange(len(c)), grams) + offset, a, learned))
        sizes.append((len(c), len(a)))
        offset += len(c)
    b, times, n_b, c, n_c, pair, a, learned = (np.concatenate(x) for x in zip(*parts))
    del parts
    p1 = (n_c + 1) / (n + v + 1)

    def p2(n_pair, at):
        return (n_pair + mu[0] * p1[at]) / (n_b[at] + mu[0])

    trie = Trie(Trie.levels(np.repeat(b, times), c, p2, pair, a, learned, mu[1]))
    p3, weight = trie.ask(b, times, c, p2(0, slice(None)), pair, a)
    cuts = np.cumsum(sizes, axis=0)[:-1]
    return [pack(x, y) for x, y in zip(np.split(p3, cuts[:, 1]), np.split(weight, cuts[:, 0]))]


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder in buckets of ``key``: grouping by it later needs no shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key) \
        .option("path", path).saveAsTable(table_name)
    return spark.table(table_name)


RESULT = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out, mu: tuple[float, float] = MU, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out``: condition on doc_id (null: false) of what is scored but not learned.
    """
    coded = bucketed(blocks(docs, held_out, block), "block", "lm-blocks")
    words, tokens = coded.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_shards, shards = (max(1, -(-(x or 0) // shard)) for x in (words, tokens))
    known = written(count_words(coded, word_shards), "lm-words")
    v, n = (x or 0 for x in known.agg(F.sum("v"), F.sum("n")).first())

    def grams(left, right):
        row = left.iloc[0]
        said = right[right["kind"] == 0].sort_values("shard")["answer"].tolist()
        return row, Grams(row["stream"], said, shards, n)

    def ask(left, right):
        row, g = grams(left, right)
        got = [(s, int(row["block"]), x) for s, x in g.lists(np.array(row["held"], bool))]
        return pd.DataFrame(got, columns=["shard", "block", "list"])

    def answer(pdf):
        return pd.DataFrame({"kind": 1, "block": pdf["block"], "shard": pdf["shard"],
                             "answer": answer_lists(pdf["list"].tolist(), n, v, mu)})

    def score(left, right):
        row, g = grams(left, right)
        got = [unpack(x) for x in right[right["kind"] == 1].sort_values("shard")["answer"]]
        p3, weight = (decode(np.concatenate(x)) for x in zip(*got))
        context = np.r_[0.0, weight[g.pair[:-1]]]
        context[g.first] = np.log10(mu[1] / (g.count[0] + mu[1]))  # a text's first word follows two starts
        count = g.count[g.tokens]
        base = np.log10((count + 1) / (n + v + 1))
        sums = (np.add.reduceat(x, g.first) for x in (p3[g.gram] + context, base, (count > 0).astype(np.int64)))
        total, base, seen = sums
        return pd.DataFrame({"doc_id": row["ids"], "held_out": row["held"], "n_tokens": g.n, "n_known": seen,
                             "train_tokens": n, "base_score": base, "score": total})

    said = known.select(F.lit(0).alias("kind"), "block", "shard", "answer")
    coded = coded.select("block", "ids", "held", "stream")
    asked = coded.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(ask, "shard long, block long, list binary")
    codes = written(asked.groupBy("shard").applyInPandas(answer, "kind int, block long, shard long, answer binary"), "lm-codes")
    out = coded.groupBy("block").cogroup(said.union(codes).groupBy("block")).applyInPandas(score, RESULT)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op13_elias_fano_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
