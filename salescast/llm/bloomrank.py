"""Ranked lexical search by bit-sliced Bloom signatures.

Every document's terms go into a Bloom signature, and signatures of documents of about the same number of
terms are stored together, transposed: slice b of a block is a bitmap of the documents whose bit b is set.
A term that occurs tf times is entered once for each power of two up to tf, so the AND of a term's slices
overestimates which documents hold it, and those of its powers how often.  Weighted sums of these bitmaps
give every document an upper bound of its score for a query.  The best few by that bound are scored exactly;
the tenth best of them is a score that a result must reach.  All documents whose bound reaches it are then
scored exactly, so no other document can be in the result.

The index is made without a shuffle, block by block, and knows nothing of queries.  Queries are taken in
blocks of at most BLOCK_BYTES of terms, which alone are broadcast.  Of documents with the same text
only the ``top`` smallest ids are scored for a query, as no more of them can be in its result.

Inputs: documents (doc_id, text), queries (item_id, text); other columns are ignored.  Null texts, and texts
without a term, match nothing; each row of queries is a query of its own and each row of documents a
document; equal scores go by doc_id (null first).  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, mix, table, written

# Fixed by the contract: what separates terms, and A-Z lower-cased.
TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
             for c in range(256))
B, SCALE, SATURATION = 90, 1_000_000_000, 8
HASHES, BITS = 4, 8  # slices per entry; signature bits per entry, at least
CELLS = 1 << 25  # bits of a block
MOST_DOCS = 1 << 14
BLOCK_BYTES = 4 << 20
SEEDS = 32
WORDS = 200_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n, n_docs: int, total: int):
    """m of the contract, for a number of terms."""
    return 100 - B + (B * n * n_docs) // max(total, 1)


def impact(tf, m):
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The HASHES slices of each term's entry for 2^level occurrences."""
    h = mix(hashes + U64(level * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    return np.stack([(mix(h + U64(k)) & U64(width - 1)).astype(np.int64) for k in range(HASHES)], -1)


class Block:
    """Documents to be sliced together, of signatures of ``width`` bits."""

    def __init__(self, width: int):
        self.width, self.most = width, max(8, min(MOST_DOCS, CELLS // width))
        self.ids, self.n, self.text, self.at = [], [], [], []

    def add(self, doc_id, n: int, digest: bytes, at: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.n.append(n)
        self.text.append(digest)
        self.at.append(at)
        return len(self.ids) == self.most

    def row(self) -> dict:
        d = -(-len(self.ids) // 8) * 8
        held = np.zeros(self.width * d, bool)
        doc = np.repeat(np.arange(len(self.ids)), [len(a) for a in self.at])
        held[np.concatenate(self.at) * d + doc] = True
        out = {"width": self.width, "ids": self.ids, "n": self.n, "text": b"".join(self.text),
               "slices": np.packbits(held, bitorder="little").tobytes()}
        self.ids, self.n, self.text, self.at = [], [], [], []
        return out


def build_index(docs: DataFrame) -> DataFrame:
    """(width, ids, n, text, slices): blocks of signatures; ``text`` holds 16 bytes of hash per document."""
    def run(batches):
        known, blocks = WordHashes(WORDS), {}
        schema = pa.schema([("width", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                            ("text", pa.binary()), ("slices", pa.binary())])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                said = terms(text)
                if not said:
                    continue
                tf = Counter(said)
                h, n = known.of(list(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                levels = [h[n >= 1 << k] for k in range(int(n.max()).bit_length())]
                entries = sum(map(len, levels))
                width = BITS << max(4, (entries - 1).bit_length())
                at = np.concatenate([places(x, k, width).ravel() for k, x in enumerate(levels)])
                block = blocks.setdefault(width, Block(width))
                digest = blake2b(b" ".join(said), digest_size=16).digest()
                if block.add(doc_id, len(said), digest, np.unique(at)):
                    yield pa.RecordBatch.from_pylist([block.row()], schema)
        for block in blocks.values():
            if block.ids:
                yield pa.RecordBatch.from_pylist([block.row()], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "width long, ids array<long>, n array<long>, text binary, slices binary")


def statistics(docs: DataFrame, words: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document frequency of ``words`` over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        df, n, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                said = terms(text.as_py())
                n, total = n + bool(said), total + len(said)
                df.update(held.value.intersection(said))
        yield pa.RecordBatch.from_pydict({"word": [b"", b" ", *df], "n": [n, total, *df.values()]},
                                         pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {bytes(r.word): r.n for r in rows}  # a row per word of the query block
    return by.pop(b"", 0), by.pop(b" ", 0), by


class Queries:
    """A block of queries: their terms, and the terms' weights."""

    def __init__(self, rows, n_docs: int, total: int, df: dict[bytes, int]):
        self.n_docs, self.total = n_docs, total
        self.terms = sorted(df)
        number = {t: i for i, t in enumerate(self.terms)}
        self.weights = np.array([weight(n_docs, df[t]) for t in self.terms], np.int64)
        self.hashes = WordHashes().of(self.terms)
        self.items = [r["item_id"] for r in rows]
        # a term that no document has adds nothing to any score
        self.of = [np.array(sorted({number[t] for t in terms(r["text"]) if t in number}), np.int64) for r in rows]

    def bounds(self, width: int, n: np.ndarray, slices: bytes):
        """(query, upper bound of each document's score), for queries with any bound above 0."""
        d = -(-len(n) // 8) * 8
        bits = np.frombuffer(slices, np.uint8).reshape(width, d // 8)
        m = lengths(n, self.n_docs, self.total)
        gain, least = [], np.zeros(len(n), np.int64)  # what each further power of two of occurrences may add
        for level in range(int(n.max()).bit_length()):
            now = impact(np.minimum((2 << level) - 1, n), m)
            gain.append(now - least)
            least = now
        found = []  # per level: the terms present somewhere and their bitmaps
        at, has = np.arange(len(self.terms)), None
        for level in range(len(gain)):
            if not len(at):
                break
            p = places(self.hashes[at], level, width)
            got = bits[p[:, 0]]
            for k in range(1, HASHES):
                got &= bits[p[:, k]]
            if has is not None:
                got &= has
            some = got.any(1)
            at, has = at[some], got[some]
            row = np.full(len(self.terms), -1)
            row[at] = np.arange(len(at))
            found.append((row, has))
        for q, mine in enumerate(self.of):
            bound = np.zeros(len(n), np.int64)
            for (row, has), more in zip(found, gain):
                t = mine[row[mine] >= 0]
                if not len(t):
                    break
                # a weighted sum of slices; whole numbers far below 2^53, so exact in doubles
                held = np.unpackbits(has[row[t]], axis=1, count=len(n), bitorder="little").astype(np.float64)
                bound += (self.weights[t].astype(np.float64) @ held).astype(np.int64) * more
            if bound.any():
                yield q, bound

    def score(self, q: int, tf: Counter, n: int) -> int:
        m = lengths(n, self.n_docs, self.total)
        return sum(int(self.weights[t]) * int(impact(tf[self.terms[t]], m)) for t in self.of[q].tolist()
                   if tf[self.terms[t]])


CANDIDATE = "q int, doc_id long, text binary, bound long"


def candidates(index: DataFrame, queries, least) -> DataFrame:
    """Documents by their bounds: the SEEDS best of each block (``least`` None), else all that reach least[q]."""
    def run(batches):
        schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary()), ("bound", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n"], np.int64)
                out = {c: [] for c in schema.names}
                for q, bound in queries.value.bounds(row["width"], n, row["slices"]):
                    if least is None:
                        at = np.argpartition(-bound, min(SEEDS, len(n)) - 1)[:SEEDS]
                        at = at[bound[at] > 0]
                    else:
                        at = np.flatnonzero(bound >= least.value[q])
                    out["q"] += [q] * len(at)
                    out["doc_id"] += [row["ids"][k] for k in at.tolist()]
                    out["text"] += [row["text"][16 * k:16 * k + 16] for k in at.tolist()]
                    out["bound"] += bound[at].tolist()
                yield pa.RecordBatch.from_pydict(out, schema)

    return index.mapInArrow(run, CANDIDATE)


def scored(found: DataFrame, docs: DataFrame, queries, top: int) -> DataFrame:
    """(q, doc_id, score) of the candidates, from their whole texts; of equal texts the ``top`` smallest ids."""
    same = Window.partitionBy("q", "text").orderBy("doc_id")
    few = found.select("q", "text", "doc_id").distinct().withColumn("k", F.row_number().over(same)).where(f"k <= {top}")
    asked = few.groupBy("doc_id").agg(F.collect_list("q").alias("qs"))  # at most the block's queries, per text of the id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d").join(
        asked.alias("a"), F.expr("d.doc_id <=> a.doc_id")).select("d.doc_id", "d.text", "a.qs")

    def run(batches):
        schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            out = []
            for i, text, qs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                said = terms(text.as_py())
                tf = Counter(said)
                out += [(q, i, queries.value.score(q, tf, len(said))) for q in set(qs)]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))) if out else {c: [] for c in schema.names},
                                             schema)

    return rows.mapInArrow(run, "q int, doc_id long, score long").where("score > 0")


def search(docs: DataFrame, queries: DataFrame, top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query."""
    spark = docs.sparkSession
    index = written(build_index(docs), "bloom-index")
    items = queries.select("item_id", "text")
    blocks = -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1) // block_bytes)
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "bloom-queries")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    out = None
    for b in range(blocks):
        rows = items.where(F.col("block") == b).collect()  # about block_bytes
        held = spark.sparkContext.broadcast(Queries(rows, *statistics(docs, {t for r in rows for t in terms(r["text"])})))
        first = candidates(index, held, None).withColumn("k", F.row_number().over(
            Window.partitionBy("q").orderBy(F.desc("bound"), "doc_id"))).where(f"k <= {SEEDS}")
        seeds = scored(first, docs, held, SEEDS)
        tenth = seeds.withColumn("k", F.row_number().over(best)).where(f"k = {top}").select("q", "score").collect()
        least = np.ones(len(rows), np.int64)
        for r in tenth:  # a row per query of the block
            least[r.q] = r.score
        found = written(candidates(index, held, spark.sparkContext.broadcast(least)), "bloom-candidates")
        ranked = scored(found, docs, held, top).withColumn("rank", F.row_number().over(best)).where(f"rank <= {top}")
        number = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"q int, item_id "
                                       f"{queries.schema['item_id'].dataType.simpleString()}")
        part = ranked.join(number, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    return out


def op11_bit_sliced_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT)
        AS score FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
