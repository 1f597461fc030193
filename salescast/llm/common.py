"""Helpers that several operators share: shared-folder tables, word hashes, connected components."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salescast.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables in the shared folder that live until the step that reads them last: what a long query holds of disk at
    once is a step's input and output, not all it ever wrote or shuffled.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files go when it ends

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str, *last: DataFrame) -> DataFrame:
        """``df`` as a table, and the tables ``last``, which nothing reads after it, deleted."""
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            path = scratch_path(self.spark, name)
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        self.drop(*last)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path  # with the table, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_exact(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``mapInPandas`` in which whole numbers beside nulls stay whole numbers (as objects), not doubles."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def frames(batches):
        for out in run(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(out, target, preserve_index=False)

    return df.mapInArrow(frames, schema)


def ascii_lower(col):
    """A-Z lower-cased, all else kept; ``lower`` does the same on pure ASCII text and is faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """bytes word -> 64-bit hash; a cache that is emptied when it reaches ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in text order; a shorter text is one run, none is none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        width = n
    out = np.full(n - width + 1, width, U64)
    for k in range(width):  # the words' hashes are random already; odd factors tell their places apart
        out += words[k:n - width + 1 + k] * U64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): for every node of an edge the smallest node it reaches.

    Large-star and small-star steps until no edge changes.  A hub's rows meet only in partial ``min``
    aggregates and in joins that the adaptive planner can split; each step is a table in the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u <> v").distinct(), name)
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)]
    seen = e.agg(*sums).first()
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v") \
            .where("u <> v").distinct()
        e = written(small, name)
        now = e.agg(*sums).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
