"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

The table has a prime number of slots.  Each shard has its own order of preference over all slots, an
offset and a step that come from a hash of its name; the shards take turns, each claiming the first slot of its order
that is free, until every slot is claimed.  So shards own equal numbers of slots, give or take one, and
when a shard leaves most slots keep their owner.  A key's hash modulo the table's size is its slot, one
lookup in a table that is broadcast: its size is a parameter, whatever the data's.

Inputs: any frame with a key column; its other columns are kept.  A null key is placed like the empty
string.  Equal keys share a shard; rows are never dropped; an empty frame gives no rows.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SLOTS, SHARDS = 4093, 32


def slot_owners(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (number of the shard) of each slot; ``slots`` must be prime and at least the number of shards."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("there must be between 1 and as many distinct shards as slots")
    ordered = sorted(range(len(shards)), key=shards.__getitem__)  # turns do not depend on the order given
    start = [int(md5(f"offset:{s}".encode()).hexdigest()[:8], 16) % slots for s in shards]
    step = [int(md5(f"skip:{s}".encode()).hexdigest()[:8], 16) % (slots - 1) + 1 for s in shards]
    owner, at, left = [-1] * slots, start[:], slots
    while left:
        for i in ordered[:left]:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
        left -= min(left, len(shards))
    return owner


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (the name); columns of these names, and ``_slot`` and ``_shard``, are replaced."""
    owners = slot_owners(shards, slots)
    spark = df.sparkSession
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owners))), ",")).alias("slot", "n")) \
        .select(F.col("slot").cast("long").alias("_slot"),
                F.get(F.array(*map(F.lit, shards)), F.col("n").cast("int")).alias("_shard"))
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8),
                  16, 10).cast("long") % slots
    return df.withColumn("_slot", slot).drop("slot", "shard", "_shard").join(F.broadcast(lookup), "_slot") \
        .withColumnsRenamed({"_slot": "slot", "_shard": "shard"})


def op3_maglev(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)]).select("doc_id", "n_chars", "slot", "shard")


_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
SQL = f"""
WITH RECURSIVE shards AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({SHARDS}) t(i)),
perm AS (SELECT list(o ORDER BY i) AS o, list(s ORDER BY i) AS s FROM (SELECT i,
    {_H.format("'offset:' || name")} % {SLOTS} AS o, {_H.format("'skip:' || name")} % ({SLOTS} - 1) + 1 AS s FROM shards)),
fill AS (SELECT 0 AS n, list_transform(range({SLOTS}), lambda x: false) AS taken, CAST(-1 AS BIGINT) AS slot,
        CAST(-1 AS BIGINT) AS shard, o, s FROM perm
  UNION ALL
  SELECT n + 1, list_transform(taken, lambda t, j: t OR j - 1 = p), p, CAST(n % {SHARDS} AS BIGINT), o, s
  FROM (SELECT *, list_filter(list_transform(range({SLOTS}),
          lambda k: (o[n % {SHARDS} + 1] + k * s[n % {SHARDS} + 1]) % {SLOTS}), lambda q: NOT taken[q + 1])[1] AS p FROM fill
        WHERE n < {SLOTS}))
SELECT doc_id, n_chars, d.slot, name AS shard
FROM (SELECT *, {_H.format("CAST(doc_id AS VARCHAR)")} % {SLOTS} AS slot FROM documents) d
JOIN (SELECT slot, shard FROM fill WHERE n > 0) f ON d.slot = f.slot JOIN shards ON shards.i = f.shard
"""
