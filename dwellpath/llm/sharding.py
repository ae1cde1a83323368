"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, given by an offset and
a step from its name's digest. Shards take turns; at its turn a shard claims the first free slot
of its order. A document's key is hashed to a slot, so placement is one look-up, and when a
shard goes, few documents of the other shards move.

Defined results: the placement depends on doc_id alone, so repeated rows go together; a null
doc_id is placed like the empty string; an empty table gives no rows; a table with fewer slots
than shards, a size that is no prime or no shard at all is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; the broadcast table has as many rows.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots."""
    d = hashlib.md5(name.encode()).digest()
    return int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:], "little") % (size - 1) + 1


def lookup_table(shards=SHARDS, size: int = TABLE_SIZE) -> np.ndarray:
    """The shard number of each slot."""
    if not shards or len(shards) > size or size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs shards and a prime size of at least their number")
    names = list(shards)
    if len(set(names)) != len(names):
        raise ValueError("shard names must differ")
    walks = [preference(n, size) for n in names]
    at = [0] * len(names)
    table = np.full(size, -1, dtype=np.int32)
    left = size
    while left:
        for k, (offset, step) in enumerate(walks):
            while table[(offset + at[k] * step) % size] >= 0:
                at[k] += 1
            table[(offset + at[k] * step) % size] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(doc_id: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(documents: DataFrame, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, slot, shard of every document."""
    table = lookup_table(shards, size)
    slots = [(k, shards[s]) for k, s in enumerate(table.tolist())]
    # one row a slot: the size is the operator's parameter, whatever the input
    slots = F.broadcast(documents.sparkSession.createDataFrame(slots, "slot int, shard string"))
    return documents.select("doc_id", slot_of(F.col("doc_id"), size).alias("slot")).join(slots, "slot").select("doc_id", "slot", "shard")


def oracle(shards=SHARDS, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL of the placement; the table of slots is filled here and written into it, two digits a slot."""
    table = "".join(f"{s:02x}" for s in lookup_table(shards, size).tolist())
    names = "[" + ", ".join(f"'{s}'" for s in shards) + "]"
    return f"""
SELECT doc_id, slot, {names}[CAST('0x' || substr('{table}', 2 * slot + 1, 2) AS INTEGER) + 1] AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)"""
