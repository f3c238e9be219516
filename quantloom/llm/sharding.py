"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table, a permutation given by an offset
and a skip that are hashed from its name. Shards take turns; at its turn a shard claims the first slot of its
order that is still free (a shard of weight w has w turns in each round). The filled table has a fixed size that
does not depend on the data, so it is broadcast, and placing a key is one hash and one lookup.

Cases: a null key is placed as the empty key, so all null keys share a slot; rows that repeat a key land together;
an empty table gives no rows; further columns of the input pass through, whatever their names, unless they are named
``slot`` or ``shard``, which are replaced. No shards, a non-prime size or more weight than slots is a ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import documents, quoted

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of its shard in name order. Depends on the set of names and weights only."""
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1 for s in shards}
    weights = {s: w for s, w in sorted(weights.items()) if w > 0}
    if not weights or not is_prime(size) or sum(weights.values()) > size:
        raise ValueError("needs shards, a prime table size and at most one turn per slot and round")
    names = list(weights)
    offset = [xxhash.xxh64_intdigest(s.encode(), 1) % size for s in names]
    skip = [xxhash.xxh64_intdigest(s.encode(), 2) % (size - 1) + 1 for s in names]
    turns = [i for i, s in enumerate(names) for _ in range(weights[s])]
    owner = [-1] * size
    step = [0] * len(names)
    free = size
    while free:
        for i in turns:
            at = (offset[i] + step[i] * skip[i]) % size
            while owner[at] >= 0:
                step[i] += 1
                at = (offset[i] + step[i] * skip[i]) % size
            owner[at] = i
            step[i] += 1
            free -= 1
            if not free:
                break
    return np.asarray(owner, np.int32)


def place(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` (hash of the key modulo the table size) and ``shard`` to every row of ``df``."""
    spark = df.sparkSession
    names = sorted(dict(shards) if isinstance(shards, Mapping) else shards)
    names = [s for s in names if not isinstance(shards, Mapping) or shards[s] > 0]
    owner = lookup_table(shards, size)
    table = spark.createDataFrame([(i, names[o]) for i, o in enumerate(owner.tolist())], "slot long, shard string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), F.lit(size))
    others = [c for c in df.columns if c.lower() not in ("slot", "shard")]  # the key may be one of the two
    keyed = df.select(*[F.col(quoted(c)) for c in others], slot.alias("slot"))
    # left join: the table has exactly `size` rows whatever the data, so it is always small enough to broadcast
    return keyed.join(F.broadcast(table), "slot", "left").select(*[F.col(quoted(c)) for c in others], "slot", "shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir, "doc_id"), "doc_id").select("doc_id", "slot", "shard")
