"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, given by an offset and a step from hashes of
its name. Shards take turns, each claiming the first free slot in its order of preference, until the table is full: so
shares differ by at most one slot, and adding or removing a shard moves few keys beyond those that must move. The table
(one small row for each slot) is broadcast; a key's hash modulo the size is its slot, found in constant time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import columns, free_name

TABLE_SIZE = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of the shard that claimed it; shards take turns in order of their names."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not _prime(size):
        raise ValueError("needs distinct shard names, at most one for each slot, and a prime table size")
    turns = []
    for number, name in sorted(enumerate(shards), key=lambda x: x[1]):
        digest = hashlib.md5(name.encode()).digest()
        turns.append([number, int.from_bytes(digest[:8]) % size, int.from_bytes(digest[8:]) % (size - 1) + 1])
    table, free = [-1] * size, size
    while free:
        for turn in turns:
            number, slot, step = turn
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], turn[1] = number, (slot + step) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot, from its MD5; a null key is the empty string's."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size).cast("int")


def assign_shards(
    docs: DataFrame, shards: list[str], *, key_col: str = "doc_id", size: int = TABLE_SIZE, slot_name: str = "slot", shard_name: str = "shard"
) -> DataFrame:
    """docs with the int column ``slot_name`` and the string column ``shard_name``.

    Rows are placed one by one without a shuffle, so a key that very many rows share costs nothing. Null and empty keys
    have the empty string's slot; equal keys have equal shards. An empty table stays empty. Names that are taken are an
    error.
    """
    if clash := {c.lower() for c in docs.columns} & {slot_name.lower(), shard_name.lower()}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    held = free_name(docs, "table_slot")
    table = docs.sparkSession.createDataFrame([(i, shards[n]) for i, n in enumerate(fill_table(shards, size))], f"`{held}` int, `{shard_name}` string")
    placed = docs.withColumn(slot_name, slot_of(docs[key_col], size))
    return placed.join(F.broadcast(table), F.col(slot_name) == F.col(held)).select(*columns(docs), slot_name, shard_name)  # size rows, whatever the input
