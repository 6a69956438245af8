"""Sharding by fixed virtual slots.

Every record is hashed by its key into one of a few thousand virtual slots, once and for all, so an edited text stays
where it is. Bytes are summed per slot, and a small versioned table says which shard holds which slot. Rebalancing and
growing edit that table: they move whole slots from the fullest shards to the emptiest until the shards are nearly
equal, and store the result as the next version; a later run on the same folder starts from the latest version and
stores another only if something moved. What is collected is one row per slot, whatever the corpus size.

A slot with far more records than others holds a key that repeats. The table marks it as spread: its records are hashed
anew, by key, text and a number of the row, over all slots. A mark stays in later versions.

Defined results: a null text has no bytes and the checksum of the empty text; a null id is hashed as null, and many of
them are spread like any key that repeats. Very long texts count whole; a slot with one that is larger than a shard's
share stays where it is. Repeated rows are each placed. Ties between slots that could move go to the lesser slot, and
between places in a slot to the checksum, then the size; equal rows may take their places in any order. An empty table
gives an empty result under a map that spreads the slots evenly. Extra columns pass through `assign` and are left out
of `placed`; a column of the input called like the new column is replaced.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import quoted, settled, table, work_dir

SLOTS = 8192
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 8
#: A slot is spread if it has more records than so many times the mean and so many more.
HOT_TIMES, HOT_MORE = 8, 64


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, and which slots' records are spread over all."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    spread: frozenset[int] = frozenset()

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return cls(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for shard, b in zip(self.shard_of, slot_bytes, strict=True):
            out[shard] += b
        return out

    def rebalanced(self, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = 0.001) -> SlotMap:
        """The next version, for `n_shards` shards (as many as before, or more); itself if nothing moves.

        Moves one slot at a time from the fullest shard to the emptiest that can take one, the one nearest to half
        their difference, or exchanges two where no move helps, until fullest and emptiest differ by at most
        `tolerance` of the mean. A shard that nothing can relieve is left as it is.
        """
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("shards can be added, not removed")
        shard_of = list(self.shard_of)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shard_of):
            held[shard].append((slot_bytes[slot], slot))
        for x in held:
            x.sort()
        loads = [sum(b for b, _ in x) for x in held]
        allowed = tolerance * sum(loads) / n
        movable = set(range(n))
        while movable:
            fullest = max(movable, key=lambda s: (loads[s], -s))
            gap_to_least = loads[fullest] - min(loads)
            if gap_to_least <= allowed:
                break
            for other in sorted(range(n), key=lambda s: (loads[s], s)):
                gap = loads[fullest] - loads[other]
                step = _best_exchange(held[fullest], held[other], gap) if gap > allowed else None
                if step:
                    break
            else:
                movable.discard(fullest)
                continue
            given, taken = step
            for slot, source, target in ((given, fullest, other), (taken, other, fullest)):
                if slot:
                    held[source].remove(slot)
                    bisect.insort(held[target], slot)
                    loads[source] -= slot[0]
                    loads[target] += slot[0]
                    shard_of[slot[1]] = target
        if n == self.n_shards and tuple(shard_of) == self.shard_of:
            return self
        return SlotMap(self.version + 1, n, tuple(shard_of), self.spread)

    def spreading(self, slot_rows: list[int]) -> SlotMap:
        """The next version, in which slots with far more records than others are spread; itself if there are no new ones."""
        hot = {s for s, n in enumerate(slot_rows) if n * len(slot_rows) > HOT_TIMES * sum(slot_rows) + HOT_MORE * len(slot_rows)}
        return SlotMap(self.version + 1, self.n_shards, self.shard_of, self.spread | hot) if hot - self.spread else self

    def shard(self, slot: Column) -> Column:
        return F.get(constants(self.shard_of, "int"), slot)

    def slot(self, key: Column, text: Column) -> Column:
        """The virtual slot of a record."""
        own = slot_of(key, len(self.shard_of))
        if not self.spread:
            return own
        again = F.pmod(F.xxhash64(key, checksum_of(text), F.monotonically_increasing_id()), F.lit(len(self.shard_of))).cast("int")
        return F.when(F.array_contains(constants(sorted(self.spread), "int"), own), again).otherwise(own)


def _best_exchange(full: list[tuple[int, int]], other: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int], tuple[int, int] | None] | None:
    """A slot of `full` for nothing or, if that is no use, for a slot of `other`: what moves nearest to half of `gap`.

    None if nothing narrows the gap. Both lists are sorted.
    """
    at = bisect.bisect_left(full, (gap / 2, -1))
    moves = [(abs(x[0] - gap / 2), x[1], x, None) for x in full[max(0, at - 1) : at + 1] if 0 < x[0] < gap]
    if not moves:
        for x in other:
            at = bisect.bisect_left(full, (x[0] + gap / 2, -1))
            moves += [(abs(y[0] - x[0] - gap / 2), y[1], y, x) for y in full[max(0, at - 1) : at + 1] if 0 < y[0] - x[0] < gap]
    if not moves:
        return None
    best = min(moves, key=lambda m: m[:2])
    return best[2], best[3]


def constants(values: tuple[int, ...] | list[int], kind: str) -> Column:
    """One array constant; a value per slot."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def store(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Adds a version to the table in `folder`; a version that is there is never rewritten."""
    rows = spark.range(0, len(slot_map.shard_of), 1, 1).select(
        F.col("id").cast("int").alias("slot"),
        slot_map.shard(F.col("id").cast("int")).alias("shard"),
        F.lit(slot_map.n_shards).alias("n_shards"),
        F.array_contains(constants(sorted(slot_map.spread), "int"), F.col("id").cast("int")).alias("spread"),
    )
    rows.write.mode("error").parquet(f"{folder}/version={slot_map.version}")


def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
    """A stored version, the latest by default: one row per slot. None if the folder has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(folder)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    found = rows.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(int(version), found[0]["n_shards"], tuple(r["shard"] for r in found), frozenset(r["slot"] for r in found if r["spread"]))


def size_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + RECORD_OVERHEAD


def checksum_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(key: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_totals(slotted: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows by slot of a table with columns `virtual_slot` and `size`."""
    bytes_, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        bytes_[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return bytes_, rows


def assign(df: DataFrame, slot_map: SlotMap, key: str = "doc_id", text: str = "text", column: str = "shard") -> DataFrame:
    """`df` with the shard of each row; no shuffle and no join."""
    return df.withColumn(column, slot_map.shard(slot_map.slot(quoted(key), quoted(text))))


def placed(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Key, size, checksum, virtual slot, shard and place in the shard of every row.

    The map is the latest in `folder`, or slot modulo shards (version 0) if there is none. It is edited by the bytes in
    each slot, and stored as the next version if that changed it. A row's place is the number of rows in earlier slots of
    its shard plus its rank in its own slot, so ranks are taken within thousands of slots and never within a whole shard.
    """
    spark = df.sparkSession
    folder = folder or work_dir(spark, "slot-map")
    slot_map = load(spark, folder)
    if slot_map is None:
        slot_map = SlotMap.initial(n_shards, n_slots)
        store(spark, slot_map, folder)
    n_slots = len(slot_map.shard_of)
    stored = slot_map.version
    while True:
        slotted = settled(
            df.select(
                quoted(key).alias(key),
                size_of(quoted(text)).alias("size"),
                checksum_of(quoted(text)).alias("text_crc32"),
                slot_map.slot(quoted(key), quoted(text)).alias("virtual_slot"),
            )
        )
        slot_bytes, slot_rows = slot_totals(slotted, n_slots)
        spreading = slot_map.spreading(slot_rows)
        if spreading is slot_map:
            break
        slot_map = spreading
    slot_map = slot_map.rebalanced(slot_bytes, n_shards)
    if slot_map.version > stored:
        slot_map = replace(slot_map, version=stored + 1)
        store(spark, slot_map, folder)
    before, filled = [0] * n_slots, [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shard_of):
        before[slot] = filled[shard]
        filled[shard] += slot_rows[slot]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(quoted(key), "text_crc32", "size"))
    slot = F.col("virtual_slot")
    return slotted.select(
        "*",
        slot_map.shard(slot).alias("shard"),
        (F.get(constants(before, "bigint"), slot) + rank - 1).cast("long").alias("slot"),
        F.lit(slot_map.version).alias("map_version"),
    )


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
