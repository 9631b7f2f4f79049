"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots, far more than there are
shards.  The bytes of each slot are aggregated, and a map from slots to shards
is kept by version: rebalancing edits the map of the version before it, so that
only the slots that it moves change their shard.  The map has one entry for
each slot, whatever the number of records, so it may be broadcast.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from .storage import columns, new_path

SLOTS = 8192
#: Bytes that each record takes besides its text.
OVERHEAD = 8
#: Rebalancing ends when the fullest and the emptiest shard differ by less than this part of the mean.
EVEN = 1000


@dataclass
class SlotMap:
    """shard of every slot, for one version; edits: the moves (slot, from, to) that made it, in order."""

    shards: int
    of: list[int]
    version: int = 1
    edits: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [s % shards for s in range(slots)])

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that evens them.

        sizes: bytes by slot; slots not named are empty and stay.  Of the
        fullest shard moves the slot nearest to half the difference; where none
        narrows it, a slot is exchanged for a smaller one.
        """
        of, load, edits = list(self.of), [0] * self.shards, []
        own: list[dict[int, int]] = [{} for _ in range(self.shards)]
        for slot, size in sizes.items():
            load[of[slot]] += size
            own[of[slot]][slot] = size

        def move(slot: int, a: int, b: int) -> None:
            size = own[a].pop(slot)
            own[b][slot] = size
            load[a] -= size
            load[b] += size
            of[slot] = b
            edits.append((slot, a, b))

        total = sum(load)
        for _ in range(4 * len(of)):
            a, b = max(range(self.shards), key=lambda k: (load[k], -k)), min(range(self.shards), key=lambda k: (load[k], k))
            gap = load[a] - load[b]
            if gap * self.shards * EVEN <= total:
                break
            fit = [(abs(gap - 2 * size), slot) for slot, size in own[a].items() if 0 < size < gap]
            if fit:
                move(min(fit)[1], a, b)
                continue
            there, best = sorted((size, slot) for slot, size in own[b].items()), None
            for slot, size in own[a].items():
                at = bisect(there, (size - gap / 2, -1))
                for other, with_slot in there[max(0, at - 1) : at + 1]:
                    if 0 < size - other < gap and (best is None or abs(gap - 2 * (size - other)) < best[0]):
                        best = (abs(gap - 2 * (size - other)), slot, with_slot)
            if best is None:
                break
            move(best[1], a, b)
            move(best[2], b, a)
        return SlotMap(self.shards, of, self.version + 1, edits)

    def grown(self, sizes: dict[int, int]) -> SlotMap:
        """The next version with one more shard, which alone receives slots."""
        new, of, edits = self.shards, list(self.of), []
        total = sum(sizes.values())
        load = [0] * (self.shards + 1)
        for slot, size in sizes.items():
            load[of[slot]] += size
        for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            a = of[slot]
            if load[new] + size <= total / (self.shards + 1) and load[a] - size >= 0.9 * total / (self.shards + 1):
                of[slot] = new
                load[a] -= size
                load[new] += size
                edits.append((slot, a, new))
        return SlotMap(self.shards + 1, of, self.version + 1, edits)

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (version, virtual_slot, shard), as many as there are slots."""
        return spark.createDataFrame([(self.version, s, k) for s, k in enumerate(self.of)], "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version as one row (shards, of, edits); a version that is stored again is replaced."""
        edits = [{"slot": s, "from": a, "to": b} for s, a, b in self.edits]
        row = spark.createDataFrame([(self.shards, self.of, edits)], STORED)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest if none is named."""
        rows = spark.read.schema(f"{STORED}, version int").parquet(path)
        r = rows.filter(F.lit(True) if version is None else F.col("version") == version).orderBy(F.col("version").desc()).first()
        if r is None:
            raise ValueError(f"no version {version or ''} of the map is stored")
        return cls(r.shards, list(r.of), r.version, [tuple(e) for e in r.edits])


#: A stored version of the map: one row, whose arrays are as long as there are slots and moves.
STORED = "shards int, of array<int>, edits array<struct<slot: int, from: int, to: int>>"


def _key(docs: DataFrame, id_col: str, text: Column) -> Column:
    """What a row is dealt by: its id; without one, its text and its other plain columns, so that copies part where they differ."""
    plain = [c for c, f in zip(columns(docs), docs.schema, strict=True) if isinstance(f.dataType, AtomicType)]
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), text, *plain)).otherwise(F.xxhash64(F.col(id_col).cast("long")))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs -> (id, size, text_crc32, virtual_slot); the texts themselves don't travel.

    Size: UTF-8 bytes of the text, none if it is null, plus OVERHEAD.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = _key(docs, id_col, text)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Rows (virtual_slot, bytes, n): one for each slot in use."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, str]:
    """(rows, path): rows (id, size, text_crc32, virtual_slot, shard, slot), and where the map's versions are stored.

    A path that holds versions goes on from the latest, whose shards it keeps:
    only slots that the edits name move.
    The sizes of the shards are made nearly equal by rebalancing the map.  slot
    is the row's place in its shard, without gaps from 0: places are counted in
    each virtual slot and shifted by the counts of the slots before it, so no
    task holds a whole shard.  Rows that are equal in all that is known of them
    take places in any order.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, id_col, text_col, slots)
    totals = slot_totals(slotted).collect()  # one row for each slot at most
    if path is None:
        path = new_path(spark, "slot_map")
        SlotMap.initial(shards, slots).save(spark, path)
    before = SlotMap.load(spark, path)
    before.rebalanced({r.virtual_slot: r.bytes for r in totals}).save(spark, path)
    now = SlotMap.load(spark, path)
    shards = now.shards
    start, places = [0] * shards, []
    for r in sorted(totals, key=lambda r: r.virtual_slot):
        k = now.of[r.virtual_slot]
        places.append((r.virtual_slot, k, start[k]))
        start[k] += r.n
    where = spark.createDataFrame(places, "virtual_slot int, shard int, start long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    rows = slotted.withColumn("place", place).join(F.broadcast(where), "virtual_slot")
    rows = rows.select("id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))
    return rows, path


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole records to one folder for each shard.

    Rows are dealt by virtual slot, so a shard is written by many tasks.
    """
    key = _key(docs, id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(*columns(docs), F.pmod(key, F.lit(len(slot_map.of))).cast("int").alias("_arborix_slot"))
    where = slot_map.table(docs.sparkSession).select(F.col("virtual_slot").alias("_arborix_slot"), F.col("shard").alias("_arborix_shard"))
    rows.join(F.broadcast(where), "_arborix_slot").repartition("_arborix_slot").drop("_arborix_slot").write.partitionBy("_arborix_shard").parquet(path)
