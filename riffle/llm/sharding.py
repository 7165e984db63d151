"""Sharding over fixed virtual slots.

A record hashes into one of ``SLOTS`` virtual slots by its id and text. Bytes and rows are counted for each slot, and a
small versioned map says which shard holds each slot. Rebalancing edits the map and never rehashes a record: a new
version names new shards for as few slots as are needed.

The law is ``bytes``: the map is made so that shard sizes are near equal. Slots are dealt from the largest to the
smallest, each to the lightest shard so far. Rows that agree in all are counted before anything else and hashed in runs of ``RUN``, so neither a common id
nor a common row fills a slot: the largest shard is beyond the mean by at most the largest slot. A map has one row for each slot, so it is bounded by ``SLOTS`` whatever
the input, and may be held by the driver and broadcast.

Defined results: a null text has size 1 and CRC 0; a null id hashes like any other value; repeated rows get places of
their own; places inside a shard follow slot, key, size and CRC, so reruns agree; an empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.session import cut, shared_dir, table

#: Virtual slots: fixed for the life of a dataset.
SLOTS = 16_384
#: Equal rows that go to one slot together.
RUN = 64
MAP_SCHEMA = "version int, slot int, shard int, first_place long"


def slot_of(*key: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most one entry for each slot."""
    return {r.vslot: (r.bytes, r.n) for r in rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")).collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: the largest slot first, each to the shard with the fewest bytes, then slots."""
    load = [(0, 0, s) for s in range(shards)]
    of = {}
    for slot in sorted(range(slots), key=lambda x: (-sizes.get(x, (0, 0))[0], x)):
        held, n, shard = heapq.heappop(load)
        of[slot] = shard
        heapq.heappush(load, (held + sizes.get(slot, (0, 0))[0], n + 1, shard))
    return of


def rebalanced(of: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version for ``shards`` shards: only slots of shards that are gone or hold more than their part move."""
    load = dict.fromkeys(range(shards), 0)
    moving = []
    for slot, shard in of.items():
        if shard in load:
            load[shard] += sizes.get(slot, (0, 0))[0]
        else:
            moving.append(slot)
    part = (sum(b for b, _ in sizes.values()) + shards - 1) // shards
    new = dict(of)
    by_shard: dict[int, list[int]] = {}
    for slot in sorted(of, key=lambda x: (sizes.get(x, (0, 0))[0], x)):
        by_shard.setdefault(of[slot], []).append(slot)
    for shard in sorted(load):
        for slot in reversed(by_shard.get(shard, [])):
            size = sizes.get(slot, (0, 0))[0]
            if size and load[shard] - size >= part:
                load[shard] -= size
                moving.append(slot)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda x: (-sizes.get(x, (0, 0))[0], x)):
        held, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, (0, 0))[0], shard))
    return new


def map_rows(spark: SparkSession, of: dict[int, int], sizes: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """The map as a table. first_place: the place in its shard of a slot's first record."""
    place: dict[int, int] = {}
    rows = []
    for slot in sorted(of):
        rows.append((version, slot, of[slot], place.setdefault(of[slot], 0)))
        place[of[slot]] += sizes.get(slot, (0, 0))[1]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(rows: DataFrame, path: str, version: int) -> None:
    """Stores a version of the map; earlier versions stay readable, and a write that is tried again replaces what it left."""
    rows.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, the newest unless it is named."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    return stored.where(F.col("version") == (F.lit(version) if version is not None else stored.agg(F.max("version")).first()[0]))


def records(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, n, vslot``: one row for up to ``RUN`` equal rows, ``n`` of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("total"))
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {RUN}"))))
    n = F.least(F.lit(RUN).cast("long"), F.col("total") - F.col("run") * RUN)
    return rows.select("doc_id", "size", "text_crc32", "run", n.alias("n"), slot_of("doc_id", "size", "text_crc32", "run").alias("vslot"))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with ``shard`` and ``slot``, the place in the shard from 0 without gaps. Ranks are taken inside virtual slots only."""
    before = F.sum("n").over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1))
    known = slot_map.select(F.col("slot").alias("vslot"), "shard", "first_place")
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(known), "vslot")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first_place") + F.col("before") + F.col("nth")).alias("slot"))


def op10_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(records(table(spark, sf_dir, "documents")))
    sizes = slot_sizes(rows)
    folder = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    store_map(map_rows(spark, first_map(sizes, 8), sizes, 1), folder, 1)
    out = placed(rows, load_map(spark, folder))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


QUERIES = {"op10_virtual_slot_sharding": op10_virtual_slot_sharding}
ORACLES: dict[str, str] = {}
