"""Sharding through fixed virtual slots. DataFrame functions only.

Records hash by their text into a fixed number of slots, far more than there are shards,
so equal texts share a slot and a shard; a group of equal texts that is too heavy for
that is parted, by doc_id, over several slots. Bytes and rows are aggregated per slot,
and a small versioned table maps slots to shards. Its first version deals slots out in
turn; only the table is edited, into a next version, when loads are known or change or
shards are added; records never rehash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.llm.shared import settle

SLOTS = 8192
#: Equal rows are counted, and dealt to slots in lots of this many, so that no one record fills a slot.
LOT = 64
#: A group of equal texts is parted if it has more bytes than an eighth of a shard, or than four slots and ``WHOLE``.
WHOLE = 1 << 20
#: How far above the mean a shard may be before slots are moved from it.
TOLERANCE = 0.001


def first_map(slots: int, shards: int) -> dict[int, int]:
    """The first version: slots in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """An edited map for new loads or a new number of shards that moves few slots.

    Slots of removed shards go to the lightest shard. Then, as long as a shard is
    above the mean by more than ``tolerance``, its largest slot that fits goes to the
    lightest one.
    """
    out = {s: t for s, t in current.items() if t < shards}
    total = [0] * shards
    of: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        total[shard] += loads.get(slot, 0)
        of[shard].append(slot)
    for slot in sorted((s for s in loads if s not in out), key=lambda s: (-loads[s], s)):
        shard = min(range(shards), key=lambda t: (total[t], t))
        out[slot] = shard
        of[shard].append(slot)
        total[shard] += loads[slot]
    mean = sum(total) / shards
    while True:
        high = max(range(shards), key=lambda t: (total[t], -t))
        low = min(range(shards), key=lambda t: (total[t], t))
        gap = total[high] - total[low]
        movable = [s for s in of[high] if 0 < loads.get(s, 0) < gap]
        if total[high] <= mean * (1 + tolerance) or not movable:
            return out
        fit = [s for s in movable if loads[s] <= gap / 2]
        slot = max(fit, key=lambda s: (loads[s], -s)) if fit else min(movable, key=lambda s: (loads[s], s))
        of[high].remove(slot)
        of[low].append(slot)
        out[slot] = low
        total[high] -= loads[slot]
        total[low] += loads[slot]


def save_map(spark: SparkSession, mapping: dict[int, int], version: int, loads: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a stored table: version, virtual_slot, shard, bytes, rows, base.

    ``base`` is the number of rows in the slots before it in its shard.
    """
    rows, base = [], {}
    for slot in sorted(mapping):
        shard, (size, count) = mapping[slot], loads.get(slot, (0, 0))
        rows.append((version, slot, shard, size, count, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + count
    return settle(spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long, rows long, base long"), "slot_map")


def records(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``docs(doc_id, text)`` -> counted records with their virtual slot."""
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    d = raw.select("doc_id", (F.octet_length("raw").cast("long") + 8).alias("size"), F.crc32("raw").alias("text_crc32"), F.xxhash64("raw").alias("text_key"))
    counted = d.groupBy("doc_id", "size", "text_crc32", "text_key").agg(F.count("*").alias("n"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    n = F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT)
    lots = settle(lots.select("doc_id", "size", "text_crc32", "text_key", "lot", n.alias("n")), "lots")
    groups = settle(lots.groupBy("text_key", "size").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    most = max(1, min(total // (8 * shards), max(4 * total // slots, WHOLE)))
    # Groups over a bound that is at least 1 / (8 * shards), or 4 / slots, of all bytes: as many as 8 * shards or slots / 4 at most.
    heavy = groups.where(F.col("bytes") > most).select("text_key", "size", F.ceil(F.col("bytes") / most).alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "lot"), F.col("parts")))
    slot = F.pmod(F.xxhash64("text_key", "size", F.coalesce(part, F.lit(0).cast("long"))), F.lit(slots)).cast("int")
    return lots.join(F.broadcast(heavy), ["text_key", "size"], "left").select("doc_id", "size", "text_crc32", "lot", "n", slot.alias("virtual_slot"))


def slot_loads(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot; as many rows as there are slots come to the driver, whatever the input."""
    per = recs.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    return {r.virtual_slot: (r.bytes, r.rows) for r in per.collect()}


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Law ``bytes``: the shards' total sizes are near equal. ``size`` is the UTF-8
    length plus 8; a null text has none. Groups are rows of equal text, whatever their
    ids: a group is in one shard, unless it is too heavy (``WHOLE``) and is parted.
    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of virtual
    slots, then of doc_id, size and crc. Equal rows, null ids and null texts are rows
    like others. An empty table gives no rows. Other columns are ignored, whatever their
    names. The map that places them is version 2, edited from version 1 by ``rebalance``;
    both are stored.
    """
    spark = docs.sparkSession
    recs = settle(records(docs, shards, slots), "records")
    loads = slot_loads(recs)
    first = first_map(slots, shards)
    save_map(spark, first, 1, loads)
    stored = save_map(spark, rebalance(first, {s: b for s, (b, _) in loads.items()}, shards), 2, loads)
    # The map has at most ``slots`` rows, so it is small whatever the input.
    placed = recs.join(F.broadcast(stored.select("version", "virtual_slot", "shard", "base")), "virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("first", F.col("base") + F.sum("n").over(order) - F.col("n"))
    return placed.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy", "zero")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
