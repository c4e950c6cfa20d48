"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Built from DataFrame functions only.  Virtual nodes and keys are points of one ring of
2^32 places; a key belongs to the arc that ends at the next virtual node clockwise.
Every shard has a load bound (its share of the rows, at most one apart), and keys of an
arc that find the shard full continue clockwise to the next virtual node.  Which keys
continue depends only on the order of keys within an arc, which is by hash and then by
value, so the layout of the input in files or partitions has no say.

The driver walks counts of ``shards x virtual`` arcs, never keys, and broadcasts the
segments it deals, about one for each arc.  Equal rows are one group with a count and
fill a range of slots; ranks are sums within fine cells of an arc plus the sums of the
cells before, so no task ranks an arc or a hot key row by row.

With ``virtual`` nodes a shard, going from 16 to 17 shards moves 6.5 % of 200,000 random
keys (5.9 % is the share of the new shard) and 0.6 % between old shards; with 64 nodes
it would be 8.4 % and 2.5 % (``tests/llm`` holds the bounds).
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import inline_rows, partitions, staged

RING = 1 << 32
COARSE = 1 << 12
#: Rows of one fine cell on average, and rows of one group that a task deals out at most.
CELL_ROWS, BLOCK = 2_000, 100_000


def ring_points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, one per place, in ring order."""
    import xxhash

    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(virtual):
            place = xxhash.xxh3_64_intdigest(f"shard-{shard}/{replica}".encode()) % RING
            while place in taken:
                place = (place + 1) % RING
            taken[place] = shard
    return sorted(taken.items())


def place_arcs(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[dict]:
    """Segments (arc, lo, hi, shard, at): ranks lo..hi-1 of an arc fill slots from ``at``.

    Bounds: the total is dealt as evenly as whole rows allow, so counts differ by one at
    most.  In rounds, each arc offers what it still holds to its current virtual node;
    what a full shard can't take moves on to the next one that has room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    left = [[arc, 0, n] for arc, n in sorted(counts.items()) if n]
    out: list[dict] = []
    step = 0
    while left:
        rest = []
        for arc, lo, hi in left:
            shard = points[(arc + step) % len(points)][1]
            take = min(hi - lo, room[shard] - filled[shard])
            if take:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "at": filled[shard]})
                filled[shard] += take
            if lo + take < hi:
                rest.append([arc, lo + take, hi])
        left, step = rest, step + 1
    return out


def _arc_table(points: list[tuple[int, int]]) -> list[dict]:
    """For each of ``COARSE`` parts of the ring: the points inside, and how many lie before."""
    places = [p for p, _ in points]
    width = RING // COARSE
    edges = [bisect.bisect_left(places, c * width) for c in range(COARSE + 1)]
    return [{"coarse": c, "first": edges[c], "inside": places[edges[c] : edges[c + 1]]} for c in range(COARSE)]


def _runs(pieces: DataFrame) -> DataFrame:
    """One row for each slot of a piece (at, many)."""
    slots = F.sequence(F.col("at"), F.col("at") + F.col("many") - 1)
    return pieces.select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 16, virtual: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Law ``rows``: shard counts are at most one apart.  ``slot`` is gapless from 0 within
    a shard.  Null texts have no bytes; null ids are a key of their own; rows that
    repeat an id are keys of the same arc and are still placed one by one.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    points = ring_points(shards, virtual)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    counted = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(RING))
    ring = inline_rows(spark, _arc_table(points), "coarse int, first int, inside array<long>")
    coarse = counted.withColumn("place", place).withColumn("coarse", F.shiftright("place", 20).cast("int"))
    before = F.size(F.filter("inside", lambda p: p < F.col("place")))
    on_ring = coarse.join(F.broadcast(ring), "coarse").withColumn("arc", F.pmod(F.col("first") + before, F.lit(len(points))))
    groups = staged(on_ring.select("doc_id", "size", "text_crc32", "n", "arc", _order("doc_id", "size", "text_crc32").alias("h")), "ring-keys")

    totals = groups.groupBy("arc").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max("n").alias("most")).collect()
    segments = place_arcs(points, {r["arc"]: r["n"] for r in totals}, shards)
    table = inline_rows(spark, segments, "arc int, lo long, hi long, shard int, at long")
    fine = max(1, max((r["groups"] for r in totals), default=0) // CELL_ROWS)

    cell = F.floor(F.col("h") / (2.0**64 / fine) + fine / 2.0).cast("int")
    keys = groups.withColumn("cell", F.least(F.greatest(cell, F.lit(0)), F.lit(fine - 1)))
    cells = keys.groupBy("arc", "cell").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("arc", "cell", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("off"))
    within = Window.partitionBy("arc", "cell").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0)))
    ranked = ranked.join(offsets, ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("off"))
    dealt = ranked.join(F.broadcast(table), "arc").where((F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("n") > F.col("lo")))
    lo, hi = F.greatest("rank", "lo"), F.least(F.col("rank") + F.col("n"), F.col("hi"))
    pieces = dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + lo - F.col("lo")).alias("at"), (hi - lo).alias("many"))
    out = _runs(pieces.where(F.col("many") <= BLOCK))
    if max((r["most"] for r in totals), default=0) > BLOCK:
        out = out.unionByName(_runs(_blocks(pieces.where(F.col("many") > BLOCK), partitions(spark))))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _order(*keys: str) -> Column:
    return F.xxhash64(F.lit("order"), *keys)


def _blocks(pieces: DataFrame, tasks: int) -> DataFrame:
    """Long pieces cut into blocks that are dealt to all tasks."""
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / BLOCK))).alias("part")
    cut = pieces.select("*", part).repartition(tasks, "shard", "at", "part")
    start = F.col("part") * BLOCK
    return cut.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + start).alias("at"), F.least(F.lit(BLOCK), F.col("many") - start).alias("many"))
