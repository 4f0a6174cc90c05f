"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points of a ring of 64-bit hashes. A document stands at the hash of its
text, so equal texts stand together, and goes to the shard of the next point clockwise; a shard that
is full passes what overflows on to the next point of a shard that isn't. The capacities add up to
the number of rows (or leave ``slack``), so balance is guaranteed, and a new shard's points take over
just the arcs before them and what overflowed because of them.

Which rows of an arc overflow is settled by counts: rows are ranked around the ring by a distributed
sort, one count for each arc (shards * VNODES, a parameter) comes to the driver, which walks the arcs
and answers with segments of ranks. A text that a third of all rows share is one point of the ring,
but its rows are ranked by doc_id's hash in many tasks and overflow like others. DataFrame functions only.

Law: ``rows``. With slack 0 the counts of shards differ by one at most.

Defined cases: null texts weigh nothing and stand together at the hash of null; null doc_ids and
repeated rows are rows like others; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import _work

VNODES = 128
#: Bits of a ring position by which arcs are looked up.
CELL_BITS = 12
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def ring(shards: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in order; positions as signed 64-bit integers."""
    points = {}
    for shard in range(shards):
        for v in range(VNODES):
            points.setdefault(xxhash.xxh64_intdigest(f"{shard}/{v}") + LOW, shard)
    return sorted(points.items())


def arcs(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """(cell, lo, hi, arc): arc i holds positions in (lo, hi]; the last goes around to the first point. Bounded by the ring."""
    edges = [LOW, *[p for p, _ in points], HIGH]
    rows = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        first = lo if i == 0 else lo + 1  # LOW itself belongs to the first arc
        if first > hi:
            continue
        rows += [(c, first, hi, i) for c in range(first >> (64 - CELL_BITS), (hi >> (64 - CELL_BITS)) + 1)]
    return spark.createDataFrame(rows, "cell long, lo long, hi long, arc int")


def flow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): each arc's rows to its shard, overflow clockwise to shards with room.

    Arcs are served at home first, then hop by hop, so a shard is filled by its own arcs before others'.
    """
    free, at, segments = list(capacity), [0] * len(counts), []
    waiting, hop = [i for i, n in enumerate(counts) if n], 0
    while waiting:
        left = []
        for arc in waiting:
            shard = owners[(arc + hop) % len(owners)]
            take = min(counts[arc] - at[arc], free[shard])
            if take:
                segments.append((arc, at[arc], at[arc] + take, shard))
                at[arc] += take
                free[shard] -= take
            if at[arc] < counts[arc]:
                left.append(arc)
        waiting, hop = left, hop + 1
    return segments


def assign(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("position"),
    )
    rows = _work.with_rank(rows, [F.col("position"), F.xxhash64("doc_id"), F.col("doc_id")], "rank", "ring")
    points = ring(shards)
    owners = [s for _, s in points]
    cell = F.shiftright("position", 64 - CELL_BITS)
    rows = rows.withColumn("cell", cell).join(F.broadcast(arcs(spark, points)), "cell").where("position between lo and hi")
    counts = [0] * (len(points) + 1)
    for arc, n in rows.groupBy("arc").count().collect():  # one row for each arc of the ring
        counts[arc] = n
    total = sum(counts)
    spare = int(slack * total / shards)
    capacity = [total // shards + (s < total % shards) + spare for s in range(shards)]
    starts, filled, segments = [0], [0] * shards, []
    for n in counts:
        starts.append(starts[-1] + n)
    for arc, first, end, shard in flow(counts, [*owners, owners[0]], capacity):
        segments.append((arc, starts[arc] + first, starts[arc] + end, shard, filled[shard]))
        filled[shard] += end - first
    table = F.broadcast(spark.createDataFrame(segments, "arc int, first long, end long, shard int, base long"))  # arcs and splits
    rows = rows.join(table, "arc").where("rank >= first and rank < end")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
