"""Mixing sources to target weights by hash thresholds, without sorting the documents.

Each document has a fixed 60-bit hash. For each source the tokens are summed by hash bucket (1024
of them), the bucket is found in which the running sum passes the budget, and only that bucket is
looked at again with the next ten bits, until it holds one hash. What lies below is taken. A budget
above a source's size takes whole passes first and the rest by threshold, so a document is taken
once more at most than its neighbour.

DataFrame functions only. One row for each source and 1024 for each source and level are all that
meet in one place; documents are never sorted, collected or grouped.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order;
rows that are equal in doc_id and text share one draw; an empty table gives an empty result. Budgets
are met up to half of the largest document of the source. Reruns agree, as the hash is of doc_id and text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import _work

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 10, 6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to rows (k, source, source_size): ``share`` of all sizes by weight, none above ``most`` of its source.

    Shares are filled like water: with sources in order of cap / weight, those before the first whose
    fair part fits stay at their cap. A window over one row for each source.
    """
    every = Window.partitionBy()
    cyclic = reduce(lambda rest, i: F.when(F.col("_i") % len(weights) == i, float(weights[i])).otherwise(rest), range(len(weights)), F.lit(float(weights[0])))
    rows = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("_w", cyclic)
    rows = rows.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_total", F.sum("source_size").over(every) * float(share))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    rows = rows.withColumn("_before", F.sum("_cap").over(filling) - F.col("_cap"))
    rows = rows.withColumn("_left", F.sum("_w").over(every) - F.sum("_w").over(filling) + F.col("_w"))
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))
    rows = rows.withColumn("_level", F.min(fits).over(every)["_level"])
    return rows.select("k", "source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), "_cap")).alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float, most: float, seed: int = 0) -> DataFrame:
    """doc_id, text_key, size, source_size, target, taken of every row (text_key: xxhash64 of the text).

    ``taken`` is size times the number of times the document is in the mix.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("k"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 64 - BITS * LEVELS))
    rows = _work.materialise(rows, "mix-rows")
    sizes = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = _work.materialise(sources.drop("source"), "mix-sources")

    # The state of a source: the boundary bucket by its prefix, what lies below it, whether it holds one hash.
    state = sources.select("k", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"), F.lit(False).alias("one"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("inside"))
    done = None
    for level in range(LEVELS):
        bits = BITS * (LEVELS - level - 1)
        bucket = F.shiftright("h", bits)
        inside = rows.join(state, "k").where(F.shiftright("h", bits + BITS) == F.col("prefix")) if level else rows.join(state, "k")
        sums = inside.groupBy("k", "rest", "below", bucket.alias("bucket")).agg(F.sum("size").alias("inside"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = F.col("below") + F.sum("inside").over(Window.partitionBy("k").orderBy("bucket"))
        passed = sums.withColumn("upto", running).where(F.col("upto") > F.col("rest"))
        boundary = passed.groupBy("k", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("inside")).alias("below"), (F.col("first") == F.col("last")).alias("one"), "first", "inside")).alias("b"))
        state = _work.materialise(boundary.select("k", "rest", F.col("b.bucket").alias("prefix"), "b.below", "b.one", "b.first", "b.inside"), "mix-state")
        ended = state.where("one") if level < LEVELS - 1 else state
        done = ended if done is None else done.unionByName(ended)
        state = state.where("not one")
        if level < LEVELS - 1 and state.isEmpty():
            break
    # Half of the boundary's own tokens decides whether it is nearer to take or to leave it.
    cuts = done.select("k", (F.col("first") + (F.col("rest") - F.col("below") >= F.col("inside") / 2).cast("long")).alias("cut"))
    cuts = sources.join(cuts, "k", "left").select("k", "source_size", "target", "passes", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(1 << 62))).otherwise(F.lit(0)).alias("cut"))
    cuts = _work.materialise(cuts, "mix-cuts")
    times = F.col("passes") + (F.col("h") < F.col("cut")).cast("long")
    return rows.join(cuts, "k").select("doc_id", "text_key", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def apply(docs: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken."""
    drawn = mix(docs, weights, share, most).select("doc_id", "text_key", "times").dropDuplicates(["doc_id", "text_key"])
    drawn = drawn.where("times > 0").withColumnsRenamed({"doc_id": "_id", "text_key": "_key", "times": "_times"})
    rows = docs.withColumn("_key2", F.xxhash64("text"))
    rows = rows.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key2") == F.col("_key")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
