"""Blobs of a version-control history with the commits that introduced them, from tables of commits and trees.

A commit introduces a blob if it holds it and none of its parents' histories does. Trees are compared with those of
the parents at the same path, from the root down, so that only what a commit changed is expanded. That leaves a few
commits for each blob, and for most one; the others are told apart by one sweep over the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.shared import kept

#: Edges of a history that the driver numbers (some 100 bytes each) and sends to tasks (8 bytes); longer ones spread by rounds.
EDGES = 1_000_000
#: Blobs that one sweep follows, as bits of an integer for each commit.
SWEPT = 4096


def introduced(commits: DataFrame, entries: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit_id, blob_id, path) of what stands in a commit's trees but not at the same path of any parent's.

    ``commits`` has commit_id and tree_id, ``entries`` tree_id, name, kind and child_id. All commits that introduce a
    blob are among the rows, and others that moved or restored one: ``first_seen`` takes those away. One round for
    each level of folders. Links and submodules are left out. A subtree that one commit holds at several paths is
    followed once, at the least of them. Parents that are not among the commits count as none.
    """
    side = lambda own, tree: F.struct(F.lit(own).alias("own"), F.col(tree).alias("id"))
    trees = commits.select(F.col("commit_id").alias("parent_id"), F.col("tree_id").alias("parent_tree"))
    theirs = parents.select("commit_id", "parent_id").distinct().join(trees, "parent_id").groupBy("commit_id").agg(F.collect_set(side(False, "parent_tree")).alias("theirs"))
    level = commits.select("commit_id", "tree_id").join(theirs, "commit_id", "left").where(~F.exists(F.coalesce("theirs", F.array()), lambda t: t["id"] == F.col("tree_id")))
    level = level.select("commit_id", F.lit("").alias("path"), F.concat(F.array(side(True, "tree_id")), F.coalesce("theirs", F.array())).alias("trees"))
    found = None
    while True:
        below = level.withColumn("tree", F.explode("trees")).select("commit_id", "path", "tree.own", F.col("tree.id").alias("tree_id")).join(entries, "tree_id")
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        child = F.struct("kind", F.col("child_id").alias("id"))
        both = below.select("commit_id", path.alias("path"), F.when(F.col("own"), child).alias("mine"), F.when(~F.col("own"), child).alias("other"))
        both = both.groupBy("commit_id", "path").agg(F.collect_set("mine").alias("mine"), F.collect_set("other").alias("others"))
        new = kept(both.select("commit_id", "path", F.explode(F.array_except("mine", "others")).alias("new"), "others"))
        blobs = new.where(F.col("new.kind").isin("blob", "blob_exec")).select("commit_id", F.col("new.id").alias("blob_id"), "path")
        found = blobs if found is None else found.unionByName(blobs)
        others = F.transform(F.filter("others", lambda t: t["kind"] == "tree"), lambda t: F.struct(F.lit(False).alias("own"), t["id"].alias("id")))
        folders = new.where("new.kind = 'tree'").groupBy("commit_id", F.col("new.id").alias("tree_id")).agg(F.min(F.struct("path", others.alias("others"))).alias("least"))
        level = folders.select("commit_id", "least.path", F.concat(F.array(side(True, "tree_id")), "least.others").alias("trees"))
        if level.isEmpty():
            return found


def first_seen(contains: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``contains`` (commit_id, blob_id, path) whose commit has no proper ancestor that holds the blob.

    Blobs of one commit are done; for the others "an ancestor holds it" is swept along the history in one job, or,
    where the history has more than EDGES edges, spread by one round for each generation. A cycle raises an error.
    """
    edges = kept(parents.where("parent_id is not null and commit_id is not null").select(F.col("parent_id").alias("from_id"), F.col("commit_id").alias("to_id")).distinct())
    holders = contains.select("blob_id", "commit_id").distinct()
    several = holders.groupBy("blob_id").count().where("count > 1").select("blob_id")
    held = holders.join(several, "blob_id", "left_semi")
    later = swept(held, edges) if edges.count() <= EDGES else spread(held, edges)
    return contains.join(later, ["commit_id", "blob_id"], "left_anti")


def numbered(edges: DataFrame) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(commit_id, number) with parents before children, and each number's parents: those of c are ups[at[c] : at[c + 1]]."""
    table = edges.select("from_id", "to_id").toArrow()
    coded = pa.chunked_array([*table.column("from_id").chunks, *table.column("to_id").chunks], pa.string()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    parent, child = codes[: table.num_rows], codes[table.num_rows :]
    n = len(coded.dictionary)
    by = np.argsort(parent, kind="stable")
    first, downs = np.searchsorted(parent[by], np.arange(n + 1)).tolist(), child[by].tolist()
    waiting = np.bincount(child, minlength=n).tolist()
    order = [i for i in range(n) if not waiting[i]]
    for i in order:  # grows as commits lose the last parent they wait for
        for c in downs[first[i] : first[i + 1]]:
            waiting[c] -= 1
            if not waiting[c]:
                order.append(c)
    if len(order) < n:
        raise ValueError("the history has a cycle")
    number = np.empty(n, np.int32)
    number[order] = np.arange(n, dtype=np.int32)
    parent, child = number[parent], number[child]
    by = np.argsort(child, kind="stable")
    return pa.table({"commit_id": coded.dictionary, "number": number}), np.searchsorted(child[by], np.arange(n + 1)), parent[by]


def sweep(held: dict[int, int], at: list[int], ups: list[int]) -> Iterator[tuple[int, int]]:
    """Of each commit's bits in ``held`` those that a proper ancestor has too. Commits that add no bit share an integer."""
    masks = [0] * (len(at) - 1)
    for c in range(len(masks)):
        mask = 0
        for p in ups[at[c] : at[c + 1]]:
            if (joined := mask | masks[p]) != mask:
                mask = masks[p] if joined == masks[p] else joined
        if own := held.get(c):
            if again := own & mask:
                yield c, again
            mask |= own
        masks[c] = mask


def swept(held: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``held`` (blob_id, commit_id) whose commit has a proper ancestor among the blob's, by sweeps of many blobs each."""
    ids, at, ups = numbered(edges)
    if not ids.num_rows:
        return held.limit(0)
    fields = pa.schema([("blob_id", pa.string()), ("number", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, above = at.tolist(), ups.tolist()
        blobs: list[str] = []
        bits: dict[int, int] = {}

        def done() -> pa.RecordBatch:
            rows = [(blobs[i], c) for c, again in sweep(bits, starts, above) for i in range(again.bit_length()) if again >> i & 1]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

        for batch in batches:
            for blob, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not blobs or blob != blobs[-1]:
                    if len(blobs) == SWEPT:
                        yield done()
                        blobs, bits = [], {}
                    blobs.append(blob)
                bits[c] = bits.get(c, 0) | 1 << len(blobs) - 1
        if blobs:
            yield done()

    names = held.sparkSession.createDataFrame(ids)
    rows = held.join(names, "commit_id").select("blob_id", "number").repartition("blob_id").sortWithinPartitions("blob_id")
    return rows.mapInArrow(run, "blob_id string, number int").join(names, "number").select("blob_id", "commit_id")


def spread(held: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as ``swept`` (and pairs that aren't in ``held``), one generation in each round, until nothing new is reached."""
    if has_cycle(edges):
        raise ValueError("the history has a cycle")
    reached = kept(held.withColumnRenamed("commit_id", "from_id").join(edges, "from_id").select("blob_id", F.col("to_id").alias("commit_id")).distinct())
    front = reached
    while not front.isEmpty():
        onward = front.withColumnRenamed("commit_id", "from_id").join(edges, "from_id").select("blob_id", F.col("to_id").alias("commit_id")).distinct()
        front = kept(onward.join(reached, ["blob_id", "commit_id"], "left_anti"))
        reached = reached.unionByName(front)
    return reached


def has_cycle(edges: DataFrame) -> bool:
    """Whether peeling off commits without parents ends before all are gone."""
    while True:
        inner = edges.join(edges.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi")
        inner = kept(inner)
        n, m = inner.count(), edges.count()
        if n == 0:
            return False
        if n == m:
            return True
        edges = inner
