"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: element a is thrown into one of T bins in each of the first T rounds, with the value
round + u(a); from round T on, all elements go to bin round - T. A bin keeps its least value. So after
a few rounds (one, for sets of a few hundred elements and more) every coordinate is filled, and
the fraction of equal coordinates of two sketches is concentrated about the Jaccard similarity, at a
cost near linear in the set where a sketch of T independent hashes pays T times as much.

Banding: 40 bands of 5 coordinates; a pair of similarity 0.75 shares none of them with probability
(1 - 0.75^5)^40 = 2e-5. Candidates of a bucket are never expanded into all pairs: documents with
equal sets are one class first; each bucket's classes are compared with one hub of the bucket, links
join components, and the next round compares only classes whose component differs from that of
another hub. What then still shares a bucket but no component goes through an exact prefix filter on
rare shingles that also asks where in both sets the shared shingle stands, and what passes is verified, so no
link that shows in a bucket is lost, however large the bucket, and documents that share a common passage aren't
paired with each other. Links are confirmed on full shingle sets: the sets of documents that share a bucket
are written once, as arrays, and compared in the JVM. Components are found by spreading least labels with
pointer jumping, in written tables; nothing comes to the driver but counts.

Defined cases: null or empty texts, and texts without words, have no shingles, are linked with
nothing and kept. Rows of one doc_id share its links, and each row has the component of its own set;
``deduplicate`` gives each row a number of its own first, so it decides by row. Rows with a null doc_id are linked
to nothing but rows of the same set, get that class's component (null if there is none) and are kept
only if it is null. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import _work

WORDS_IN_SHINGLE = 5
BANDS, ROWS = 40, 5
T = BANDS * ROWS
#: Rounds of one hub for each bucket before the rest is compared by rare shingles.
HUB_ROUNDS = 2
#: Links: NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 75, 100

_POWERS = np.array([xxhash.xxh64_intdigest(b"word", i) | 1 for i in range(WORDS_IN_SHINGLE)], np.uint64)
_ROUND = np.array([xxhash.xxh64_intdigest(b"round", i) for i in range(2 * T)], np.uint64)
_BAND = np.array([[xxhash.xxh64_intdigest(b"band", i * ROWS + j) | 1 for j in range(ROWS)] for i in range(BANDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8; a short text is one shingle."""
    words = (text or b"").lower().split()  # of bytes: A-Z are lowered, and ASCII white space separates
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS_IN_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS_IN_SHINGLE + 1
    total = h[:n] * _POWERS[0]
    for k in range(1, WORDS_IN_SHINGLE):
        total += h[k : k + n] * _POWERS[k]
    return np.unique(mix(total))


def sketch(elements: np.ndarray) -> np.ndarray:
    """T values of a non-empty set of 64-bit hashes."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(T, empty, np.uint64)
    at_once = max(1, min(T, -(-2 * T // len(elements))))
    for first in range(0, T, at_once):
        rounds = np.arange(first, min(first + at_once, T), dtype=np.uint64)
        h = mix(elements[None, :] + _ROUND[first : first + len(rounds), None])
        bins = ((h >> np.uint64(32)) % np.uint64(T)).astype(np.int64).ravel()
        value = ((rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel()
        order = np.argsort(value)[::-1]
        found = np.full(T, empty, np.uint64)
        found[bins[order]] = value[order]  # of several, the last one written is the least
        values = np.where(values == empty, found, values)
        if not (values == empty).any():
            return values
    for b in np.flatnonzero(values == empty):
        h = mix(elements + _ROUND[T + b])
        values[b] = (np.uint64(T + b) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return values


def bands(values: np.ndarray) -> np.ndarray:
    return mix((values.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the sorted set, null for none), bands of every row."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = _work.columns(batch, "doc_id", "text")
            sets = [shingles(t) for t in texts]
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield _work.out(fields, [doc_ids, [len(s) for s in sets], hashes, [bands(sketch(s)) if len(s) else [] for s in sets]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_work.task(run), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, key (64 bits of the set), shingles (sorted array) of the rows whose doc_id is among ``ids``, and of few others."""
    chosen = _work.marks(ids, "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    fields = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = _work.columns(batch, "id", "text")
            rows, sets, size = [], [], 0
            for i, text in zip(own, texts, strict=True):
                if len(found := shingles(text)):
                    rows.append((i, xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)))
                    sets.append(found.view(np.int64))
                    size += len(found)
                if size > 1 << 20:
                    yield _work.out(fields, [[r[0] for r in rows], [r[1] for r in rows], lists(sets)])
                    rows, sets, size = [], [], 0
            yield _work.out(fields, [[r[0] for r in rows], [r[1] for r in rows], lists(sets)])

    return _work.marked(texts, chosen, "id").mapInArrow(_work.task(run), "id long, key long, shingles array<long>")


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets are linked: common * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n + m).

    Sets of no pair are mostly left out before the exchange (see ``_work.marks``); the joins decide.
    """
    sets = _work.marked(sets, _work.marks(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"), "id")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    linked = (NUMERATOR + DENOMINATOR) * F.size(F.array_intersect("x", "y")) >= NUMERATOR * (F.size("x") + F.size("y"))
    return both.where(linked).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable, for every id of the edges (a, b)."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = _work.materialise(both, "edges")
    labels = _work.materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("root"))
        step = step.join(jump, "low").select("id", F.least("low", "root").alias("comp"), F.col("comp").alias("was"))
        step = _work.materialise(step, "labels")
        _work.discard(labels)
        labels = step.select("id", "comp")
        if step.where("comp != was").isEmpty():
            _work.discard(both)
            return labels


def alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be linked at all: a link's smaller set has 75 hundredths of the larger one's size."""
    return (DENOMINATOR * F.least(n, m)) >= (NUMERATOR * F.greatest(n, m))


def rare_pairs(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``ids`` (id, comp) of different components that can still be linked: an exact filter.

    The shingles of each set stand in one order, from the rarest on. If two sets of n <= m elements are linked and
    i and j elements stand before the first that they share, then what is left of each, n - i and m - j, is no less
    than their intersection, which is 3/7 (n + m) at least (for 0.75). So i <= n / 7 and j <= m / 4, and the smaller
    set meets others by its first n / 7 elements alone. Documents that only share a common passage don't pass: the
    passage stands behind what is their own.
    """
    known = _work.marked(sets, _work.marks(ids, "id"), "id").join(ids, "id")
    known = _work.materialise(known.select("id", "key", "comp", F.size("shingles").alias("size"), "shingles"), "known")  # read three times, dealt once
    rows = known.select("key", "size", F.explode("shingles").alias("shingle"))
    often = _work.materialise(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    place = F.dense_rank().over(Window.partitionBy("key").orderBy("often", "shingle"))
    rows = rows.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("left", F.col("size") - place + 1)
    whole = NUMERATOR + DENOMINATOR
    larger = whole * F.col("left") >= NUMERATOR * (F.col("size") + F.col("size") * NUMERATOR / DENOMINATOR)
    rows = rows.where(larger & (F.col("often") > 1)).select("key", "shingle", "left").distinct()
    rare = _work.materialise(rows.join(known.select("id", "key", "comp", "size"), "key").drop("key"), "rare")
    _work.discard(often)
    _work.discard(known)
    first = rare.where(whole * F.col("left") >= 2 * NUMERATOR * F.col("size"))
    other = rare.select("shingle", F.col("id").alias("x"), F.col("comp").alias("x_comp"), F.col("size").alias("x_size"), F.col("left").alias("x_left"))
    ordered = F.struct("size", "id") < F.struct("x_size", "x")
    enough = whole * F.least("left", "x_left") >= NUMERATOR * (F.col("size") + F.col("x_size"))
    pairs = first.join(other, "shingle").where(ordered & (F.col("comp") != F.col("x_comp")) & enough)
    return pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    _work.prepare(docs.sparkSession)
    rows = _work.materialise(sketches(docs), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    classes = _work.materialise(classes, "classes")
    slots = classes.where("id is not null").select("id", "size", F.explode("bands").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    members = _work.materialise(slots.join(_work.materialise(full, "buckets"), "bucket").distinct(), "members")
    sets = sets_of(docs, members.select("id").distinct())
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows of one doc_id, equal ones among them
        sets = sets.dropDuplicates(["id", "key"])
    sets = _work.materialise(sets, "sets")

    labels = None
    tried = None
    for turn in range(HUB_ROUNDS + 1):
        if labels is None:
            open_ = members.withColumn("comp", F.col("id"))
        else:
            open_ = members.join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("comp", "id").alias("comp"))
            mixed = open_.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
            open_ = _work.materialise(open_.join(_work.materialise(mixed, "mixed"), "bucket"), "open")
        if turn < HUB_ROUNDS:
            hub = F.min(F.struct(F.xxhash64(F.lit(turn), "id") if turn else F.col("id"), F.col("id").alias("hub"), F.col("comp").alias("hub_comp"), F.col("size").alias("hub_size"))).alias("h")
            hubs = _work.materialise(open_.groupBy("bucket").agg(hub).select("bucket", "h.hub", "h.hub_comp", "h.hub_size"), "hubs")
            pairs = open_.join(hubs, "bucket").where((F.col("comp") != F.col("hub_comp")) & alike(F.col("size"), F.col("hub_size"))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        else:
            pairs = rare_pairs(sets, open_.select("id", "comp").distinct())
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = _work.materialise(pairs, "pairs")
        if pairs.isEmpty():
            if open_.isEmpty():
                break
            continue  # this round's hubs bring nothing new; the last round sees to all that is left
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = _work.materialise(verify(pairs, sets), "links")
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            # Links between components: the graph of components is solved, and labels follow.
            known = labels
            ends = links.join(known.withColumnsRenamed({"id": "a", "comp": "x"}), "a", "left").join(known.withColumnsRenamed({"id": "b", "comp": "y"}), "b", "left")
            merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            every = known.unionByName(merged.select("id", F.col("id").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))
            every = every.join(merged.select(F.col("comp").alias("root"), F.col("id").alias("comp")), "comp", "left")
            labels = _work.materialise(every.select("id", F.coalesce("root", "comp").alias("comp")), "labels")

    found = classes.select("set_hash", "id", "n")
    if labels is not None:
        found = found.join(labels, "id", "left")
    else:
        found = found.withColumn("comp", F.lit(None).cast("long"))
    found = found.select("set_hash", F.coalesce("comp", "id").alias("component"), "id", "n").where("n > 1 or component != id or id is null")
    found = _work.materialise(found.select("set_hash", "component"), "decided")
    for table in (classes, members, sets):
        _work.discard(table)
    rows = rows.select("doc_id", "n_shingles", "set_hash")
    alone = rows.where("set_hash is null").withColumn("component", F.lit(None).cast("long"))  # not dealt by a null key
    rows = rows.where("set_hash is not null").join(found, "set_hash", "left").unionByName(alone)
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one of least doc_id, a null one last.

    Rows are numbered in that order and the numbers grouped, so repeated rows leave one, rows that share a doc_id are
    judged by their own texts, and rows of a null doc_id are members like any other.
    """
    rows = _work.with_rank(docs, [F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text").asc()], "_row", "numbered")
    numbered = groups(rows.select(F.col("_row").alias("doc_id"), "text"))
    gone = _work.materialise(numbered.where("not kept").select(F.col("doc_id").alias("_id")), "dropped")
    return rows.join(gone, F.col("_row") == F.col("_id"), "left_anti").select(*docs.columns)
