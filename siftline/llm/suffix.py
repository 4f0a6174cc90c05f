"""Repeated passages removed from a corpus, by prefix-free parsing and suffix order, in shards.

Parsing: a rolling hash of 32 bytes triggers where it is the least of any window of 69 places, so every
string of 100 bytes holds a trigger at a place that its own bytes decide, and equal strings have equal
triggers. The starts that share a trigger form a phrase: the bytes from the first of them to 100 bytes
after the last (168 at most), which overlaps the next one; what happens in one text can't shift
the phrases of another.

Dictionary: phrases meet by the hash of their trigger. A phrase that stands earlier in the corpus, by 64 bits
of its trigger's hash and 64 of its own (the bytes aren't compared), is a copy: all its strings are repeats. A trigger that occurs
once has none. Highly repetitive text so shrinks to the first occurrences of its phrases. A task remembers phrases,
above all those that came again, so it passes a frequent one on about once. Triggers are counted before, in
buckets; what falls into a bucket that holds very many is dealt by trigger and phrase rather than by trigger, so
no trigger, however common and in however many contexts, fills a task.

Suffix order: only phrases that differ but share a trigger are left (edges of passages and edits). Their
suffixes of 100 bytes are sorted as a suffix array to that depth, in runs of whole triggers, equal suffixes
in corpus order by the parse (document, place); all but the first of a run are repeats. Triggers that very many
different phrases share, and those of full buckets, are split by hashes of the 100-byte strings instead, in as many
tasks as they need.

Positions are judged on the input; matches never cross documents; removed runs are the union of repeats.

Defined cases: null texts are empty; texts under 100 bytes are kept whole; null doc_ids come last in the
order and, like rows that share a doc_id, are ordered by the hash of their text; rows equal in both are one
document, with one result for each row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import _work

LENGTH, GRAM = 100, 32
PLACES = LENGTH - GRAM + 1
#: Bytes that are parsed at once; longer texts are parsed in pieces whose strings overlap.
PIECE = 1 << 19
#: Phrases that are sorted at once, and different phrases of one trigger beyond which it is split by strings.
SORTED = 8_000
CROWDED = 20_000
#: Crowded triggers are broadcast: there are fewer than this.
MOST_CROWDED = 200_000
#: Buckets of triggers that are counted; a task reports those in which it has LEAST_COUNT phrases.
BUCKETS, LEAST_COUNT = 1 << 20, 64
#: Reported phrases beyond which a bucket is full, and the bound of full buckets (they are broadcast).
FULL, MOST_FULL = 1_000_000, 1 << 14
#: Tasks that a full bucket's phrases are dealt to, at most.
SALTS = 4_096
#: Phrases that a task remembers.
REMEMBERED = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
#: Low byte of a phrase's place: its number of starts (PLACES at most), with _FULL set if its bucket is full; _COPY for a span.
_COPY, _FULL = 255, 128


@cache
def powers(inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    steps = np.full(2 * PIECE, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def phrases(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and trigger hash of every phrase of joined texts; ``ends``: each byte's end of text."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers(False)[:n], out=total[1:])
    hashes = mix((total[GRAM:] - total[:-GRAM]) * powers(True)[: n - GRAM + 1])
    low = (hashes & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashes), dtype=np.uint64)  # of equals the leftmost
    width = 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[PLACES - width :][: n - LENGTH + 1])
    starts = np.flatnonzero(np.arange(LENGTH, n + 1) <= ends[: n - LENGTH + 1])
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    at = (low[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)]))
    return starts[new], np.diff([*new, len(starts)]), hashes[at[new]]


def pieces(ords: list[int], texts: list[bytes | None]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Joined texts of about PIECE bytes, with (ord, offset in the text, length) of each part."""
    parts, held, size = [], [], 0
    for o, text in zip(ords, texts, strict=True):
        text = text or b""
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if size + len(part) > PIECE + LENGTH and parts:
                yield b"".join(parts), held
                parts, held, size = [], [], 0
            parts.append(part)
            held.append((o, at, len(part)))
            size += len(part)
    if parts:
        yield b"".join(parts), held


def spans_of(order: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals [first, last) by document."""
    by = np.lexsort((first, order))
    order, first, last = order[by], first[by], last[by]
    if not len(by):
        return order, first, last
    other = np.concatenate([[True], order[1:] != order[:-1]])
    shift = np.cumsum(other) * (int(last.max()) + 2)  # sets documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(last + shift)
    at = np.flatnonzero(np.concatenate([[True], first[1:] + shift[1:] > reach[:-1]]))
    return order[at], first[at], np.maximum.reduceat(last, at)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): phrases of a task by bucket of their trigger, where they are many."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data, parts in pieces(*_work.columns(batch, "ord", "text")):
            sizes = np.array([p[2] for p in parts])
            _, _, key = phrases(data, np.repeat(np.cumsum(sizes), sizes))
            np.add.at(total, (key & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
    many = np.flatnonzero(total >= LEAST_COUNT)
    yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(total[many])], names=["bucket", "n"])


class Firsts:
    """What a task remembers of phrases: the least place so far. When full it forgets all that didn't come again."""

    def __init__(self) -> None:
        self.seen: dict[int, tuple[int, int, int]] = {}
        self.again: set[int] = set()

    def copies(self, key: np.ndarray, ctx: np.ndarray, order: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of these phrases stand behind an equal one that has already gone on; equal is by key and ctx."""
        copy = np.zeros(len(key), bool)
        seen, again = self.seen, self.again
        name = key.view(np.uint64) ^ mix(ctx.view(np.uint64))  # name and ctx give the key again
        for i, (n, c, *place) in enumerate(zip(name.tolist(), ctx.tolist(), order.tolist(), pos.tolist(), strict=True)):
            held = seen.get(n)
            if held is None or held[0] != c:
                seen[n] = (c, *place)
            else:
                again.add(n)
                if held[1:] < tuple(place):
                    copy[i] = True
                else:
                    seen[n] = (c, *place)
        if len(seen) > REMEMBERED:
            self.seen = {n: seen[n] for n in again} if 2 * len(again) <= REMEMBERED else {}
            again.clear()
        return copy


PHRASE = "key long, ctx long, ord long, pos long"
PHRASE_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in PHRASE.split(", ")])


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases (trigger, phrase hash, document, start * 256 + starts); copies of what the task remembers come out as spans at once."""
    firsts = Firsts()
    for batch in batches:
        for data, parts in pieces(*_work.columns(batch, "ord", "text")):
            sizes = np.array([p[2] for p in parts])
            edges = np.cumsum(sizes)
            first, n, key = phrases(data, np.repeat(edges, sizes))
            if not len(first):
                continue
            part = np.searchsorted(edges, first, "right")
            order = np.array([p[0] for p in parts])[part]
            start = first - (edges - sizes)[part] + np.array([p[1] for p in parts])[part]
            view = memoryview(data)
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[s : s + k]) for s, k in zip(first.tolist(), (n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
            by = np.lexsort((start, order, ctx, key))
            copy = np.concatenate([[False], (key[by][1:] == key[by][:-1]) & (ctx[by][1:] == ctx[by][:-1])])
            lead = by[~copy]
            copy[~copy] = firsts.copies(key[lead], ctx[lead], order[lead], start[lead])
            yield passed_on(key[by], ctx[by], order[by], start[by], n[by], copy)


def passed_on(key: np.ndarray, ctx: np.ndarray, order: np.ndarray, start: np.ndarray, n: np.ndarray, copy: np.ndarray) -> pa.RecordBatch:
    """Phrases, and the unions of copies as spans, which are dealt evenly."""
    lead = ~copy
    o, s, e = spans_of(order[copy], start[copy], start[copy] + n[copy] + LENGTH - 1)
    spread = mix(o.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([key[lead].view(np.int64), spread.view(np.int64)])),
        pa.array(np.concatenate([ctx[lead].view(np.int64), e])),
        pa.array(np.concatenate([order[lead], o])),
        pa.array(np.concatenate([start[lead] * 256 + n[lead], s * 256 + _COPY])),
    ], schema=PHRASE_ARROW)


FOUND = "kind int, key long, ord long, first long, last long"
FOUND_ARROW = pa.schema([("kind", pa.int32()), *[(f, pa.int64()) for f in ("key", "ord", "first", "last")]])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by (key, ctx, ord, pos) to spans of copies (kind 0) and first phrases of shared triggers (kind 1) and of full buckets (kind 2).

    One row is held back at most: the first phrase of a trigger, until a different one of it is seen.
    """
    before: tuple[int, int] | None = None
    pending: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ctx, order, pos = (batch.column(i).to_numpy() for i in range(4))
        ready = (pos & 255) == _COPY
        spans = [(order[ready], pos[ready] >> 8, ctx[ready])]
        key, ctx, order, pos = key[~ready], ctx[~ready], order[~ready], pos[~ready]
        left = []
        if len(key):
            same_key, same = np.empty(len(key), bool), np.empty(len(key), bool)
            same_key[1:], same[1:] = key[1:] == key[:-1], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])
            same_key[0] = before is not None and key[0] == before[0]
            same[0] = same_key[0] and ctx[0] == before[1]
            spans.append((order[same], pos[same] >> 8, (pos[same] >> 8) + (pos[same] & _FULL - 1) + LENGTH - 1))
            lead = np.flatnonzero(~same)
            another = same_key[lead]
            if len(lead):
                if pending is not None and another[0]:
                    left.append(tuple(np.array([x]) for x in pending))
                shared = another.copy()
                shared[:-1] |= another[1:]
                full = (pos[lead] & _FULL) > 0  # dealt by trigger and phrase: others of the trigger are elsewhere
                shared |= full
                chosen = lead[shared]
                left.append((key[chosen], order[chosen], pos[chosen]))
                final = lead[-1]
                pending = None if another[-1] or full[-1] else (key[final], order[final], pos[final])
            before = (key[-1], ctx[-1])
        o, first, last = spans_of(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        k, p_order, p = (np.concatenate([x[i] for x in left]) if left else np.empty(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.zeros(len(o)), np.where(p & _FULL, 2, 1)]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(o), np.int64), k])), pa.array(np.concatenate([o, p_order])),
            pa.array(np.concatenate([first, p >> 8])), pa.array(np.concatenate([last, p & _FULL - 1])),
        ], schema=FOUND_ARROW)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of phrases: (key, ord, first, bytes) from texts with their lists of places."""
    fields = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        for o, text, places in zip(*_work.columns(batch, "ord", "text", "places"), strict=True):
            yield _work.out(fields, [[p["key"] for p in places], [o] * len(places), [p["first"] for p in places], [text[p["first"] : p["first"] + p["last"] + LENGTH - 1] for p in places]])


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every 100-byte string of phrases (ord, first, bytes), as a phrase of one start with two hashes of its own."""
    firsts = Firsts()
    for batch in batches:
        key, ctx, order, pos = [], [], [], []
        for o, first, raw in zip(*_work.columns(batch, "ord", "first", "bytes"), strict=True):
            for j in range(len(raw) - LENGTH + 1):
                part = raw[j : j + LENGTH]
                key.append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                ctx.append(xxhash.xxh64_intdigest(part) - (1 << 63))
                order.append(o)
                pos.append(first + j)
        columns = [np.array(x, np.int64) for x in (key, ctx, order, pos)]
        yield passed_on(*columns, np.ones(len(key), np.int64), firsts.copies(*columns))


def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats from phrases sorted by (key, ord, first): a suffix array to depth 100 of whole triggers at a time."""
    fields = pa.schema([(f, pa.int64()) for f in ("ord", "first", "last")])
    for table in _work.chunks(batches, "key", SORTED):
        key, order, first = (table.column(i).to_numpy() for i in range(3))
        raw = table.column("bytes").to_pylist()
        sizes = np.array([len(r) for r in raw])
        n = sizes - LENGTH + 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        unit = np.repeat(np.arange(len(raw)), n)
        within = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.cumsum(sizes) - sizes, n) + within
        suffix = np.empty((len(unit), LENGTH + 4), np.uint8)
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(">u4")[unit]
        suffix[:, :4] = run.view(np.uint8).reshape(-1, 4)
        suffix[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[place]
        whole = suffix.view(f"V{LENGTH + 4}").ravel()
        by = np.argsort(whole, kind="stable")  # equal suffixes stay in corpus order
        again = np.zeros(len(unit), bool)
        again[by[1:]] = (suffix[by[1:]] == suffix[by[:-1]]).all(axis=1)
        start = first[unit[again]] + within[again]
        yield _work.out(fields, [pa.array(x) for x in spans_of(order[unit[again]], start, start + LENGTH)])


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (doc_id, text_key, ord, text), one for each document, and the spans (ord, first, last) to remove."""
    _work.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    odd = texts.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        texts = texts.withColumn("ord", F.col("doc_id"))
    else:  # ids that don't name one text: ranks take their place
        ids = _work.with_rank(texts.select("doc_id", "text_key").distinct(), [F.col("doc_id").asc_nulls_last(), F.col("text_key")], "ord", "order")
        ids = _work.materialise(ids, "order").withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        texts = texts.dropDuplicates(["doc_id", "text_key"]).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).drop("_id", "_key")
        texts = _work.materialise(texts, "texts")  # a task that runs again reads the same rows in the same order

    counted = _work.materialise(texts.select("ord", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counts")
    bound = max(FULL, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_FULL)
    full = counted.where(F.col("n") > bound).select("bucket")  # under MOST_FULL, as each has more than that part of the sum
    parsed = texts.select("ord", "text").mapInArrow(parse, PHRASE)
    keys = ["key"]
    if not full.isEmpty():
        bucket = F.col("key").bitwiseAND(BUCKETS - 1)
        parsed = parsed.join(F.broadcast(full.withColumn("full", F.lit(True))), F.col("bucket") == bucket, "left")
        split = F.col("full").isNotNull() & (F.col("pos").bitwiseAND(_COPY) != _COPY)
        salt = F.when(split, F.pmod("ctx", F.lit(SALTS))).otherwise(0)
        parsed = parsed.select("key", "ctx", "ord", F.when(split, F.col("pos") + _FULL).otherwise(F.col("pos")).alias("pos"), salt.alias("salt"))
        keys.append("salt")
    parsed = parsed.repartition(*keys).sortWithinPartitions("key", "ctx", "ord", "pos").select("key", "ctx", "ord", "pos")
    found = _work.materialise(parsed.mapInArrow(meet, FOUND), "phrases")
    spans = found.where("kind = 0").select("ord", "first", "last")
    left = found.where("kind = 1")

    crowd = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.greatest(F.lit(CROWDED), F.lit(left.count() // MOST_CROWDED)))
    crowd = _work.materialise(crowd.select("key"), "crowded")  # under MOST_CROWDED keys, as each has more than that part of the rows
    plain = left.join(F.broadcast(crowd), "key", "left_anti")

    def placed(rows: DataFrame) -> DataFrame:
        chosen = _work.marks(rows, "ord")
        places = rows.groupBy("ord").agg(F.collect_list(F.struct("key", "first", "last")).alias("places"))
        return places.join(_work.marked(texts.select("ord", "text"), chosen, "ord"), "ord").select("ord", "text", "places")

    bytes_ = placed(plain).mapInArrow(cut, "key long, ord long, first long, bytes binary").repartition("key").sortWithinPartitions("key", "ord", "first")
    more = _work.materialise(bytes_.mapInArrow(sort_suffixes, "ord long, first long, last long"), "repeats")
    spans = spans.unionByName(more)
    if not (full.isEmpty() and crowd.isEmpty()):
        rows = left.join(F.broadcast(crowd), "key", "left_semi").unionByName(found.where("kind = 2"))
        rows = _work.materialise(placed(rows).mapInArrow(cut, "key long, ord long, first long, bytes binary"), "crowds")
        rows = rows.mapInArrow(strings, PHRASE).repartition("key").sortWithinPartitions("key", "ctx", "ord", "pos")
        more = _work.materialise(rows.mapInArrow(meet, FOUND), "strings")
        spans = spans.unionByName(more.where("kind = 0").select("ord", "first", "last"))
    return texts, spans


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    texts, spans = removed(docs)
    chosen = _work.materialise(_work.marks(spans, "ord"), "touched")
    spans = spans.groupBy("ord").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    touched = _work.marked(texts, chosen, "ord").join(spans, "ord", "left")
    fields = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, keys, texts, spans = _work.columns(batch, "doc_id", "text_key", "text", "spans")
            n_removed, n_spans, kept = [], [], []
            for text, each in zip(texts, spans, strict=True):
                first, last = (np.array([s[k] for s in each or []], np.int64) for k in ("first", "last"))
                _, first, last = spans_of(np.zeros(len(first)), first, last)
                at = [0, *last.tolist()]
                kept.append(b"".join(text[a:b] for a, b in zip(at, [*first.tolist(), len(text)], strict=True)))
                n_removed.append(len(text) - len(kept[-1]))
                n_spans.append(len(first))
            yield _work.out(fields, [doc_ids, keys, [len(t) for t in texts], n_removed, n_spans, kept])

    schema = "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept binary"
    changed = touched.select("doc_id", "text_key", "text", "spans").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    whole = _work.marked(texts, chosen, "ord", keep=False).select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return whole.unionByName(changed)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = clean(docs).select("doc_id", "text_key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    odd = docs.groupBy(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key")).count().where("count > 1")
    odd = _work.materialise(odd.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "count"), "repeated")
    if not odd.isEmpty():  # as many results as rows
        found = found.join(odd, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("count", F.lit(1)).cast("int"))))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
