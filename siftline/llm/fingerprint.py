"""Canonical exact digests of documents, and groups of texts that are equal once canonical.

Canonical: Unicode compatibility normalisation (NFKC), case folding, normalisation again, every run of
white space one space, none at the ends. Fingerprint: 128 bits of xxh3 of that text in UTF-8, in hex.

Groups: rows whose fingerprints are equal meet by canonical bytes, too: within a bucket Spark's grouping
compares them byte for byte, with partial aggregation, so a text that a third of all rows share is
combined before it is shuffled, and two texts that should ever collide form two groups: a second digest of the
canonical text (64 bits, another hash) is kept beside each row and names its group within the bucket. For the groups
texts whose fingerprint occurs once aren't shuffled; ``compare`` shuffles all texts once, by doc_id, as neighbours must meet.

Defined cases: null and empty texts are equal and have the fingerprint of no bytes; null doc_ids come
after all others where order counts; repeated rows have equal results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import _work


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def second(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def likeness(a: str, b: str) -> float:
    """Exact digests are alike or not."""
    return float(a == b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    _work.prepare(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = _work.columns(batch, "doc_id", "text")
            yield _work.out(fields, [doc_ids, [digest(t) for t in texts]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def groups(docs: DataFrame, known: DataFrame, mark: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """fingerprint, second, group_id (the least doc_id of texts that are equal byte for byte), group_rows, texts (how many
    canonical texts the bucket holds), of fingerprints that occur more than once in ``known`` (doc_id, fingerprint)."""
    again = known.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    again = _work.materialise(again, "again")
    chosen = _work.marks(known.join(again, "fingerprint", "left_semi"), "doc_id")
    texts = _work.marked(docs.select(F.col("doc_id").cast("long"), "text"), chosen, "doc_id")
    fields = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("second", pa.int64()), ("canonical", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = _work.columns(batch, "doc_id", "text")
            raw = [canonical(t) for t in texts]
            yield _work.out(fields, [doc_ids, [mark(r) for r in raw], [second(r) for r in raw], raw])

    rows = texts.mapInArrow(run, "doc_id long, fingerprint string, second long, canonical binary")
    equal = rows.groupBy("fingerprint", "second", "canonical").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_rows")).drop("canonical")
    equal = _work.materialise(equal, "equal")
    several = equal.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("texts"), F.max("group_rows").alias("most")).where("texts > 1 or most > 1")
    return equal.join(several, "fingerprint").select("fingerprint", "second", "group_id", "group_rows", "texts")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, second long"


def compare(docs: DataFrame, mark: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """The fingerprint of each text beside those of its edited text and of the next document's (descending doc_id, around).

    The texts are range-partitioned by doc_id once; each task compares its own neighbours, and only the
    last text of a partition is joined to the first of the next one.
    """
    _work.prepare(docs.sparkSession)
    spark = docs.sparkSession
    order: list[Column] = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(_work.partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    done = pa.schema([*zip(names, types, strict=True), ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])

    def judge(doc_id: int | None, text: str, following: str, own: tuple[str, int], after: str) -> tuple:
        changed = edited(text, following)
        other = own[0] if changed == text else mark(canonical(changed))
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, own[0], other, likeness(own[0], other), likeness(own[0], after), own[1]

    def digests_of(text: str) -> tuple[str, int]:
        raw = canonical(text)
        return mark(raw), second(raw)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        part, first = -1, None
        for batch in batches:
            results = []
            for doc_id, text, p in zip(*_work.columns(batch, "doc_id", "text", "part"), strict=True):
                own = digests_of(text)
                if held is None:
                    part, first = p, text
                else:
                    results.append(judge(*held[:2], text, held[2], own[0]))
                held = doc_id, text, own
            yield _work.out(done, [*([r[i] for r in results] for i in range(len(names))), [part] * len(results), [None] * len(results), [None] * len(results)])
        if held is not None:  # the ends of the partition
            yield _work.out(done, [[held[0]], [len(held[1])], [None], [held[2][0]], [None], [None], [None], [held[2][1]], [part], [first], [held[1]]])

    walked = _work.materialise(rows.mapInArrow(walk, f"{FIELDS}, part int, first_text string, last_text string"), "walked")
    ends = walked.where("last_text is not null")
    parts = sorted(r[0] for r in ends.select("part").collect())  # one number for each partition
    if not parts:
        return walked.select(*names)
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int")
    firsts = ends.select(F.col("part").alias("after"), F.col("first_text").alias("following"))
    ends = ends.join(F.broadcast(after), "part").join(firsts, "after").select("doc_id", "last_text", "following")
    fields = pa.schema(list(zip(names, types, strict=True)))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [judge(i, t, f, digests_of(t), mark(canonical(f))) for i, t, f in zip(*_work.columns(batch, "doc_id", "last_text", "following"), strict=True)]
            yield _work.out(fields, [[r[i] for r in results] for i in range(len(names))])

    return walked.where("last_text is null").select(*names).unionByName(ends.mapInArrow(close, FIELDS))


def digests(docs: DataFrame, mark: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """``compare`` with the exact group of each row: group_id and group_rows (itself and 1 where no other text is equal),
    and ``texts``: how many different canonical texts the fingerprint's bucket holds."""
    rows = _work.materialise(compare(docs, mark), "fingerprints")
    found = _work.materialise(groups(docs, rows.select("doc_id", "fingerprint"), mark), "groups")
    rows = rows.join(found, ["fingerprint", "second"], "left")
    names = [f.split()[0] for f in FIELDS.split(", ")][:-1]
    return rows.select(*names, F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_rows", F.lit(1)).cast("long").alias("group_rows"), F.coalesce("texts", F.lit(1)).cast("long").alias("texts"))
