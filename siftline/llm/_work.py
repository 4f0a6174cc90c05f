"""Shared-folder tables, row ranks and Arrow plumbing that the operators have in common."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch for the shuffle files of a query to go when it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch: a Python worker holds the texts of one, as strings and words, several times over.
BATCH_BYTES = 2 << 20
#: Number of buckets of a membership filter that is broadcast (see ``marks``): a fixed bound.
MARKS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder of this machine where that is unset and the master local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("siftline.local.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("siftline.local.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siftline/{label}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so that a run of very long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, computed once.

    The shuffle files of the write are deleted with its end.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Adds the rank of each row (gapless from 0) in the total order of ``order``, without a one-task window.

    The rows are range-partitioned and sorted, written, and numbered within their partition; only
    one count for each partition comes to the driver. ``order`` must end in a nearly unique key.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = materialise(rows.withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", 33).cast("int")
    offsets, total = [], 0
    for pid, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):
        offsets.append((pid, total))
        total += n
    base = spark.createDataFrame(offsets or [(-1, 0)], "_part int, _base long")
    rows = rows.withColumn("_part", part).join(F.broadcast(base), "_part")  # a row for each partition
    return rows.withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_base")


def mark_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MARKS)).cast("int")


def marks(keys: DataFrame, *columns: str) -> DataFrame:
    """Buckets (at most MARKS of them) that hold a key of ``keys``: a prefilter to broadcast, never the decision itself."""
    return keys.select(mark_of(*[F.col(c) for c in columns]).alias("_mark")).distinct()


def marked(df: DataFrame, filter_: DataFrame, *columns: str, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be (or, with keep=False, surely isn't) among those of ``filter_``."""
    found = df.withColumn("_mark", mark_of(*[F.col(c) for c in columns]))
    return found.join(F.broadcast(filter_), "_mark", "left_semi" if keep else "left_anti").drop("_mark")


def give_back() -> None:
    """Free memory of this process goes to the system: a Python worker waits for later tasks with all that it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when its task ends, ``forget`` is called and what is free goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return whole


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def out(schema: pa.Schema, arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) if not isinstance(a, pa.Array) else a for a, f in zip(arrays, schema, strict=True)], schema=schema)


def chunks(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Joins sorted batches to tables of about ``rows`` rows that end where the value of ``key`` changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count -= cut
    if held:
        yield pa.Table.from_batches(held)
