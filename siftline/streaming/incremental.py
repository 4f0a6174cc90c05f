"""Inputs that keep arriving: JSON lines are parsed, deduplicated, scanned and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.scan import scan
from siftline.plans.store import Store
from siftline.sources import blobs, rules


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("value string").text(folder)


def merge_batch(store: Store, chosen: list[rules.Rule], lines: DataFrame, snippet: int = 256) -> int:
    """One batch of lines into the store; returns the number of new matches. Contents the store knows need no second scan."""
    inputs, _ = blobs.parse_jsonl(lines)
    inputs = blobs.with_ids(inputs).persist()
    fresh = blobs.distinct(inputs.join(store.table("blob").select("blob_id"), "blob_id", "left_anti"))
    matches = scan(fresh, chosen, snippet).persist()
    known = store.table("blob").select("blob_id").unionByName(matches.select("blob_id")).distinct()
    provenance = blobs.provenance(inputs).join(known, "blob_id", "left_semi")
    n = store.record(matches, fresh, provenance, rules.frame(store.spark, chosen), "all")
    for df in (matches, inputs):
        df.unpersist()
    return n


def scan_stream(lines: DataFrame, store_path: str, chosen: list[rules.Rule], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Follows a stream of lines; with every=None it takes what is there and ends. A batch that is repeated changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        merge_batch(Store(batch.sparkSession, store_path), chosen, batch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
