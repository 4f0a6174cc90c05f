"""Inputs as blobs: (blob_id, content, size) and their provenance (blob_id, provenance as JSON)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import ids
from siftline.sources import ignore

#: Files above are skipped unless another limit is given.
MAX_FILE_SIZE = 100 * 1024 * 1024
#: What is before the path, or the host, in the name of a file.
SCHEME = "^[a-z0-9]+:(?://)?"
INPUT = "content binary, provenance string"


def from_files(spark: SparkSession, roots: Iterable[str], max_size: int = MAX_FILE_SIZE, ignore_lines: Iterable[str] = (), store: str | None = None) -> DataFrame:
    """Files below ``roots``; a negative max_size is no limit. Files that can't be read, or have gone since, are passed over.

    Sizes and paths are tested on the listing, before any content is read: the scan takes its files by their metadata.
    """
    parts = []
    for root in sorted(set(roots)):
        files = spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreCorruptFiles="true", ignoreMissingFiles="true").load(root)
        bare = re.sub(SCHEME, "", root.rstrip("/"))
        # The metadata's path has its special characters escaped; url_decode would take a plus sign for a space.
        listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        inner = F.regexp_replace(listed, SCHEME, "")
        inside = F.ltrim(F.substring(inner, F.lit(len(bare) + 1), F.length(inner)), F.lit("/"))
        if max_size >= 0:
            files = files.where(F.col("_metadata.file_size") <= max_size)
        rules = list(ignore_lines)
        if rules:
            files = files.where(~ignore.ignored(inside, rules))
        if store:
            files = files.where(~inner.startswith(store.rstrip("/") + "/"))
        parts.append(files.select("content", F.to_json(F.struct(F.lit("file").alias("kind"), inner.alias("path"))).alias("provenance")))
    if not parts:
        raise ValueError("no inputs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_jsonl(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(inputs, rejects) of lines {content | content_base64, provenance}: what can't be read is put aside, not fatal."""
    raw = F.col(value)
    row = F.from_json(raw, "content string, content_base64 string, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.select(raw.alias("line"), row.alias("r"), F.try_parse_json(raw).alias("v"))
    decoded = F.try_to_binary(F.col("r.content_base64"), F.lit("base64"))
    content = F.coalesce(F.col("r.content").cast("binary"), decoded)
    given = F.to_json(F.try_variant_get("v", "$.provenance", "variant"))
    rows = rows.withColumn("content", content).withColumn("given", given)
    good = F.col("r._bad").isNull() & F.col("content").isNotNull() & F.col("given").isNotNull()
    inputs = rows.where(good).select("content", F.concat(F.lit('{"kind":"extended","payload":'), F.col("given"), F.lit("}")).alias("provenance"))
    return inputs, rows.where(~F.coalesce(good, F.lit(False))).select("line")


def from_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_jsonl(spark.read.text(path))


def from_table(df: DataFrame, text: str, key: str, name: str) -> DataFrame:
    """A text column as blobs, with table and key as provenance."""
    provenance = F.to_json(F.struct(F.lit("extended").alias("kind"), F.struct(F.lit(name).alias("table"), F.col(key).alias("key")).alias("payload")))
    return df.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("content"), provenance.alias("provenance"))


def with_ids(inputs: DataFrame) -> DataFrame:
    content: Column = F.col("content")
    return inputs.select(ids.blob_id(content).alias("blob_id"), "content", F.octet_length("content").cast("long").alias("size"), "provenance")


def distinct(inputs: DataFrame) -> DataFrame:
    """Each content once, before it is scanned; one copy for each task is shuffled, so hot contents are no burden."""
    return inputs.groupBy("blob_id").agg(F.first("content").alias("content"), F.first("size").alias("size"))


def provenance(inputs: DataFrame) -> DataFrame:
    return inputs.select("blob_id", "provenance").distinct()


def statistics(inputs: DataFrame, blobs: DataFrame) -> DataFrame:
    """blobs_seen, bytes_seen (with repeats), blobs_scanned, bytes_scanned: one row."""
    seen = inputs.agg(F.count(F.lit(1)).alias("blobs_seen"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_seen"))
    scanned = blobs.agg(F.count(F.lit(1)).alias("blobs_scanned"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_scanned"))
    return seen.join(scanned)  # one row each


def guess_type(path: Column) -> Column:
    """MIME type by the extension of a path."""
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


#: Common extensions.
TYPES = {
    "c": "text/x-c", "css": "text/css", "csv": "text/csv", "go": "text/x-go", "h": "text/x-c", "htm": "text/html", "html": "text/html", "java": "text/x-java",
    "jpeg": "image/jpeg", "jpg": "image/jpeg", "js": "text/javascript", "json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "pem": "application/x-pem-file",
    "png": "image/png", "py": "text/x-python", "rs": "text/x-rust", "sh": "application/x-sh", "sql": "application/sql", "toml": "text/x-toml", "ts": "text/x-typescript",
    "txt": "text/plain", "xml": "text/xml", "yaml": "text/x-yaml", "yml": "text/x-yaml", "zip": "application/zip",
}


def git_url_ok(url: Column) -> Column:
    """URLs that may be cloned: https, a host, no user, query or fragment, and no .. in the path."""
    parts = {k: F.try_parse_url(url, F.lit(k)) for k in ("PROTOCOL", "HOST", "USERINFO", "QUERY", "REF", "PATH")}
    good = (parts["PROTOCOL"] == "https") & (F.length(parts["HOST"]) > 0) & parts["USERINFO"].isNull() & parts["QUERY"].isNull() & parts["REF"].isNull()
    return F.coalesce(good & ~F.coalesce(parts["PATH"], F.lit("")).rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def repositories(repos: DataFrame, kind: str = "source") -> DataFrame:
    """Clone URLs of a listing (clone_url, fork): sources, forks or all, each once and in order."""
    chosen = repos if kind == "all" else repos.where(F.col("fork") if kind == "fork" else ~F.col("fork"))
    return chosen.select("clone_url").distinct().orderBy("clone_url")
