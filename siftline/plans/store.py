"""The store: Parquet tables with content-derived keys, merged set-wise, in numbered versions.

A merge writes the tables that it changes to folders of its own and then creates the next file of ``versions``, which
names the folder of each table; the file of the largest number that can be read is the store's state. A file is never
replaced: of two writers that start from one version the second gets ``ConcurrentWrite``, and a merge that
is interrupted leaves the version before it. Tables are merged by anti-joins and full outer joins on their keys.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.shared import kept
from siftline.operators.redundancy import redundancy
from siftline.plans.views import Tables

VERSION = 70
SCHEMAS = {
    "blob": "blob_id string, size long, mime_essence string, charset string",
    "blob_provenance": "blob_id string, provenance string",
    "blob_source_span": "blob_id string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long",
    "rule": "rule_structural_id string, name string, text_id string, pattern string, categories array<string>, syntax string",
    "finding": "finding_id string, rule_structural_id string, groups_json string",
    "match": "match_id string, finding_id string, blob_id string, start_byte long, end_byte long, before binary, matching binary, after binary",
    "match_status": "match_id string, status string",
    "match_comment": "match_id string, comment string",
    "finding_comment": "finding_id string, comment string",
    "match_score": "match_id string, score double",
    "match_redundancy": "match_id string, redundant_to string",
}
KEYS = {
    "blob": ["blob_id"], "blob_provenance": ["blob_id", "provenance"], "blob_source_span": ["blob_id", "start_byte", "end_byte"], "rule": ["rule_structural_id"], "finding": ["finding_id"],
    "match": ["match_id"], "match_status": ["match_id"], "match_comment": ["match_id"], "finding_comment": ["finding_id"], "match_score": ["match_id"], "match_redundancy": ["match_id", "redundant_to"],
}


def insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it hasn't; the first stays."""
    new = new.select(*old.columns).dropDuplicates(keys)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    new = new.select(*old.columns).dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rules are added; of one that is known only the syntax (with pattern and categories) is brought up to date."""
    fresh = new.select(F.col("rule_structural_id"), *[F.col(c).alias(f"_{c}") for c in ("name", "text_id", "pattern", "categories", "syntax")]).dropDuplicates(["rule_structural_id"])
    both = old.join(fresh, "rule_structural_id", "full")
    return both.select("rule_structural_id", F.coalesce("name", "_name").alias("name"), F.coalesce("text_id", "_text_id").alias("text_id"), *[F.coalesce(f"_{c}", c).alias(c) for c in ("pattern", "categories", "syntax")])


def merge_blobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New blobs are added; types that are unknown are filled in."""
    fresh = new.groupBy("blob_id").agg(*[F.first(c, True).alias(f"_{c}") for c in ("size", "mime_essence", "charset")])
    return old.join(fresh, "blob_id", "full").select("blob_id", *[F.coalesce(c, f"_{c}").alias(c) for c in ("size", "mime_essence", "charset")])


class ConcurrentWrite(RuntimeError):
    """Another writer has published since this store was opened or last written to."""


class Store:
    """Opens the store at ``path``, or creates it."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self.meta, self._last = self._state()
        if self.meta is not None:
            if self.meta["version"] != VERSION:
                raise ValueError(f"store version {self.meta['version']}, expected {VERSION}")
        elif create:
            self.meta = {"version": VERSION, "commit": -1, "tables": {}}
            self._publish({})
        else:
            raise FileNotFoundError(self.path)

    def _state(self) -> tuple[dict | None, int]:
        """The newest version that can be read, and the largest number that has been used."""
        folder = self._path(f"{self.path}/versions")
        numbers = sorted((int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(folder)), reverse=True) if self._fs.exists(folder) else []
        for n in numbers:
            try:
                meta = json.loads(self.spark.read.text(self._file(n), wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue  # its writer was interrupted
            return meta, numbers[0]
        return None, numbers[0] if numbers else -1

    def _file(self, n: int) -> str:
        return f"{self.path}/versions/{n:012d}.json"

    def _publish(self, tables: dict[str, str]) -> None:
        n = self._last + 1
        meta = {"version": VERSION, "commit": n, "tables": self.meta["tables"] | tables}
        try:
            stream = self._fs.create(self._path(self._file(n)), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise ConcurrentWrite(f"version {n} of {self.path} has been published by another writer") from e
            raise
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        self.meta, self._last = meta, n

    def table(self, name: str, at: str | None = None) -> DataFrame:
        at = at or self.meta["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{at}")

    def tables(self) -> Tables:
        return {name: self.table(name) for name in SCHEMAS}

    def write(self, changed: Tables) -> dict[str, str]:
        """Writes tables where no version refers to them yet; returns their folders."""
        folders = {name: f"{name}/v{self._last + 1}-{uuid.uuid4().hex[:8]}" for name in changed}
        for name, df in changed.items():
            df.write.parquet(f"{self.path}/{folders[name]}")
        return folders

    def commit(self, changed: Tables) -> None:
        self._publish(self.write(changed))

    def score(self, scores: DataFrame) -> int:
        """Sets the scores (match_id, score) of matches that the store has and returns how many; the later call wins.

        Scores outside of 0 to 1, and null ones, are passed over; of several for one match the highest is taken.
        """
        rows = scores.select("match_id", F.col("score").cast("double")).where("score between 0 and 1 and not isnan(score)").groupBy("match_id").agg(F.max("score").alias("score"))
        rows = kept(rows.join(self.table("match").select("match_id"), "match_id", "left_semi"), "scores")
        self.commit({"match_score": upsert(self.table("match_score"), rows, KEYS["match_score"])})
        return rows.count()

    def record(self, matches: DataFrame, blobs: DataFrame, provenance: DataFrame, rules: DataFrame, blob_metadata: str = "matching") -> int:
        """Merges a scan's results and returns how many matches are new.

        blob_metadata: ``all`` blobs, those ``matching``, or ``none``. The matches are written once, as every table asks
        for them; redundancy is worked out for the blobs among them alone, and all tables are published as one version.
        """
        t = self.tables()
        matches = kept(matches, "matches")
        hit = matches.select("blob_id").distinct()
        rows = blobs.select("blob_id", "size", *[F.col(c) if c in blobs.columns else F.lit(None).cast("string").alias(c) for c in ("mime_essence", "charset")])
        if blob_metadata != "all":
            rows = rows.join(hit, "blob_id", "left_semi")
            provenance = provenance.join(hit, "blob_id", "left_semi")
        if blob_metadata == "none":
            rows = rows.withColumn("mime_essence", F.lit(None).cast("string")).withColumn("charset", F.lit(None).cast("string"))
        new = matches.select("match_id").distinct().join(t["match"].select("match_id"), "match_id", "left_anti").count()
        changed = {
            "rule": merge_rules(t["rule"], rules),
            "blob": merge_blobs(t["blob"], rows),
            "blob_provenance": insert(t["blob_provenance"], provenance, KEYS["blob_provenance"]),
            "blob_source_span": upsert(t["blob_source_span"], matches, KEYS["blob_source_span"]),
            "finding": insert(t["finding"], matches, KEYS["finding"]),
            "match": upsert(t["match"], matches, KEYS["match"]),
        }
        folders = self.write(changed)
        every = self.table("match", folders["match"]).join(hit, "blob_id", "left_semi").join(self.table("finding", folders["finding"]), "finding_id")
        found = redundancy(every, self.table("rule", folders["rule"]))
        folders |= self.write({"match_redundancy": insert(t["match_redundancy"], found, KEYS["match_redundancy"])})
        self._publish(folders)
        return new

    def export(self, target: str) -> None:
        """The current version's tables as one .tgz file on the driver (for stores that fit there)."""
        import tarfile

        with tarfile.open(target, "w:gz") as tar:
            local = self.path.removeprefix("file://")
            tar.add(self._file(self._last).removeprefix("file://"), f"versions/{self._last:012d}.json")
            for at in self.meta["tables"].values():
                tar.add(f"{local}/{at}", at)


def copy_blobs(blobs: DataFrame, matches: DataFrame | None, path: str, mode: str = "all") -> None:
    """Appends blobs to Parquet files (blob_id, content, content_len): all, those matching, or none."""
    if mode == "none":
        return
    rows = blobs if mode == "all" else blobs.join(matches.select("blob_id").distinct(), "blob_id", "left_semi")
    rows.select("blob_id", "content", F.octet_length("content").cast("long").alias("content_len")).write.mode("append").option("compression", "zstd").parquet(path)


def copy_files(blobs: DataFrame, root: str) -> None:
    """Each blob as a file aa/bbbb... below a folder that all executors mount."""

    def write(rows) -> None:
        import os

        for r in rows:
            folder = os.path.join(root, r["blob_id"][:2])
            os.makedirs(folder, exist_ok=True)
            final = os.path.join(folder, r["blob_id"][2:])
            with open(f"{final}.{os.getpid()}", "wb") as f:
                f.write(r["content"])
            os.replace(f"{final}.{os.getpid()}", final)  # a task that runs twice leaves one whole file

    blobs.select("blob_id", "content").foreachPartition(write)
