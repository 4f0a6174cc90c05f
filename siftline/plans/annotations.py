"""Annotations (statuses and comments) exported from a store and imported into one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.store import Store
from siftline.plans.views import Tables

MATCH = "finding_id string, rule_name string, rule_text_id string, rule_structural_id string, match_id string, blob_id string, start_byte long, end_byte long, groups array<string>, status string, comment string"
FINDING = "finding_id string, rule_name string, rule_text_id string, rule_structural_id string, groups array<string>, comment string"


def match_annotations(t: Tables) -> DataFrame:
    notes = t["match_status"].join(t["match_comment"], "match_id", "full").where("status is not null or comment is not null")
    rows = notes.join(t["match"], "match_id").join(t["finding"], "finding_id").join(t["rule"], "rule_structural_id")
    return rows.select("finding_id", F.col("name").alias("rule_name"), F.col("text_id").alias("rule_text_id"), "rule_structural_id", "match_id", "blob_id", "start_byte", "end_byte", F.from_json("groups_json", "array<string>").alias("groups"), "status", "comment")


def finding_annotations(t: Tables) -> DataFrame:
    rows = t["finding_comment"].join(t["finding"], "finding_id").join(t["rule"], "rule_structural_id")
    return rows.select("finding_id", F.col("name").alias("rule_name"), F.col("text_id").alias("rule_text_id"), "rule_structural_id", F.from_json("groups_json", "array<string>").alias("groups"), "comment")


def export(t: Tables) -> str:
    """One JSON document; annotations are made by people, so they fit on the driver."""

    def rows(df: DataFrame) -> list[dict]:
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in df.toLocalIterator()]

    return json.dumps({"match_annotations": rows(match_annotations(t)), "finding_annotations": rows(finding_annotations(t))}, separators=(",", ":"), ensure_ascii=False)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    doc = spark.read.schema(f"match_annotations array<struct<{MATCH}>>, finding_annotations array<struct<{FINDING}>>").json(path, multiLine=True)
    return doc.select(F.inline("match_annotations")), doc.select(F.inline("finding_annotations"))


def outcomes(notes: DataFrame, targets: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome) of each annotation: missing target, existing, conflicting (kept as it was) or imported."""
    rows = notes.where(F.col(value).isNotNull()).select(key, value)
    rows = rows.join(targets.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").join(known.select(key, F.col(value).alias("_known")), key, "left")
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_known") == F.col(value), "existing").when(F.col("_known").isNotNull(), "conflicting").otherwise("imported")
    return rows.select(key, value, outcome.alias("outcome"))


def import_into(store: Store, matches: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds what is new in one commit; returns counts (kind, outcome, n)."""
    t = store.tables()
    work = {
        "match_status": outcomes(matches, t["match"], t["match_status"], "match_id", "status"),
        "match_comment": outcomes(matches, t["match"], t["match_comment"], "match_id", "comment"),
        "finding_comment": outcomes(findings, t["finding"], t["finding_comment"], "finding_id", "comment"),
    }
    counts = None
    changed: Tables = {}
    for name, rows in work.items():
        rows = rows.cache()
        n = rows.groupBy("outcome").count().select(F.lit(name).alias("kind"), "outcome", F.col("count").alias("n")).collect()
        counts = [*(counts or []), *n]
        key, value = t[name].columns
        changed[name] = t[name].unionByName(rows.where("outcome = 'imported'").select(key, value).dropDuplicates([key]))
    store.commit(changed)
    return store.spark.createDataFrame(counts, "kind string, outcome string, n long")
