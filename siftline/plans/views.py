"""Read-side views over the store's tables. Keys are content-derived ids, so every join is an equi-join of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def match_denorm(t: Tables) -> DataFrame:
    """Every match with its finding, source span, blob, rule, snippet, status, comment and score."""
    m = t["match"].join(t["finding"], "finding_id", "left")
    m = m.join(t["blob_source_span"], ["blob_id", "start_byte", "end_byte"], "left").join(t["blob"].select("blob_id", F.col("size").alias("num_bytes")), "blob_id", "left")
    m = m.join(t["rule"].select("rule_structural_id", F.col("name").alias("rule_name"), F.col("text_id").alias("rule_text_id")), "rule_structural_id", "left")
    for name, value in (("match_status", "status"), ("match_comment", "comment"), ("match_score", "score")):
        m = m.join(t[name].select("match_id", value), "match_id", "left")
    return m


def blob_denorm(t: Tables) -> DataFrame:
    return t["blob"].select("blob_id", "size", "mime_essence", "charset")


def blob_provenance_denorm(t: Tables) -> DataFrame:
    return t["blob"].select("blob_id", "size").join(t["blob_provenance"], "blob_id")


def finding_denorm(t: Tables) -> DataFrame:
    """One row for each finding: counts with redundant matches in and apart, mean score, comment, distinct statuses."""
    redundant = t["match_redundancy"].select("match_id").distinct().withColumn("redundant", F.lit(1))
    m = t["match"].join(redundant, "match_id", "left").join(t["match_status"].select("match_id", "status"), "match_id", "left").join(t["match_score"].select("match_id", "score"), "match_id", "left")
    per = m.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("num_matches"), F.count("redundant").alias("num_redundant_matches"), F.avg("score").alias("mean_score"), F.array_sort(F.collect_set("status")).alias("statuses"))
    rules = t["rule"].select("rule_structural_id", F.col("name").alias("rule_name"), F.col("text_id").alias("rule_text_id"), "syntax")
    return t["finding"].join(per, "finding_id").join(rules, "rule_structural_id", "left").join(t["finding_comment"].select("finding_id", "comment"), "finding_id", "left")


def finding_summary(t: Tables) -> DataFrame:
    """Counts by rule name: findings, matches, and findings by status."""
    f = finding_denorm(t)
    one = F.when(F.size("statuses") == 2, "mixed").when(F.size("statuses") == 1, F.get("statuses", F.lit(0)))
    f = f.select("rule_name", "num_matches", one.alias("status"))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("accept", "reject", "mixed")]
    return f.groupBy("rule_name").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("num_matches").alias("total_count"), *counts, F.count_if(F.col("status").isNull()).alias("unlabeled_count"))
