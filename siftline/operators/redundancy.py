"""Which matches another match of the same blob makes redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP = 0.20


def redundancy(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(match_id, redundant_to): pairs of overlapping matches, by an equal blob and a range of starts.

    ``matches``: match_id, blob_id, rule_structural_id, start_byte, end_byte, groups_json; ``rules``:
    rule_structural_id, pattern, categories (a rule set, hundreds of rows). Overlap is measured from the
    later start to the earlier match's end, which may exceed the later match.
    """
    about = rules.select("rule_structural_id", F.length("pattern").alias("pattern_len"), F.array_contains("categories", "generic").alias("generic"), F.array_contains("categories", "fuzzy").alias("fuzzy"))
    rows = matches.join(about, "rule_structural_id").select(
        "match_id", "blob_id", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), "generic", "fuzzy", "pattern_len",
        F.json_array_length("groups_json").alias("num_groups"), F.length("groups_json").alias("groups_len"), (F.col("end_byte") - F.col("start_byte")).alias("match_len"))
    fields = [c for c in rows.columns if c != "blob_id"]
    a = rows.select("blob_id", *[F.col(c).alias(f"a_{c}") for c in fields])
    b = rows.select("blob_id", *[F.col(c).alias(f"b_{c}") for c in fields])
    common = F.col("a_e") - F.col("b_s")
    near = (F.col("a_match_id") != F.col("b_match_id")) & (F.col("a_s") <= F.col("b_s")) & (F.col("b_s") < F.col("a_e"))
    near = near & (common >= OVERLAP * F.col("a_match_len")) & (common >= OVERLAP * F.col("b_match_len"))
    pairs = a.join(b, "blob_id").where(near)

    def loses(x: str, y: str) -> Column:
        """Whether match x is redundant to match y."""
        better = (
            (F.col(f"{y}_num_groups") != F.col(f"{x}_num_groups")) | (F.col(f"{y}_groups_len") > F.col(f"{x}_groups_len")) | ~F.col(f"{y}_fuzzy")
            | ((F.col(f"{y}_groups_len") == F.col(f"{x}_groups_len")) & (F.col(f"{y}_match_len") < F.col(f"{x}_match_len"))) | (F.col(f"{y}_pattern_len") > F.col(f"{x}_pattern_len"))
        )
        return (~F.col(f"{y}_generic") | F.col(f"{x}_generic")) & (F.col(f"{y}_num_groups") >= F.col(f"{x}_num_groups")) & better

    both = F.array(
        F.when(loses("a", "b"), F.struct(F.col("a_match_id").alias("match_id"), F.col("b_match_id").alias("redundant_to"))),
        F.when(loses("b", "a"), F.struct(F.col("b_match_id").alias("match_id"), F.col("a_match_id").alias("redundant_to"))),
    )
    return pairs.select(F.explode(F.array_compact(both)).alias("p")).select("p.match_id", "p.redundant_to").distinct()
