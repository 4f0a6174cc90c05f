"""The pipeline's stages, each beside brute force on its own input, and the registration of all queries."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from tests.conftest import rows_of
from tests.llm.test_operators import brute_components, sets_of

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1 for n in range(1, 11))


def test_stages(spark, docs, tmp_path):
    rows, kept = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(rows)
        rows = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns
    near = {r["doc_id"] for r in kept[2].collect()}
    want = brute_components(sets_of(kept[1]))
    assert near == {i for i, c in want.items() if i == c}
    assert {r["doc_id"] for r in kept[3].collect()} == near
    times = Counter(r["doc_id"] for r in kept[4].collect())
    assert set(times.values()) <= {1, 2} and set(times) <= near
    final = rows.collect()
    assert Counter(r["doc_id"] for r in final) == times and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in final)


def test_same_rows_as_sql(spark, oracle):
    for name, sql in __spark_entry__.llm_queries.oracle_sql().items():
        assert rows_of(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows_of(oracle(sql))
