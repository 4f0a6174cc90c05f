"""Scanning blobs: containment-maximal matches of every rule, with groups, snippets and locations.

One pass of an automaton over each blob tells which rules' literals it holds; only those rules' patterns
(and those without literals) are searched. This is the one crossing into Python; ids, joins and everything
after are column expressions.
"""

from __future__ import annotations

import re
import time
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import ids, patterns
from siftline.sources.rules import Rule

try:
    import ahocorasick
except ImportError:  # the search of single literals takes its place
    ahocorasick = None


def find(regex: re.Pattern[bytes], data: bytes) -> list[re.Match[bytes]]:
    """Matches none of which contains another one: at each start after the last one's, if the end moves on."""
    found, at, end = [], 0, -1
    while m := regex.search(data, at):
        if m.end() > end:
            found.append(m)
            end = m.end()
        at = m.start() + 1
    return found


@cache
def engine(rules: tuple[tuple[str, str], ...]) -> Engine:
    return Engine(rules)


class Engine:
    """Compiled rules of one process."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = [(sid, patterns.compiled(p)) for sid, p in rules]
        self.always: list[int] = []
        by_literal: dict[bytes, list[int]] = {}
        for i, (_, p) in enumerate(rules):
            needed = patterns.literals(p)
            if needed is None:
                self.always.append(i)
            for literal in needed or ():
                by_literal.setdefault(literal, []).append(i)
        self.by_literal = by_literal
        self.automaton = None
        if ahocorasick is not None and by_literal:
            self.automaton = ahocorasick.Automaton()
            for literal, which in by_literal.items():
                self.automaton.add_word(literal.decode("latin-1"), which)
            self.automaton.make_automaton()

    def candidates(self, data: bytes) -> list[int]:
        low = data.lower()
        chosen = set(self.always)
        if self.automaton is not None:
            for _, which in self.automaton.iter(low.decode("latin-1")):
                chosen.update(which)
        else:
            for literal, which in self.by_literal.items():
                if literal in low:
                    chosen.update(which)
        return sorted(chosen)

    def matches(self, data: bytes) -> Iterator[tuple[str, int, int, list[bytes]]]:
        for i in self.candidates(data):
            sid, regex = self.rules[i]
            for m in find(regex, data):
                yield sid, m.start(), m.end(), [g for g in m.groups() if g is not None]


def point(data: bytes, n: int) -> tuple[int, int]:
    """Line and column after the first n bytes: \\n begins a line, \\r returns to column 0."""
    return 1 + data.count(b"\n", 0, n), n - 1 - max(data.rfind(b"\n", 0, n), data.rfind(b"\r", 0, n))


SPAN = (
    "blob_id string, rule_structural_id string, start_byte long, end_byte long, groups array<binary>, before binary, matching binary, after binary, "
    "start_line long, start_column long, end_line long, end_column long"
)
SPAN_ARROW = pa.schema([
    ("blob_id", pa.string()), ("rule_structural_id", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("groups", pa.list_(pa.binary())),
    ("before", pa.binary()), ("matching", pa.binary()), ("after", pa.binary()), *[(n, pa.int64()) for n in ("start_line", "start_column", "end_line", "end_column")],
])


def scan(blobs: DataFrame, rules: list[Rule], snippet: int = 256) -> DataFrame:
    """Matches in ``blobs`` (blob_id, content), with match_id, finding_id and the groups as JSON."""
    spark = blobs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    chosen = tuple((r.structural_id, r.pattern) for r in rules)
    engine(chosen)  # fails on the driver if a pattern can't be compiled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = engine(chosen)
        for batch in batches:
            rows = []
            for blob, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sid, start, end, groups in search.matches(data or b""):
                    rows.append((blob, sid, start, end, groups, data[max(start - snippet, 0) : start], data[start:end], data[end : end + snippet], *point(data, start + 1), *point(data, end)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SPAN_ARROW, strict=True)], schema=SPAN_ARROW)

    spans = blobs.select("blob_id", "content").mapInArrow(run, SPAN)
    spans = spans.withColumn("groups_json", ids.groups_json(F.col("groups")))
    rule, blob = F.col("rule_structural_id"), F.col("blob_id")
    return spans.withColumn("match_id", ids.match_id(rule, blob, F.col("start_byte"), F.col("end_byte"))).withColumn("finding_id", ids.finding_id(rule, F.col("groups_json")))


def profile(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_structural_id, hits, seconds) of each rule that was searched, slowest first: added up by batch in the workers."""
    chosen = tuple((r.structural_id, r.pattern) for r in rules)
    fields = pa.schema([("rule_structural_id", pa.string()), ("hits", pa.int64()), ("seconds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = engine(chosen)
        hits: dict[str, int] = defaultdict(int)
        seconds: dict[str, float] = defaultdict(float)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for i in search.candidates(data or b""):
                    sid, regex = search.rules[i]
                    began = time.perf_counter()
                    hits[sid] += len(find(regex, data or b""))
                    seconds[sid] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.string()), pa.array(list(hits.values()), pa.int64()), pa.array([seconds[s] for s in hits], pa.float64())], schema=fields)

    rows = blobs.select("content").mapInArrow(run, "rule_structural_id string, hits long, seconds double")
    return rows.groupBy("rule_structural_id").agg(F.sum("hits").alias("hits"), F.sum("seconds").alias("seconds")).orderBy(F.desc("seconds"))
