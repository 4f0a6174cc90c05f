"""Matches, ids, locations and rules on small contents."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.functions import ids, patterns
from siftline.operators.redundancy import redundancy
from siftline.operators.scan import engine, find, point, scan
from siftline.sources import blobs, rules

TOKEN = "ghp_" + "a1B2c3D4e5" * 3 + "zzzzzz"
FILE = f"# settings\nuser=someone\ngh = {TOKEN}\n".encode()


def brute_force(pattern: str, data: bytes) -> list[tuple[int, int]]:
    """All ends, leftmost start of each, from the last end on; what the last kept span contains is dropped."""
    regex, kept = re.compile(b"(?:" + patterns.scoped_flags(pattern).encode() + rb")\Z"), []
    for end in range(len(data), -1, -1):
        if (m := regex.search(data[:end])) and not (kept and kept[-1][0] <= m.start() and m.end() <= kept[-1][1]):
            kept.append(m.span())
    return sorted(kept)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([r"a+b", r"(ab|ba)c?", r"a{2,3}", r"[ab]{2}c"]), st.text("abc", max_size=12))
def test_maximal_spans(pattern, text):
    data = text.encode()
    assert [m.span() for m in find(re.compile(pattern.encode()), data)] == brute_force(pattern, data)


def test_builtin_rules_compile_and_have_groups():
    known = rules.builtin()
    assert (len(known.rules), len(known.select("default")), len(known.select("all"))) == (189, 168, 189)
    for r in known.rules.values():
        assert patterns.compiled(r.pattern).groups >= 1, r.id
    assert not rules.lint(known)  # each has an example, which it matches
    with pytest.raises(ValueError):
        known.select("nothing")


def test_literals_are_in_every_match():
    for r in rules.builtin().rules.values():
        needed = patterns.literals(r.pattern)
        assert needed is None or all(len(x) >= patterns.LEAST for x in needed)
    chosen = [("x", r"(?i)(?:alpha|beta)_[0-9]+"), ("y", r"[0-9]{4}")]
    assert [s for s, *_ in engine(tuple(chosen)).matches(b"BETA_12 and 1234")] == ["x", "y"]
    assert patterns.literals("a|bcd") is None


def test_flags_in_the_middle():
    assert patterns.compiled("(?x) a (?: (?s) b . c ) d  # comment )").fullmatch(b"ab\ncd")
    assert patterns.compiled("[(?s)]").fullmatch(b"?")


def test_points():
    assert [point(b"ab\ncd\re", n) for n in (1, 3, 4, 6, 7)] == [(1, 1), (2, 0), (2, 1), (2, 0), (2, 1)]


def test_ids_and_locations(spark):
    inputs = blobs.with_ids(spark.createDataFrame([(FILE, "{}"), (FILE, '{"n":2}'), (b"", "{}")], blobs.INPUT))
    found = blobs.distinct(inputs)
    sizes = {r["blob_id"]: r["size"] for r in found.collect()}
    assert sizes == {hashlib.sha1(b"blob %d\0" % len(x) + x).hexdigest(): len(x) for x in (FILE, b"")}
    assert "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391" in sizes
    (m,) = scan(found, rules.builtin().select("default"), 4).collect()
    start = FILE.index(TOKEN.encode())
    assert (m["start_byte"], m["end_byte"], m["start_line"], m["start_column"], m["end_column"]) == (start, start + 40, 3, 6, 45)
    assert (m["before"], m["matching"], m["after"], m["groups"]) == (b"h = ", TOKEN.encode(), b"\n", [TOKEN.encode()])
    sid = m["rule_structural_id"]
    assert m["match_id"] == hashlib.sha1(f"{sid}\0{m['blob_id']}\0{start}\0{start + 40}".encode()).hexdigest()
    assert m["finding_id"] == hashlib.sha1(f"{sid}\0{m['groups_json']}".encode()).hexdigest()
    native = found.where("size > 0").select(ids.line_of(found.content, __import__("pyspark").sql.functions.lit(start + 1))).first()[0]
    assert native == 3


def test_redundancy_of_a_generic_rule(spark):
    chosen = rules.demo()
    rows = blobs.with_ids(spark.createDataFrame([(b'token = "' + b"0" * 40 + b'"', "{}")], blobs.INPUT))
    m = scan(blobs.distinct(rows), chosen)
    catalogue = rules.frame(spark, chosen)
    (pair,) = redundancy(m, catalogue).collect()
    of = {r["match_id"]: r["text_id"] for r in m.join(catalogue, "rule_structural_id").collect()}
    assert (of[pair["match_id"]], of[pair["redundant_to"]]) == ("demo.generic.1", "demo.token.1")


def test_lossy_and_escaped(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(b"a\xffb\x1b[0m",)], "x binary").select(ids.lossy(F.col("x")).alias("a"), ids.escaped(F.col("x")).alias("b")).first()
    assert row["a"] == "a�b\x1b[0m" and row["b"] == "a�b\\u{1b}[0m"
