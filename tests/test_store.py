"""Merging, reports, annotations, sources, history and streams."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import gitgraph
from siftline.operators.scan import scan
from siftline.plans import annotations, report, store, views
from siftline.sources import blobs, ignore, rules
from siftline.streaming import incremental

TOKEN = b'token = "' + b"0" * 39 + b'1"'


def filled(spark, path, contents, snippet=256):
    s, chosen = store.Store(spark, str(path)), rules.demo()
    rows = blobs.with_ids(spark.createDataFrame(contents, blobs.INPUT))
    found = blobs.distinct(rows)
    n = s.record(scan(found, chosen, snippet), found, blobs.provenance(rows), rules.frame(spark, chosen))
    return s, n


def test_rescan_and_report(spark, tmp_path):
    contents = [(b"-" * 30 + TOKEN, json.dumps({"kind": "file", "path": f"f{i}"})) for i in range(4)] + [(b"nothing", '{"kind":"file","path":"g"}')]
    s, n = filled(spark, tmp_path / "s", contents, 4)
    assert n == 2 and s.table("blob").count() == 1 and s.table("blob_provenance").count() == 4
    s, n = filled(spark, tmp_path / "s", contents, 8)  # longer snippets: nothing new, texts brought up to date
    assert n == 0 and {len(r["before"]) for r in s.table("match").collect()} == {8}
    assert s.table("match_redundancy").count() == 1
    (f,) = report.findings(report.report(s.tables()))
    assert f["rule_text_id"] == "demo.token.1" and f["num_matches"] == 1 and len(f["matches"][0]["provenance"]) == 3
    assert len(report.report(s.tables(), max_provenance=-1, suppress_redundant=False).collect()) == 2
    assert json.loads("".join(report.as_json(iter([f]))))[0]["finding_id"] == f["finding_id"]
    sarif = json.loads(report.as_sarif(iter([f]), rules.demo()))
    assert sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["endColumn"] == f["matches"][0]["location"]["source_span"]["end"]["column"] + 1
    assert "Showing" not in "".join(report.as_text(iter([f]))) and "demo" not in report.summary_text([r.asDict() for r in views.finding_summary(s.tables()).collect()])
    assert report.json_schema(report.report(s.tables()))["items"]["type"] == "object"
    s.export(str(tmp_path / "out.tgz"))
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "other"), create=False)


def test_annotations_round_trip(spark, tmp_path):
    contents = [(TOKEN, '{"kind":"file","path":"a"}')]
    s, _ = filled(spark, tmp_path / "a", contents)
    ids = sorted(r[0] for r in s.table("match").select("match_id").collect())
    finding = s.table("finding").first()["finding_id"]
    notes = spark.createDataFrame([(ids[0], "accept", "good"), (ids[1], "reject", None), ("gone", "accept", None)], "match_id string, status string, comment string")
    about = spark.createDataFrame([(finding, "why")], "finding_id string, comment string")
    counts = {(r[0], r[1]): r[2] for r in annotations.import_into(s, notes, about).collect()}
    assert counts == {("match_status", "imported"): 2, ("match_status", "missing"): 1, ("match_comment", "imported"): 1, ("finding_comment", "imported"): 1}
    again = {(r[0], r[1]): r[2] for r in annotations.import_into(s, notes.withColumn("status", F.lit("accept")), about).collect()}
    assert again[("match_status", "existing")] == 1 and again[("match_status", "conflicting")] == 1
    (tmp_path / "notes.json").write_text(annotations.export(s.tables()))
    other, _ = filled(spark, tmp_path / "b", contents)
    annotations.import_into(other, *annotations.load(spark, str(tmp_path / "notes.json")))
    assert annotations.export(other.tables()) != "" and other.table("match_status").count() == 2
    assert {tuple(r["statuses"]) for r in views.finding_denorm(other.tables()).collect()} == {("accept",), ("reject",)}


def test_provenance_of_repositories(spark, tmp_path):
    detailed = {"kind": "git_repo", "repo_path": "r", "first_commit": {"blob_path": "p"}}
    contents = [(TOKEN, json.dumps(x)) for x in ({"kind": "git_repo", "repo_path": "r"}, detailed, {"kind": "git_repo", "repo_path": "q"})]
    s, _ = filled(spark, tmp_path / "s", contents)
    kept = [json.loads(p) for p in report.top_provenance(s.tables()).first()["provenance"]]
    assert len(kept) == 2 and detailed in kept


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"one", "big.txt": b"x" * 100, "b/keep.dat": b"two", "b/skip.dat": b"three"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    root = str(tmp_path / "in")
    assert blobs.from_files(spark, [root], max_size=-1).count() == 4
    got = {json.loads(r["provenance"])["path"].split("/in/")[1]: bytes(r["content"]) for r in blobs.from_files(spark, [root, root], 50, ["*.dat", "!keep.dat"]).collect()}
    assert got == {"a.txt": b"one", "b/keep.dat": b"two"}
    with pytest.raises(ValueError):
        blobs.from_files(spark, [])


@pytest.mark.parametrize(("rules_", "path", "hit"), [
    (["*.dat"], "a/b.dat", True), (["/x"], "a/x", False), (["/x"], "x/y", True), (["d/"], "d", False), (["d/"], "a/d/f", True), (["**/test"], "a/b/test", True),
    (["a/**"], "a/b/c", True), (["a/**"], "a", False), (["*.dat", "!k.dat"], "k.dat", False), (["# c", ""], "c", False), (["f[0-9]"], "f7", True), (["*"], "", False),
])
def test_ignore(spark, rules_, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(ignore.ignored(F.col("p"), rules_)).first()[0] is hit


def test_builtin_ignore_lines():
    assert all(ignore.to_regex(line) for line in ignore.lines() if line and not line.startswith("#"))


def test_jsonl(spark):
    lines = ['{"content":"a","provenance":"p"}', '{"content_base64":"/w==","provenance":{"x":1}}', "broken", '{"provenance":1}', ""]
    good, bad = blobs.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((bytes(r[0]), json.loads(r[1])["payload"]) for r in good.collect()) == [(b"a", "p"), (b"\xff", {"x": 1})]
    assert good.count() == 2 and bad.count() == 3


def test_copies(spark, tmp_path):
    rows = blobs.distinct(blobs.with_ids(spark.createDataFrame([(TOKEN, "{}"), (b"plain", "{}")], blobs.INPUT)))
    hits = scan(rows, rules.demo())
    store.copy_blobs(rows, hits, str(tmp_path / "m"), "matching")
    store.copy_blobs(rows, hits, str(tmp_path / "m"), "none")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    store.copy_files(rows, str(tmp_path / "files"))
    assert len([p for p in (tmp_path / "files").rglob("*") if p.is_file()]) == 2


def test_history(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "commit_id string, parent_id string")
    holds = spark.createDataFrame([("a", "1", "p"), ("b", "1", "p"), ("b", "2", "q"), ("c", "2", "r"), ("d", "2", "q"), ("d", "3", "s")], "commit_id string, blob_id string, path string")
    assert sorted(map(tuple, gitgraph.first_seen(holds, parents).select("commit_id", "blob_id").collect())) == [("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")]
    with pytest.raises(ValueError):
        gitgraph.first_seen(holds, spark.createDataFrame([("a", "b"), ("b", "a")], "commit_id string, parent_id string"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"content": TOKEN.decode(), "provenance": {"n": 1}})
    for batch in (1, 2):
        (tmp_path / "in" / f"{batch}.jsonl").write_text(line + "\n")
        q = incremental.scan_stream(incremental.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "store"), rules.demo(), str(tmp_path / "c"), every=None)
        q.awaitTermination()
    s = store.Store(spark, str(tmp_path / "store"), create=False)
    assert s.table("match").count() == 2 and s.table("blob").count() == 1


def test_scores(spark, tmp_path):
    s, _ = filled(spark, tmp_path / "s", [(TOKEN, '{"kind":"file","path":"a"}')])
    a, b = sorted(r[0] for r in s.table("match").select("match_id").collect())
    rows = [(a, 0.2), (a, 0.4), (b, 1.5), (b, None), (b, float("nan")), ("gone", 0.5), (None, 0.1)]
    assert s.score(spark.createDataFrame(rows, "match_id string, score double")) == 1
    assert s.score(spark.createDataFrame([(a, 0.7), (b, 0.0)], "match_id string, score double")) == 2
    assert {tuple(r) for r in store.Store(spark, str(tmp_path / "s")).table("match_score").collect()} == {(a, 0.7), (b, 0.0)}


def test_two_writers_and_an_interrupted_one(spark, tmp_path):
    contents = [(TOKEN, '{"kind":"file","path":"a"}')]
    s, _ = filled(spark, tmp_path / "s", contents)
    before = {tuple(r) for r in s.table("match").select("match_id").collect()}
    first, second = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    empty = spark.createDataFrame([], store.SCHEMAS["match_score"])
    first.commit({"match_score": empty})
    with pytest.raises(store.ConcurrentWrite):
        second.commit({"match_score": empty})
    first.write({"match": first.table("match").where("false")})  # interrupted before it is published
    (tmp_path / "s" / "versions" / f"{first._last + 1:012d}.json").write_text('{"version": 7')  # or while it was
    again, n = filled(spark, tmp_path / "s", contents)
    assert n == 0 and {tuple(r) for r in again.table("match").select("match_id").collect()} == before
    assert again.meta["commit"] == first._last + 2


def test_a_rule_id_used_twice(tmp_path):
    rule = "- {name: N, id: own.x.1, pattern: '(abc)', examples: [abc]}\n"
    (tmp_path / "a.yml").write_text("rules:\n" + rule + rule)
    assert ("error", "own.x.1", "id used more than once") in rules.lint(rules.Rules().load(tmp_path))
