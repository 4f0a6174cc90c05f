"""Commands over files and a repository."""

import json
import subprocess

from siftline.__main__ import main
from siftline.operators.scan import profile
from siftline.sources import blobs, git, rules

TOKEN = "ghp_" + "a1B2c3D4e5" * 3 + "zzzzzz"


def test_scan_report_and_rules(spark, tmp_path, capsys):
    repo = tmp_path / "in"
    repo.mkdir()

    def do(*args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    do("init", "-q")
    (repo / "d").mkdir()
    (repo / "d" / "a.py").write_text(f"key = '{TOKEN}'\n")
    do("add", ".")
    do("commit", "-qm", "one")
    (repo / "d" / "a.py").write_text("gone\n")
    (repo / "b.txt").write_text("plain\n")
    do("add", ".")
    do("commit", "-qm", "two\n\nmore")
    assert git.is_repository(str(repo)) and not git.is_repository(str(tmp_path))
    seen = {(p := json.loads(r["provenance"]))["first_commit"]["blob_path"]: (p["first_commit"]["commit_metadata"]["message"].strip(), bytes(r["content"])) for r in git.from_repository(spark, str(repo)).where("content != X'676F6E650A'").collect()}
    assert seen == {"d/a.py": ("one", f"key = '{TOKEN}'\n".encode()), "b.txt": ("two\n\nmore", b"plain\n")}

    s = str(tmp_path / "store")
    assert main(["scan", "-d", s, str(repo)], spark) == 0
    assert "1 new of 1 matches" in capsys.readouterr().out
    main(["report", "-d", s, "-f", "json"], spark)
    (finding,) = json.loads(capsys.readouterr().out)
    assert finding["rule_text_id"] == "np.github.1" and finding["matches"][0]["provenance"][0]["first_commit"]["blob_path"] == "d/a.py"
    main(["report", "-d", s, "-f", "sarif"], spark)
    assert json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "d/a.py"
    main(["summarize", "-d", s], spark)
    assert "GitHub" in capsys.readouterr().out
    main(["rules", "list", "-f", "json"], spark)
    assert len(json.loads(capsys.readouterr().out)["rules"]) == 189
    main(["generate", "json-schema"], spark)
    assert json.loads(capsys.readouterr().out)["type"] == "array"


def test_profile(spark):
    rows = blobs.with_ids(spark.createDataFrame([(b"the MIT License, 1.2.3.4 and 1.2.3.5", "{}")], blobs.INPUT))
    hits = {r["rule_structural_id"]: r["hits"] for r in profile(rows, rules.demo()).collect()}
    named = {r.structural_id: r.id for r in rules.demo()}
    assert {named[k]: n for k, n in hits.items() if n} == {"demo.ipv4.1": 2, "demo.license.1": 1}


def test_nested_repositories(tmp_path):
    for args in (["init", "-q", "a/b"], ["init", "-q", "a/b/c/d"], ["init", "-q", "--bare", "e.git"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "plain" / "objects").mkdir(parents=True)
    assert git.repositories(f"file://{tmp_path}") == [str(tmp_path / p) for p in ("a/b", "a/b/c/d", "e.git")]
    assert git.repositories(str(tmp_path / "plain")) == []
