"""Histories beside plain loops."""

import random

import pytest

from siftline.operators import gitgraph


def brute(holds, parents):
    """Rows of ``holds`` (commit, blob, path) none of whose proper ancestors holds the blob."""
    above = {}

    def ancestors(c):
        if c not in above:
            above[c] = set().union(*[{p} | ancestors(p) for p in sorted(parents.get(c, ()))])
        return above[c]

    for c in sorted({c for c, _, _ in holds}):  # parents have smaller numbers, so the recursion stays flat
        ancestors(c)
    by_blob = {}
    for c, b, _ in holds:
        by_blob.setdefault(b, set()).add(c)
    return sorted({(c, b, p) for c, b, p in holds if not ancestors(c) & by_blob[b]})


def tables(spark, commits, entries, parents):
    edges = [(f"{c:05d}", f"{p:05d}") for c, ps in parents.items() for p in ps]
    return (
        spark.createDataFrame([(f"{c:05d}", t) for c, t in commits], "commit_id string, tree_id string"),
        spark.createDataFrame(entries, "tree_id string, name string, kind string, child_id string"),
        spark.createDataFrame(edges, "commit_id string, parent_id string"),
    )


def found(df):
    return sorted((int(r["commit_id"]), r["blob_id"], r["path"]) for r in df.collect())


@pytest.mark.parametrize("edges", [gitgraph.EDGES, 0])
def test_many_merges(spark, monkeypatch, edges):
    """Trees of two levels that change by a file, are restored, and moved; half of the commits are merges."""
    monkeypatch.setattr(gitgraph, "EDGES", edges)
    monkeypatch.setattr(gitgraph, "SWEPT", 3)
    draw = random.Random(7)
    n = 60 if edges else 16
    parents = {c: sorted(set(draw.sample(range(max(0, c - 6), c), min(c, draw.choice([1, 1, 2, 3]))))) for c in range(1, n)}
    commits, entries, holds = [], set(), []
    states = {}
    for c in range(n):
        state = dict(states[parents[c][0]]) if c else {(d, f): f"b{d}{f}" for d in "xy" for f in "pq"}
        place = (draw.choice("xy"), draw.choice("pqr"))
        state[place] = f"b{draw.randrange(12)}"
        states[c] = state
        tree = []
        for d in sorted({d for d, _ in state}):
            files = tuple(sorted((f, b) for (e, f), b in state.items() if e == d))
            entries.update((f"t{files}", f, "blob", b) for f, b in files)
            tree.append((d, f"t{files}"))
        entries.update((f"r{tuple(tree)}", d, "tree", t) for d, t in tree)
        entries.add((f"r{tuple(tree)}", "module", "commit", "m"))
        commits.append((c, f"r{tuple(tree)}"))
        seen = {}
        for d, t in tree:
            seen.setdefault(t, d)
        holds += [(c, b, f"{d}/{f}") for (d, f), b in state.items() if seen[dict(tree)[d]] == d]
    about, inner, edges_ = tables(spark, commits, sorted(entries), parents)
    seen = gitgraph.introduced(about, inner, edges_)
    assert found(gitgraph.first_seen(seen, edges_)) == brute(holds, parents)


def test_a_long_line(spark):
    """2,000 commits in a line: few jobs, however long the line is."""
    n = 2_000
    parents = {c: [c - 1] for c in range(1, n)}
    entries = [(f"t{c}", "f", "blob", f"b{c % 1500}") for c in range(n)]
    about, inner, edges = tables(spark, [(c, f"t{c}") for c in range(n)], entries, parents)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("line", "")
    rows = found(gitgraph.first_seen(gitgraph.introduced(about, inner, edges), edges))
    jobs = len(status.getJobIdsForGroup("line"))
    spark.sparkContext._jsc.clearJobGroup()
    assert rows == [(c, f"b{c}", "f") for c in range(1500)]
    assert jobs < 40


def test_cycles_and_nothing(spark, monkeypatch):
    about, inner, _ = tables(spark, [(1, "t"), (2, "t")], [("t", "f", "blob", "b")], {})
    nothing = spark.createDataFrame([], "commit_id string, parent_id string")
    assert found(gitgraph.first_seen(gitgraph.introduced(about, inner, nothing), nothing)) == [(1, "b", "f"), (2, "b", "f")]
    assert found(gitgraph.first_seen(gitgraph.introduced(about.limit(0), inner.limit(0), nothing), nothing)) == []
    ring = spark.createDataFrame([("1", "2"), ("2", "1"), ("3", None)], "commit_id string, parent_id string")
    holds = spark.createDataFrame([("1", "b", "f"), ("2", "b", "f")], "commit_id string, blob_id string, path string")
    for limit in (gitgraph.EDGES, 0):
        monkeypatch.setattr(gitgraph, "EDGES", limit)
        with pytest.raises(ValueError, match="cycle"):
            gitgraph.first_seen(holds, ring)
