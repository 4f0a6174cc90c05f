"""Repositories on a path that all executors mount: objects, commits and trees as tables, by the git program.

One task lists the objects; the list is dealt to tasks, each of which reads its objects from one ``git cat-file``.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.shared import kept
from siftline.operators import gitgraph
from siftline.sources import ignore


def run(repo: str, *args: str, **more: object) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "safe.directory=*", *args], check=True, capture_output=True, **more).stdout


def is_repository(path: str) -> bool:
    """Whether a repository is at this very path, bare or with a work tree."""
    try:
        top = run(path, "rev-parse", "--absolute-git-dir").decode().strip()
    except (subprocess.CalledProcessError, OSError):
        return False
    return os.path.realpath(top) in (os.path.realpath(path), os.path.realpath(os.path.join(path, ".git")))


def repositories(root: str) -> list[str]:
    """Repositories at or below a folder, bare or with a work tree, in order. Links aren't followed, nor git's own folders entered."""
    found = []
    for path, folders, files in os.walk(root.removeprefix("file://")):
        bare = {"objects", "refs"} <= set(folders) and "HEAD" in files
        if (bare or ".git" in folders or ".git" in files) and is_repository(path):
            found.append(path)
            if bare:
                folders.clear()
        folders[:] = sorted(f for f in folders if f != ".git")
    return found


def clone(url: str, target: str, mirror: bool = False) -> str:
    """Clones a repository, or brings a clone up to date; starts anew where that fails."""
    if is_repository(target):
        try:
            run(target, "fetch", "--prune", "origin", "+refs/heads/*:refs/remotes/origin/*")
            return target
        except subprocess.CalledProcessError:
            import shutil

            shutil.rmtree(target)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    subprocess.run(["git", "clone", "--mirror" if mirror else "--bare", "--quiet", url, target], check=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    return target


def objects(spark: SparkSession, repo: str, max_size: int = -1) -> DataFrame:
    """(object_id, kind, size) of every object; a negative max_size is no limit on blobs.

    One task streams the listing into a table of the shared folder, dealt over as many files as there are cores.
    """
    fields = pa.schema([("object_id", pa.string()), ("kind", pa.string()), ("size", pa.int64())])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with subprocess.Popen(["git", "-C", repo, "-c", "safe.directory=*", "cat-file", "--batch-all-objects", "--batch-check", "--unordered"], stdout=subprocess.PIPE, text=True) as git:
                for lines in batched(git.stdout, 50_000):
                    ids, kinds, sizes = zip(*(line.split() for line in lines), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kinds), pa.array(map(int, sizes), pa.int64())], schema=fields)
            if git.returncode:
                raise OSError(f"the objects of {repo} can't be listed")

    rows = spark.range(1, numPartitions=1).mapInArrow(listing, "object_id string, kind string, size long")
    df = kept(rows.repartition(spark.sparkContext.defaultParallelism, "object_id"), "objects")
    return df if max_size < 0 else df.where(~((F.col("kind") == "blob") & (F.col("size") > max_size)))


def contents(listed: DataFrame, repo: str) -> DataFrame:
    """(object_id, kind, content) of listed objects."""
    fields = pa.schema([("object_id", pa.string()), ("kind", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repo, "-c", "safe.directory=*", "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for batch in batches:
                ids, kinds, held, size = [], [], [], 0
                for i in batch.column(0).to_pylist():
                    git.stdin.write(f"{i}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    data = git.stdout.read(int(head[2])) if len(head) == 3 else None
                    git.stdout.read(1 if len(head) == 3 else 0)
                    if data is None:
                        continue  # an object that has gone since
                    ids.append(i)
                    kinds.append(head[1].decode())
                    held.append(data)
                    size += len(data)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kinds), pa.array(held, pa.binary())], schema=fields)
                        ids, kinds, held, size = [], [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(held, pa.binary())], schema=fields)
            git.stdin.close()

    return listed.select("object_id").mapInArrow(read, "object_id string, kind string, content binary")


def commits(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits (commit_id, tree_id and their metadata) and parents (commit_id, parent_id), parsed by column expressions."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = found.where("kind = 'commit'").select(F.col("object_id").alias("commit_id"), text.alias("text"))
    head, message = F.substring_index("text", "\n\n", 1), F.expr("substring(text, instr(text, '\n\n') + 2)")
    who = {r: rf"(?m)^{r} (.*?) <([^>\n]*)> (\d+ [+-]\d+)$" for r in ("author", "committer")}
    parts = [F.regexp_extract(head, who[r], i).alias(f"{r}_{n}") for r in who for i, n in ((1, "name"), (2, "email"), (3, "timestamp"))]
    rows = rows.select("commit_id", F.regexp_extract(head, r"(?m)^tree ([0-9a-f]+)$", 1).alias("tree_id"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"), *parts, message.alias("message"))
    return rows.drop("parents"), rows.select("commit_id", F.explode("parents").alias("parent_id"))


def tree_entries(found: DataFrame) -> DataFrame:
    """(tree_id, name, kind, child_id) of all trees; what follows a broken entry is left out."""
    fields = pa.schema([(n, pa.string()) for n in ("tree_id", "name", "kind", "child_id")])
    kinds = {"40000": "tree", "100755": "blob_exec", "120000": "link", "160000": "commit"}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                while 0 <= (end := data.find(b"\0", at)) <= len(data) - 21:
                    mode, _, rest = data[at:end].partition(b" ")
                    at = end + 21
                    rows.append((tree, rest.decode("utf-8", "replace"), kinds.get(mode.decode("latin-1"), "blob"), data[end + 1 : at].hex()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], schema=fields)

    return found.where("kind = 'tree'").select("object_id", "content").mapInArrow(parse, "tree_id string, name string, kind string, child_id string")


def from_repository(spark: SparkSession, repo: str, history: bool = True, max_size: int = -1, ignore_lines: list[str] | None = None) -> DataFrame:
    """All blobs of a repository as inputs (content, provenance); with ``history`` the commits that introduced them.

    A blob is left out if every path at which it was first seen is ignored; one without a path is kept.
    """
    listed = objects(spark, repo, max_size)
    data = contents(listed.where("kind = 'blob'"), repo).select(F.col("object_id").alias("blob_id"), "content")
    plain = F.struct(F.lit("git_repo").alias("kind"), F.lit(repo).alias("repo_path"))
    if not history:
        return data.select("content", F.to_json(plain).alias("provenance"))
    inner = contents(listed.where("kind in ('commit', 'tree')"), repo)
    about, parents = commits(inner)
    seen = gitgraph.first_seen(gitgraph.introduced(about.select("commit_id", "tree_id"), tree_entries(inner), parents), parents)
    seen = seen.withColumn("ignored", ignore.ignored(F.col("path"), ignore_lines or []))
    keep = seen.groupBy("blob_id").agg(F.min("ignored").alias("gone")).where("gone").select("blob_id")
    metadata = F.struct(*[c for c in about.columns if c != "tree_id"])
    seen = seen.where("not ignored").join(about.select("commit_id", metadata.alias("commit_metadata")), "commit_id")
    first = F.struct("commit_metadata", F.col("path").alias("blob_path"))
    rows = data.join(keep, "blob_id", "left_anti").join(seen.select("blob_id", first.alias("first_commit")), "blob_id", "left")
    detailed = F.struct(F.lit("git_repo").alias("kind"), F.lit(repo).alias("repo_path"), "first_commit")
    return rows.select("content", F.when(F.col("first_commit").isNull(), F.to_json(plain)).otherwise(F.to_json(detailed)).alias("provenance"))
