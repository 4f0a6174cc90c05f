"""Command line: python -m siftline COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from siftline.functions.shared import kept
from siftline.operators.scan import profile, scan
from siftline.plans import annotations, report, store, views
from siftline.sources import blobs, git, ignore, rules

DEFAULT_STORE = "siftline.store"


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("siftline")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("-d", "--datastore", default=os.environ.get("SIFTLINE_STORE", DEFAULT_STORE))
        return p

    def with_rules(p: argparse.ArgumentParser) -> None:
        p.add_argument("--rules-path", action="append", default=[])
        p.add_argument("--ruleset", action="append", default=[])
        p.add_argument("--load-builtins", choices=["true", "false"], default="true")

    def with_format(p: argparse.ArgumentParser, *formats: str) -> None:
        p.add_argument("-f", "--format", choices=formats, default=formats[0])
        p.add_argument("-o", "--output")

    p = add("scan", "find matches and merge them into a store")
    p.add_argument("inputs", nargs="*")
    p.add_argument("--git-url", action="append", default=[])
    p.add_argument("--enumerator", action="append", default=[])
    p.add_argument("--max-file-size", type=float, default=100.0, help="MiB; negative for no limit")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--snippet-length", type=int, default=256)
    p.add_argument("--git-clone", choices=["bare", "mirror"], default="bare")
    p.add_argument("--git-history", choices=["full", "none"], default="full")
    p.add_argument("--git-blob-provenance", choices=["first-seen", "minimal"], default="first-seen")
    p.add_argument("--blob-metadata", choices=["matching", "all", "none"], default="matching")
    p.add_argument("--copy-blobs", choices=["none", "matching", "all"], default="none")
    p.add_argument("--copy-blobs-format", choices=["parquet", "files"], default="parquet")
    p.add_argument("--profile-rules", action="store_true")
    with_rules(p)
    p = add("report", "findings with their matches")
    p.add_argument("--max-matches", type=int, default=3)
    p.add_argument("--max-provenance", type=int, default=3)
    p.add_argument("--min-score", type=float, default=0.05)
    p.add_argument("--finding-status", choices=["accept", "reject", "mixed", "null"])
    p.add_argument("--suppress-redundant", choices=["true", "false"], default="true")
    with_format(p, "human", "json", "jsonl", "sarif")
    with_format(add("summarize", "counts by rule"), "human", "json", "jsonl")
    p = add("rules", "list or check rules")
    p.add_argument("action", choices=["list", "check"])
    p.add_argument("--warnings-as-errors", action="store_true")
    p.add_argument("--pedantic", action="store_true")
    with_rules(p)
    with_format(p, "human", "json")
    p = add("datastore", "create or export a store")
    p.add_argument("action", choices=["init", "export"])
    p.add_argument("-o", "--output")
    p = add("annotations", "export or import annotations")
    p.add_argument("action", choices=["export", "import"])
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p = add("generate", "the JSON Schema of reports")
    p.add_argument("action", choices=["json-schema"])
    p.add_argument("-o", "--output")
    return top


def emit(pieces: object, path: str | None) -> None:
    out = open(path, "w", encoding="utf-8") if path else sys.stdout
    for piece in [pieces] if isinstance(pieces, str) else pieces:
        out.write(piece)
    if path:
        out.close()


def known_rules(a: argparse.Namespace) -> rules.Rules:
    known = rules.builtin() if a.load_builtins == "true" else rules.Rules()
    return known.load(*a.rules_path)


def gather(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    limit = int(a.max_file_size * 1024 * 1024) if a.max_file_size >= 0 else -1
    lines = ignore.lines(*a.ignore)
    parts, repos = [], []
    if a.inputs:
        parts.append(blobs.from_files(spark, a.inputs, limit, lines, store=os.path.abspath(a.datastore)))
        if a.git_history == "full":
            repos += sorted({os.path.realpath(r) for p in a.inputs for r in git.repositories(p)})
    for url in sorted(set(a.git_url)):
        ok = spark.createDataFrame([(url,)], "u string").select(blobs.git_url_ok(blobs.F.col("u"))).first()[0]
        if not ok:
            raise SystemExit(f"not a URL that may be cloned: {url}")
        repos.append(git.clone(url, os.path.join(a.datastore, "clones", url.removeprefix("https://").strip("/")), a.git_clone == "mirror"))
    parts += [git.from_repository(spark, r, a.git_blob_provenance == "first-seen", limit, lines) for r in repos]
    for path in a.enumerator:
        good, bad = blobs.from_jsonl(spark, path)
        if n := bad.count():
            print(f"{path}: {n} lines skipped", file=sys.stderr)
        parts.append(good)
    if not parts:
        raise SystemExit("no inputs")
    return blobs.with_ids(reduce(DataFrame.unionByName, parts))


def do_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    chosen = known_rules(a).select(*(a.ruleset or ["default"]))
    s = store.Store(spark, a.datastore)
    inputs = kept(gather(spark, a), "inputs")
    found = blobs.distinct(inputs)
    path = blobs.F.get_json_object("provenance", "$.path")
    kinds = inputs.groupBy("blob_id").agg(blobs.F.min(path).alias("path")).select("blob_id", blobs.guess_type(blobs.F.col("path")).alias("mime_essence"))
    matches = kept(scan(found, chosen, a.snippet_length), "matches")
    n = s.record(matches, found.join(kinds, "blob_id", "left"), blobs.provenance(inputs), rules.frame(spark, chosen), a.blob_metadata)
    if a.copy_blobs_format == "parquet":
        store.copy_blobs(found, matches, f"{a.datastore}/blobs", a.copy_blobs)
    elif a.copy_blobs != "none":
        store.copy_files(found if a.copy_blobs == "all" else found.join(matches.select("blob_id").distinct(), "blob_id", "left_semi"), f"{a.datastore}/blobs")
    t = blobs.statistics(inputs, found).first()
    print(f"Scanned {t['bytes_seen']:,} bytes from {t['blobs_seen']:,} blobs; {n:,} new of {matches.select('match_id').distinct().count():,} matches\n")
    if a.profile_rules:
        for r in profile(found, chosen).limit(20).collect():
            print(f"{r['seconds']:10.3f} s {r['hits']:10,} {r['rule_structural_id']}")
    print(report.summary_text([r.asDict() for r in views.finding_summary(s.tables()).orderBy("rule_name").collect()]), end="")


def do_report(spark: SparkSession, a: argparse.Namespace) -> None:
    t = store.Store(spark, a.datastore, create=False).tables()
    rows = report.findings(report.report(t, a.max_matches, a.max_provenance, a.min_score, a.finding_status, a.suppress_redundant == "true"))
    made = {"human": report.as_text, "json": report.as_json, "jsonl": report.as_jsonl}
    emit(report.as_sarif(rows, list(rules.builtin().rules.values())) if a.format == "sarif" else made[a.format](rows), a.output)


def do_summarize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = [r.asDict() for r in views.finding_summary(store.Store(spark, a.datastore, create=False).tables()).orderBy("rule_name").collect()]
    made = {"human": lambda: report.summary_text(rows), "json": lambda: json.dumps(rows) + "\n", "jsonl": lambda: "".join(json.dumps(r) + "\n" for r in rows)}
    emit(made[a.format](), a.output)


def do_rules(spark: SparkSession, a: argparse.Namespace) -> int:
    known = known_rules(a)
    if a.action == "list":
        listed, sets = list(known.rules.values()), list(known.rulesets.values())
        lines = [f"{r.id:24} {r.name}\n" for r in sorted(listed, key=lambda r: r.id)] + [f"{s.id:24} {s.name} ({len(s.include_rule_ids)} rules)\n" for s in sorted(sets, key=lambda s: s.id)]
        emit(report.rules_json(listed, sets) + "\n" if a.format == "json" else lines, a.output)
        return 0
    problems = rules.lint(known, a.pedantic)
    for level, where, text in problems:
        print(f"{level}: {where}: {text}")
    return int(any(p[0] == "error" or a.warnings_as_errors for p in problems))


def do_datastore(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.action == "init":
        store.Store(spark, a.datastore)
    else:
        store.Store(spark, a.datastore, create=False).export(a.output or a.datastore.rstrip("/") + ".tgz")


def do_annotations(spark: SparkSession, a: argparse.Namespace) -> None:
    s = store.Store(spark, a.datastore, create=False)
    if a.action == "export":
        emit(annotations.export(s.tables()) + "\n", a.output)
    else:
        for r in annotations.import_into(s, *annotations.load(spark, a.input)).collect():
            print(f"{r['kind']}: {r['n']} {r['outcome']}")


def do_generate(spark: SparkSession, a: argparse.Namespace) -> None:
    empty = {name: spark.createDataFrame([], schema) for name, schema in store.SCHEMAS.items()}
    emit(json.dumps(report.json_schema(report.report(empty)), indent=2) + "\n", a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.command == "scan" and a.datastore == DEFAULT_STORE and os.path.exists(DEFAULT_STORE):
        raise SystemExit(f"{DEFAULT_STORE} exists; name a store with -d to add to it")
    a.datastore = os.path.abspath(a.datastore) if "://" not in a.datastore else a.datastore
    spark = spark or SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return globals()[f"do_{a.command}"](spark, a) or 0


if __name__ == "__main__":
    sys.exit(main())
