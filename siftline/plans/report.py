"""Reports: findings with their first matches and provenance in one plan, and their formats."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import ids
from siftline.plans import views
from siftline.plans.views import Tables


def finding_metadata(t: Tables, status: str | None = None, min_score: float = 0.05, suppress_redundant: bool = True) -> DataFrame:
    """Findings that a report shows: not all redundant, of the status asked for, not under the score."""
    f = views.finding_denorm(t)
    if suppress_redundant:
        f = f.where("num_redundant_matches < num_matches")
    return f.where(status_is(F.col("statuses"), status) & score_ok(F.col("mean_score"), min_score))


def status_is(statuses: Column, status: str | None) -> Column:
    wanted = {"accept": ["accept"], "reject": ["reject"], "mixed": ["accept", "reject"], "null": []}
    if status is None:
        return F.lit(True)
    return statuses == F.array(*[F.lit(s) for s in wanted[status]]).cast("array<string>")


def score_ok(score: Column, least: float) -> Column:
    return F.lit(True) if least <= 0 else score.isNull() | (score >= least)


def top_matches(t: Tables, limit: int = 3, suppress_redundant: bool = True) -> DataFrame:
    """The first matches of each finding by blob and place; a limit of 0 or less is none."""
    m = t["match"]
    if suppress_redundant:
        m = m.join(t["match_redundancy"].select("match_id").distinct(), "match_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("finding_id").orderBy("blob_id", "start_byte", "end_byte"))
    m = m.withColumn("place", place)
    return m if limit <= 0 else m.where(F.col("place") <= limit)


def top_provenance(t: Tables, limit: int = 3) -> DataFrame:
    """(blob_id, provenance array): the first by JSON text, then without repositories' plain entries beside detailed ones."""
    p = t["blob_provenance"].withColumn("place", F.row_number().over(Window.partitionBy("blob_id").orderBy("provenance")))
    p = p if limit <= 0 else p.where(F.col("place") <= limit)
    p = p.groupBy("blob_id").agg(F.array_sort(F.collect_list("provenance")).alias("provenance"))

    def field(x: Column, name: str) -> Column:
        return F.get_json_object(x, f"$.{name}")

    def plain(x: Column) -> Column:
        return (field(x, "kind") == "git_repo") & field(x, "first_commit").isNull()

    detailed = F.transform(F.filter("provenance", lambda x: (field(x, "kind") == "git_repo") & field(x, "first_commit").isNotNull()), lambda x: field(x, "repo_path"))
    return p.select("blob_id", F.filter("provenance", lambda x: ~(plain(x) & F.array_contains(detailed, field(x, "repo_path")))).alias("provenance"))


def redundant_to(t: Tables) -> DataFrame:
    return t["match_redundancy"].groupBy("match_id").agg(F.array_sort(F.collect_set("redundant_to")).alias("redundant_to"))


def report(t: Tables, max_matches: int = 3, max_provenance: int = 3, min_score: float = 0.05, status: str | None = None, suppress_redundant: bool = True) -> DataFrame:
    """One row for each finding, its matches nested, in the order of rule name, rule, mean score and groups."""
    m = top_matches(t, max_matches, suppress_redundant)
    m = m.join(t["blob_source_span"], ["blob_id", "start_byte", "end_byte"], "left").join(views.blob_denorm(t), "blob_id", "left")
    m = m.join(top_provenance(t, max_provenance), "blob_id", "left").join(redundant_to(t), "match_id", "left")
    for name, value in (("match_status", "status"), ("match_comment", "comment"), ("match_score", "score")):
        m = m.join(t[name].select("match_id", value), "match_id", "left")
    one = F.struct(
        "place",
        F.coalesce("provenance", F.array().cast("array<string>")).alias("provenance"),
        F.struct(F.col("blob_id").alias("id"), F.col("size").alias("num_bytes"), "mime_essence", "charset").alias("blob_metadata"),
        "blob_id",
        F.struct(
            F.struct(F.col("start_byte").alias("start"), F.col("end_byte").alias("end")).alias("offset_span"),
            F.struct(F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column")).alias("start"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("end")).alias("source_span"),
        ).alias("location"),
        F.struct(ids.lossy(F.col("before")).alias("before"), ids.lossy(F.col("matching")).alias("matching"), ids.lossy(F.col("after")).alias("after")).alias("snippet"),
        F.col("match_id").alias("structural_id"), "score", "comment", "status",
        F.coalesce("redundant_to", F.array().cast("array<string>")).alias("redundant_to"),
    )
    nested = m.select("finding_id", one.alias("m")).groupBy("finding_id").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    f = finding_metadata(t, status, min_score, suppress_redundant).join(nested, "finding_id", "left")
    f = f.orderBy("rule_name", "rule_structural_id", F.desc_nulls_last("mean_score"), "groups_json")
    return f.select(
        "finding_id", "rule_name", "rule_text_id", "rule_structural_id", F.from_json("groups_json", "array<string>").alias("groups"), "num_matches", "num_redundant_matches",
        "statuses", "comment", "mean_score", F.transform("matches", lambda x: x.dropFields("place")).alias("matches"))


def _plain(row) -> dict:
    out = {k: v for k, v in row.asDict(recursive=True).items() if v is not None or k not in ("comment", "mean_score")}
    for m in out.get("matches") or []:
        m["provenance"] = [json.loads(p) for p in m["provenance"]]
        m["rule_structural_id"], m["rule_name"], m["rule_text_id"], m["groups"] = (out[k] for k in ("rule_structural_id", "rule_name", "rule_text_id", "groups"))
    return out


def findings(df: DataFrame) -> Iterator[dict]:
    """One finding at a time: a report is streamed to the driver, never held there."""
    return map(_plain, df.toLocalIterator())


def as_json(rows: Iterator[dict]) -> Iterator[str]:
    yield "[\n"
    for i, row in enumerate(rows):
        yield (",\n" if i else "") + json.dumps(row, ensure_ascii=False)
    yield "\n]\n"


def as_jsonl(rows: Iterator[dict]) -> Iterator[str]:
    return (json.dumps(row, ensure_ascii=False) + "\n" for row in rows)


def as_sarif(rows: Iterator[dict], rules: list, tool: str = "siftline") -> str:
    """SARIF 2.1.0: a result for each finding, a location for each match and provenance."""
    results = []
    for f in rows:
        locations = []
        for m in f["matches"]:
            span = m["location"]["source_span"]
            for p in m["provenance"]:
                about = {"blob_metadata": m["blob_metadata"]}
                if p.get("first_commit"):
                    about["commit_provenance"] = {"blob_path": p["first_commit"].get("blob_path"), "commit_kind": "first_seen", "commit_metadata": p["first_commit"].get("commit_metadata")}
                path = p.get("path") or (p.get("first_commit") or {}).get("blob_path") or (p.get("payload") or {}).get("path") if isinstance(p.get("payload") or {}, dict) else None
                region = {"startLine": span["start"]["line"], "startColumn": span["start"]["column"], "endLine": span["end"]["line"], "endColumn": span["end"]["column"] + 1, "snippet": {"text": m["snippet"]["matching"]}}
                locations.append({"physicalLocation": {"artifactLocation": {"uri": path} if path else {}, "region": region}, "logicalLocations": [{"kind": "blob", "name": m["blob_id"], "properties": about}]})
        n = f["num_matches"]
        text = f'Rule "{f["rule_name"]}" found {n} {"match" if n == 1 else "matches"}.\nFirst blob id matched: {f["matches"][0]["blob_id"]}'
        results.append({"ruleId": f["rule_name"], "message": {"text": text}, "kind": "review", "level": "warning", "locations": locations, "partialFingerprints": {"match_group_content/sha256/v1": f["finding_id"]}})
    described = [{"id": r.name, "shortDescription": {"text": r.pattern}, "help": {"text": "\n".join(r.references)}} for r in rules]
    run = {"tool": {"driver": {"name": tool, "rules": described}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}) + "\n"


def as_text(rows: Iterator[dict]) -> Iterator[str]:
    """For people: a paragraph for each finding, its matches indented."""
    for i, f in enumerate(rows, 1):
        lines = [f"Finding {i} (id {f['finding_id']})", f"Rule: {f['rule_name']}"]
        if f["statuses"]:
            lines.append("Status: " + ("Mixed" if len(f["statuses"]) > 1 else f["statuses"][0].capitalize()))
        if f.get("mean_score") is not None:
            lines.append(f"Score: {f['mean_score']:.3f}")
        if f.get("comment"):
            lines.append(f"Comment: {f['comment']}")
        many = len(f["groups"]) > 1
        for k, g in enumerate(f["groups"], 1):
            lines.append(f"Group{f' {k}' if many else ''}: {shown(base64.b64decode(g))}")
        if len(f["matches"]) != f["num_matches"]:
            lines.append(f"Showing {len(f['matches'])}/{f['num_matches']} matches:")
        for k, m in enumerate(f["matches"], 1):
            meta, span = m["blob_metadata"], m["location"]["source_span"]
            lines += ["", f"    Match {k}/{f['num_matches']} (id {m['structural_id']})"]
            if m["redundant_to"]:
                lines.append("    Redundant to: " + ", ".join(m["redundant_to"]))
            lines += [f"    {name.capitalize()}: {m[name]}" for name in ("status", "score", "comment") if m.get(name) is not None]
            for p in m["provenance"]:
                kind = {"file": "File", "git_repo": "Git repo"}.get(p.get("kind"), "Extended provenance")
                lines.append(f"    {kind}: {p.get('path') or p.get('repo_path') or json.dumps(p.get('payload'))}")
            lines.append(f"    Blob: {meta['id']} ({meta['num_bytes']} bytes, {meta['mime_essence'] or 'unknown type'}, {meta['charset'] or 'unknown charset'})")
            lines.append(f"    Lines: {span['start']['line']}:{span['start']['column']}-{span['end']['line']}:{span['end']['column']}")
            lines += ["", *("        " + x for x in shown((m["snippet"]["before"] + m["snippet"]["matching"] + m["snippet"]["after"]).encode()).split("\n"))]
        yield "\n".join(lines) + "\n\n"


def shown(raw: bytes) -> str:
    """Text for a terminal, control characters made visible."""
    return "".join(c if c in "\n\t" or not (ord(c) < 32 or 127 <= ord(c) < 160) else f"\\u{{{ord(c):x}}}" for c in raw.decode("utf-8", "replace"))


def summary_text(rows: list[dict]) -> str:
    """Findings by rule name as a table; columns of statuses only if any finding has one."""
    labelled = any(r["accept_count"] or r["reject_count"] or r["mixed_count"] for r in rows)
    names = {"rule_name": "Rule", "distinct_count": "Findings", "total_count": "Matches"}
    if labelled:
        names |= {"accept_count": "Accepted", "reject_count": "Rejected", "mixed_count": "Mixed", "unlabeled_count": "Unlabeled"}
    cells = [list(names.values()), *[[f"{r[k]:,}" if isinstance(r[k], int) else str(r[k]) for k in names] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(c, widths, strict=True))) for c in cells) + "\n"


def rules_json(rules: list, rulesets: list) -> str:
    """Rules by id with sorted categories, and rulesets with the number of their rules."""
    listed = [{"id": r.id, "structural_id": r.structural_id, "name": r.name, "syntax": {"name": r.name, "id": r.id, "pattern": r.pattern, "categories": sorted(r.categories)}} for r in sorted(rules, key=lambda r: r.id)]
    return json.dumps({"rules": listed, "rulesets": [{"id": s.id, "name": s.name, "num_rules": len(s.include_rule_ids)} for s in sorted(rulesets, key=lambda s: s.id)]})


def json_schema(df: DataFrame) -> dict:
    """A JSON Schema of the report, derived from the plan's own schema."""

    def of(kind) -> dict:
        name = kind.typeName()
        if name == "struct":
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
        if name == "array":
            return {"type": "array", "items": of(kind.elementType)}
        return {"type": {"long": "integer", "integer": "integer", "double": "number", "boolean": "boolean"}.get(name, "string")}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "array", "items": of(df.schema)}
