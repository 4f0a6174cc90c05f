"""Queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import ids, patterns
from siftline.functions.shared import folder, kept
from siftline.operators import gitgraph
from siftline.operators.redundancy import redundancy
from siftline.operators.scan import scan
from siftline.plans import annotations, report, views
from siftline.plans.store import Store
from siftline.plans.views import Tables
from siftline.sources import blobs, ignore, rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inputs(spark: SparkSession, sf_dir: str, name: str = "documents", text: str = "text", key: str = "doc_id") -> DataFrame:
    return blobs.with_ids(blobs.from_table(table(spark, sf_dir, name), text, key, name))


def matches(spark: SparkSession, sf_dir: str, snippet: int = 256) -> DataFrame:
    return scan(blobs.distinct(inputs(spark, sf_dir)), rules.demo(), snippet)


def store_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a store after a scan of documents, with statuses, comments and scores by rule of thumb.

    The scan's result is written once, as the views read it many times.
    """
    m = kept(matches(spark, sf_dir))
    found = blobs.distinct(inputs(spark, sf_dir)).join(m.select("blob_id").distinct(), "blob_id", "left_semi")
    first, second = F.substring("match_id", 1, 1), F.substring("match_id", 2, 1)
    catalogue = rules.frame(spark, rules.demo())
    return {
        "blob": found.select("blob_id", "size", F.lit(None).cast("string").alias("mime_essence"), F.lit(None).cast("string").alias("charset")),
        "blob_provenance": blobs.provenance(inputs(spark, sf_dir)).join(m.select("blob_id").distinct(), "blob_id", "left_semi"),
        "blob_source_span": m.select("blob_id", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column").distinct(),
        "rule": catalogue,
        "finding": m.select("finding_id", "rule_structural_id", "groups_json").distinct(),
        "match": m.select("match_id", "finding_id", "blob_id", "start_byte", "end_byte", "before", "matching", "after"),
        "match_status": m.select("match_id", F.when(first < "6", "accept").when(first < "b", "reject").alias("status")).where("status is not null"),
        "match_comment": m.where(first == "0").select("match_id", F.lit("seen").alias("comment")),
        "finding_comment": m.where(F.substring("finding_id", 1, 1) < "2").select("finding_id", F.lit("known").alias("comment")).distinct(),
        "match_score": m.where(second < "8").select("match_id", (F.length("matching") % 8 / 8.0).alias("score")),
        "match_redundancy": redundancy(m, catalogue),
    }


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(source: str, text: str = "text") -> str:
    """SQL for the matches of the demo rules: lengths of what lies between matches give the offsets."""
    parts = []
    for r in rules.demo():
        p = _text(r.pattern)
        parts.append(f"""SELECT blob_id, text, '{r.structural_id}' AS rule_structural_id, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, 1) AS vals,
        regexp_split_to_array(text, {p}) AS parts FROM d WHERE regexp_matches(text, {p})""")
    union = "\nUNION ALL ".join(parts)
    named = ", ".join(f"('{r.structural_id}', {_text(r.name)}, '{r.id}', {len(r.pattern)}, {str('generic' in r.categories).lower()}, {str('fuzzy' in r.categories).lower()})" for r in rules.demo())
    return f"""
    rule AS (SELECT * FROM (VALUES {named}) r(rule_structural_id, rule_name, rule_text_id, pattern_len, generic, fuzzy)),
    p AS (SELECT doc_id, text, blob_id FROM (SELECT {source}, sha1(concat('blob ', strlen({text}), chr(0), {text})) AS blob_id)),
    d AS (SELECT DISTINCT text, blob_id FROM p),
    h AS ({union}),
    s AS (SELECT blob_id, text, rule_structural_id, hits[i] AS matching, vals[i] AS g,
        CAST(coalesce(list_sum([strlen(x) for x in parts[1:i]]), 0) + coalesce(list_sum([strlen(x) for x in hits[1:i-1]]), 0) AS BIGINT) AS start_byte,
        CAST(coalesce(list_sum([length(x) for x in parts[1:i]]), 0) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS BIGINT) AS start_char
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
    m0 AS (SELECT *, CAST(start_byte + strlen(matching) AS BIGINT) AS end_byte, concat('["', base64(encode(g)), '"]') AS groups_json FROM s),
    m AS (SELECT *, sha1(concat(rule_structural_id, chr(0), blob_id, chr(0), start_byte, chr(0), end_byte)) AS match_id, sha1(concat(rule_structural_id, chr(0), groups_json)) AS finding_id FROM m0)"""


def _documents() -> str:
    return _spans("doc_id, text").replace("AS blob_id))", "AS blob_id FROM documents WHERE text IS NOT NULL))")


MATCHES = "WITH" + _documents()
REDUNDANT = """,
    about AS (SELECT m.*, pattern_len, generic, fuzzy, 1 AS num_groups, length(groups_json) AS groups_len, end_byte - start_byte AS match_len FROM m JOIN rule USING (rule_structural_id)),
    o AS (SELECT a.match_id AS x, b.match_id AS y FROM about a JOIN about b ON a.blob_id = b.blob_id AND a.match_id <> b.match_id AND a.start_byte <= b.start_byte AND b.start_byte < a.end_byte
        AND (a.end_byte - b.start_byte) / a.match_len::DOUBLE >= 0.2 AND (a.end_byte - b.start_byte) / b.match_len::DOUBLE >= 0.2),
    sym AS (SELECT x, y FROM o UNION SELECT y, x FROM o),
    red AS (SELECT DISTINCT a.match_id, b.match_id AS redundant_to FROM sym JOIN about a ON a.match_id = x JOIN about b ON b.match_id = y
        WHERE (NOT b.generic OR a.generic) AND b.num_groups >= a.num_groups AND (b.num_groups <> a.num_groups OR b.groups_len > a.groups_len OR NOT b.fuzzy
        OR (b.groups_len = a.groups_len AND b.match_len < a.match_len) OR b.pattern_len > a.pattern_len))"""
NOTES = """,
    st AS (SELECT * FROM (SELECT DISTINCT match_id, CASE WHEN match_id[1] < '6' THEN 'accept' WHEN match_id[1] < 'b' THEN 'reject' END AS status FROM m) WHERE status IS NOT NULL),
    mc AS (SELECT DISTINCT match_id, 'seen' AS comment FROM m WHERE match_id[1] = '0'),
    fc AS (SELECT DISTINCT finding_id, 'known' AS comment FROM m WHERE finding_id[1] < '2'),
    sc AS (SELECT DISTINCT match_id, strlen(matching) % 8 / 8.0 AS score FROM m WHERE match_id[2] < '8'),
    fd AS (SELECT finding_id, any_value(rule_structural_id) AS rule_structural_id, any_value(rule_name) AS rule_name, any_value(groups_json) AS groups_json, count(*) AS num_matches,
        count(*) FILTER (m.match_id IN (SELECT match_id FROM red)) AS num_redundant_matches, avg(score) AS mean_score, any_value(fc.comment) AS comment,
        coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses
        FROM m JOIN rule USING (rule_structural_id) LEFT JOIN st USING (match_id) LEFT JOIN sc USING (match_id) LEFT JOIN fc USING (finding_id) GROUP BY finding_id)"""
STORE = MATCHES + REDUNDANT + NOTES


@query("SELECT doc_id, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def blob_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.blob_id(content).alias("blob_id"), F.octet_length("text").cast("long").alias("size"))


@query("""SELECT blob_id, count(*) AS n_inputs, min(doc_id) AS first_doc, CAST(any_value(strlen(text)) AS BIGINT) AS size FROM
    (SELECT doc_id, text, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob_id FROM documents WHERE text IS NOT NULL) GROUP BY blob_id""")
def blob_dedup_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir)
    doc = F.get_json_object("provenance", "$.payload.key").cast("long")
    return blobs.distinct(rows).select("blob_id", "size").join(blobs.provenance(rows).groupBy("blob_id").agg(F.count(F.lit(1)).alias("n_inputs"), F.min(doc).alias("first_doc")), "blob_id")


@query("""SELECT count(*) AS blobs_seen, CAST(sum(strlen(text)) AS BIGINT) AS bytes_seen, (SELECT count(DISTINCT text) FROM documents) AS blobs_scanned,
    (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)) AS bytes_scanned FROM documents WHERE text IS NOT NULL""")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).select("blob_id", "size", F.lit(b"").alias("content"))
    return blobs.statistics(rows, blobs.distinct(rows))


@query(MATCHES + " SELECT match_id, finding_id, blob_id, rule_structural_id, start_byte, end_byte, groups_json, matching FROM m")
def scan_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", "finding_id", "blob_id", "rule_structural_id", "start_byte", "end_byte", "groups_json", ids.lossy(F.col("matching")).alias("matching"))


@query(MATCHES + r""" SELECT match_id, 1 + length(a) - length(replace(a, chr(10), '')) AS start_line, CAST(strlen(regexp_replace(a, '(?s)^.*[\n\r]', '')) AS BIGINT) AS start_column,
    1 + length(b) - length(replace(b, chr(10), '')) AS end_line, CAST(strlen(regexp_replace(b, '(?s)^.*[\n\r]', '')) AS BIGINT) AS end_column
    FROM (SELECT match_id, left(text, start_char + 1) AS a, left(text, start_char + length(matching)) AS b FROM m)""")
def match_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", "start_line", "start_column", "end_line", "end_column")


@query(MATCHES + r""", c AS (SELECT match_id, left(text, start_char + 1) AS a FROM m)
    SELECT match_id, 1 + length(a) - length(replace(a, chr(10), '')) AS start_line, CAST(strlen(regexp_replace(a, '(?s)^.*[\n\r]', '')) AS BIGINT) AS start_column FROM c""")
def match_locations_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations by column expressions, for spans whose contents are at hand."""
    found = matches(spark, sf_dir).select("match_id", "blob_id", "start_byte")
    content = blobs.distinct(inputs(spark, sf_dir)).select("blob_id", "content")
    n = F.col("start_byte") + 1
    return found.join(content, "blob_id").select("match_id", ids.line_of(F.col("content"), n).alias("start_line"), ids.column_of(F.col("content"), n).alias("start_column"))


@query(MATCHES + """ SELECT match_id, lower(substr(x, greatest(start_byte - 16, 0) * 2 + 1, least(start_byte, 16) * 2)) AS before_hex, lower(substr(x, start_byte * 2 + 1, (end_byte - start_byte) * 2)) AS matching_hex,
    lower(substr(x, end_byte * 2 + 1, 32)) AS after_hex FROM (SELECT *, hex(encode(text)) AS x FROM m)""")
def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir, 16).select("match_id", *[F.lower(F.hex(c)).alias(f"{c}_hex") for c in ("before", "matching", "after")])


@query(MATCHES + " SELECT finding_id, rule_structural_id, groups_json, count(*) AS num_matches FROM m GROUP BY ALL")
def finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).groupBy("finding_id", "rule_structural_id", "groups_json").agg(F.count(F.lit(1)).alias("num_matches"))


@query(STORE + """ SELECT m.match_id, finding_id, blob_id, rule_name, rule_text_id, start_byte, CAST(strlen(text) AS BIGINT) AS num_bytes, status, mc.comment, score FROM m JOIN rule USING (rule_structural_id)
    LEFT JOIN st USING (match_id) LEFT JOIN mc USING (match_id) LEFT JOIN sc USING (match_id)""")
def match_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.match_denorm(store_tables(spark, sf_dir)).select("match_id", "finding_id", "blob_id", "rule_name", "rule_text_id", "start_byte", "num_bytes", "status", "comment", "score")


@query(MATCHES + " SELECT DISTINCT blob_id, CAST(strlen(text) AS BIGINT) AS size, NULL::VARCHAR AS mime_essence, NULL::VARCHAR AS charset FROM m")
def blob_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.blob_denorm(store_tables(spark, sf_dir))


PROVENANCE = """ concat('{"kind":"extended","payload":{"table":"documents","key":', doc_id, '}}')"""


@query(MATCHES + f" SELECT DISTINCT p.blob_id, CAST(strlen(p.text) AS BIGINT) AS size, {PROVENANCE} AS provenance FROM p JOIN m ON p.blob_id = m.blob_id")
def blob_provenance_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.blob_provenance_denorm(store_tables(spark, sf_dir))


@query(STORE + " SELECT finding_id, rule_name, num_matches, num_redundant_matches, mean_score, statuses, comment FROM fd")
def finding_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.finding_denorm(store_tables(spark, sf_dir)).select("finding_id", "rule_name", "num_matches", "num_redundant_matches", "mean_score", F.concat_ws(",", "statuses").alias("statuses"), "comment")


@query(STORE + """ SELECT rule_name, count(*) AS distinct_count, CAST(sum(num_matches) AS BIGINT) AS total_count, count(*) FILTER (statuses = 'accept') AS accept_count,
    count(*) FILTER (statuses = 'reject') AS reject_count, count(*) FILTER (statuses = 'accept,reject') AS mixed_count, count(*) FILTER (statuses = '') AS unlabeled_count FROM fd GROUP BY rule_name""")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.finding_summary(store_tables(spark, sf_dir)).orderBy("rule_name")


@query(STORE + " SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM fd) AS findings")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("finding_id").alias("findings"))


@query(MATCHES + REDUNDANT + " SELECT * FROM red")
def match_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy(kept(matches(spark, sf_dir)), rules.frame(spark, rules.demo()))


@query(STORE + " SELECT match_id, string_agg(redundant_to, ',' ORDER BY redundant_to) AS redundant_to FROM red GROUP BY match_id")
def match_redundant_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.redundant_to(store_tables(spark, sf_dir)).select("match_id", F.concat_ws(",", "redundant_to").alias("redundant_to"))


TOP = " SELECT finding_id, match_id, place FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY blob_id, start_byte, end_byte) AS place FROM m"


@query(STORE + TOP + " WHERE match_id NOT IN (SELECT match_id FROM red)) WHERE place <= 3")
def report_topk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_matches(store_tables(spark, sf_dir)).select("finding_id", "match_id", F.col("place").cast("long").alias("place"))


@query(MATCHES + f""" SELECT blob_id, string_agg(provenance, '|' ORDER BY provenance) AS provenance FROM (SELECT blob_id, provenance, row_number() OVER (PARTITION BY blob_id ORDER BY provenance) AS place
    FROM (SELECT DISTINCT p.blob_id, {PROVENANCE} AS provenance FROM p JOIN m ON p.blob_id = m.blob_id)) WHERE place <= 3 GROUP BY blob_id""")
def report_topk_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_provenance(store_tables(spark, sf_dir)).select("blob_id", F.concat_ws("|", "provenance").alias("provenance"))


@query(STORE + " SELECT finding_id, rule_name, num_matches FROM fd WHERE num_redundant_matches < num_matches AND (mean_score IS NULL OR mean_score >= 0.05)")
def report_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.finding_metadata(store_tables(spark, sf_dir)).select("finding_id", "rule_name", "num_matches")


@query(STORE + """ SELECT finding_id, statuses AS status FROM fd WHERE statuses IN ('accept', 'reject')
    UNION ALL SELECT finding_id, 'mixed' FROM fd WHERE statuses = 'accept,reject' UNION ALL SELECT finding_id, 'null' FROM fd WHERE statuses = ''""")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.finding_denorm(store_tables(spark, sf_dir)).select("finding_id", "statuses")
    parts = [t.where(report.status_is(F.col("statuses"), s)).select("finding_id", F.lit(s).alias("status")) for s in ("accept", "reject", "mixed", "null")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(STORE + " SELECT finding_id, mean_score FROM fd WHERE mean_score IS NULL OR mean_score >= 0.5")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.finding_denorm(store_tables(spark, sf_dir))
    return t.where(report.score_ok(F.col("mean_score"), 0.5)).select("finding_id", "mean_score")


@query(STORE + """, t AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY blob_id, start_byte, end_byte) AS place FROM m WHERE match_id NOT IN (SELECT match_id FROM red))
    SELECT fd.finding_id, rule_name, num_matches, num_redundant_matches, statuses, count(place) AS shown, any_value(t.match_id) FILTER (place = 1) AS first_match FROM fd LEFT JOIN t ON t.finding_id = fd.finding_id AND place <= 3
    WHERE num_redundant_matches < num_matches AND (mean_score IS NULL OR mean_score >= 0.05) GROUP BY ALL""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report itself, one plan; here with the nested matches counted."""
    r = report.report(store_tables(spark, sf_dir))
    return r.select("finding_id", "rule_name", "num_matches", "num_redundant_matches", F.concat_ws(",", "statuses").alias("statuses"), F.size("matches").cast("long").alias("shown"), F.get("matches", F.lit(0))["structural_id"].alias("first_match"))


@query(STORE + """ SELECT 'match' AS kind, m.match_id AS id, status, mc.comment FROM m LEFT JOIN st USING (match_id) LEFT JOIN mc USING (match_id) WHERE status IS NOT NULL OR mc.comment IS NOT NULL
    UNION ALL SELECT 'finding', finding_id, NULL, comment FROM fc""")
def annotations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store_tables(spark, sf_dir)
    m = annotations.match_annotations(t).select(F.lit("match").alias("kind"), F.col("match_id").alias("id"), "status", "comment")
    return m.unionByName(annotations.finding_annotations(t).select(F.lit("finding").alias("kind"), F.col("finding_id").alias("id"), F.lit(None).cast("string").alias("status"), "comment"))


@query(STORE + """, notes AS (SELECT DISTINCT match_id, 'accept' AS status FROM m UNION ALL SELECT sha1(CAST(range AS VARCHAR)), 'reject' FROM range(5))
    SELECT match_id, notes.status AS status, CASE WHEN match_id NOT IN (SELECT match_id FROM m) THEN 'missing' WHEN st.status = notes.status THEN 'existing' WHEN st.status IS NOT NULL THEN 'conflicting' ELSE 'imported' END AS outcome
    FROM notes LEFT JOIN st USING (match_id)""")
def annotations_import_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store_tables(spark, sf_dir)
    strange = spark.range(5).select(F.sha1(F.col("id").cast("string")).alias("match_id"), F.lit("reject").alias("status"))
    notes = t["match"].select("match_id", F.lit("accept").alias("status")).unionByName(strange)
    return annotations.outcomes(notes, t["match"], t["match_status"], "match_id", "status")


@query(f"SELECT * FROM (VALUES {', '.join(f'({_text(r.id)}, {_text(c)}, {len(r.pattern)})' for r in rules.demo() for c in r.categories if c in ('generic', 'fuzzy'))}) t(text_id, category, pattern_length)")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the generic and the fuzzy category, with the length of their pattern."""
    rows = rules.frame(spark, rules.demo()).select("text_id", F.explode("categories").alias("category"), F.length("pattern").alias("pattern_length"))
    return rows.where(F.col("category").isin("generic", "fuzzy"))


@query("SELECT * FROM (VALUES ('default', 168), ('np.assets', 15), ('np.hashes', 6), ('all', 189)) t(ruleset, n_rules)")
def ruleset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulesets resolved to rules by an exploding join; each id once."""
    known = rules.builtin()
    sets = [(s.id, list(s.include_rule_ids)) for s in known.rulesets.values()] + [("all", sorted(known.rules))]
    members = spark.createDataFrame(sets, "ruleset string, ids array<string>").select("ruleset", F.explode("ids").alias("text_id")).distinct()
    return members.join(rules.frame(spark, list(known.rules.values())).select("text_id"), "text_id").groupBy("ruleset").agg(F.count(F.lit(1)).cast("int").alias("n_rules"))


@query("SELECT * FROM (VALUES ('warning', 'x.2', 'in no ruleset'), ('error', 'x.2', 'no capture group'), ('error', 'x.1', 'example 1 does not match'), ('warning', 'x.2', 'no examples'), ('error', 's', 'unknown rule x.3')) t(level, id, problem)")
def rule_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = rules.Rules({"x.1": rules.Rule("x.1", "One", "a(b+)", examples=("ab", "ac")), "x.2": rules.Rule("x.2", "Two", "ab")}, {"s": rules.Ruleset("s", "S", "", ("x.1", "x.3"))})
    return spark.createDataFrame(rules.lint(bad), "level string, id string, problem string")


def _counts(name: str, text: str) -> str:
    body = MATCHES.replace("SELECT doc_id, text, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob_id FROM documents WHERE text IS NOT NULL", f"SELECT 0 AS doc_id, {text} AS text, sha1(concat('blob ', strlen({text}), chr(0), {text})) AS blob_id FROM {name} WHERE {text} IS NOT NULL")
    return body + " SELECT rule_name, count(*) AS num_matches, count(DISTINCT finding_id) AS num_findings FROM m JOIN rule USING (rule_structural_id) GROUP BY rule_name"


def _by_rule(spark: SparkSession, found: DataFrame) -> DataFrame:
    named = rules.frame(spark, rules.demo()).select("rule_structural_id", F.col("name").alias("rule_name"))
    return found.join(named, "rule_structural_id").groupBy("rule_name").agg(F.count(F.lit(1)).alias("num_matches"), F.count_distinct("finding_id").alias("num_findings"))


@query(_counts("pages", "html"))
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(spark, scan(blobs.distinct(inputs(spark, sf_dir, "pages", "html", "page_id")), rules.demo()))


@query(_counts("conversations", "text"))
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(spark, scan(blobs.distinct(inputs(spark, sf_dir, "conversations", "text", "conv_id")), rules.demo()))


@query(_counts("(SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM conversations)", "text"))
def cross_source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = inputs(spark, sf_dir).unionByName(inputs(spark, sf_dir, "pages", "html", "page_id")).unionByName(inputs(spark, sf_dir, "conversations", "text", "conv_id"))
    return _by_rule(spark, scan(blobs.distinct(every), rules.demo()))


def _builtin_sql() -> str:
    """Each default rule's pattern, in plain form, searched by the SQL engine in the examples and in documents."""
    known = rules.builtin().select("default")
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    made = ", ".join(f"({quoted(r.id)}, {quoted(r.examples[0])})" for r in known)
    texts = f"WITH texts AS (SELECT * FROM (VALUES {made}) t(source, text) UNION ALL SELECT 'documents', text FROM documents) "
    return texts + " UNION ALL ".join(f"SELECT source, {quoted(r.id)} AS text_id, count(*) AS n_texts FROM texts WHERE regexp_matches(text, {quoted(patterns.plain(r.pattern))}) GROUP BY source" for r in known)


@query(_builtin_sql())
def scan_builtin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which default rules match which rule's example, and how many documents (the test tables hold few or none that they match)."""
    known = rules.builtin().select("default")
    examples = spark.createDataFrame([(r.id, r.examples[0]) for r in known], "source string, text string")
    texts = examples.unionByName(table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")).where("text is not null")
    rows = texts.select(ids.blob_id(F.col("text").cast("binary")).alias("blob_id"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"), "source")
    found = scan(blobs.distinct(rows), known).select("blob_id", "rule_structural_id").distinct()
    named = rules.frame(spark, known).select("rule_structural_id", "text_id")
    return rows.select("blob_id", "source").join(found, "blob_id").join(named, "rule_structural_id").groupBy("source", "text_id").agg(F.count(F.lit(1)).alias("n_texts"))


@query("""SELECT sha1(concat('blob ', strlen(text), chr(0), text)) AS blob_id, concat('{"kind":"extended","payload":{"doc":', doc_id, '}}') AS provenance FROM documents""")
def jsonl_enumerator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with content, with content in base64, and broken ones, which are put aside."""
    docs = table(spark, sf_dir, "documents")
    origin = F.struct(F.col("doc_id").alias("doc")).alias("provenance")
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").alias("content_base64")
    line = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(coded, origin))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), origin)))
    broken = table(spark, sf_dir, "nation").select(F.concat(F.lit('{"content": "cut o'), "n_name").alias("value"))
    good, _ = blobs.parse_jsonl(docs.select(line.alias("value")).unionByName(broken))
    return blobs.with_ids(good).select("blob_id", "provenance")


GIT_SQL = """WITH RECURSIVE edges AS (SELECT n_nationkey AS child, n_nationkey - 1 AS parent FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0),
    contains AS (SELECT n_nationkey AS c, concat('b', n_nationkey * 7 % 11) AS blob_id FROM nation UNION SELECT n_nationkey, concat('b', n_nationkey % 4 + 20) FROM nation),
    anc AS (SELECT child AS c, parent AS a FROM edges UNION SELECT anc.c, edges.parent FROM anc JOIN edges ON anc.a = edges.child)
    SELECT CAST(c AS VARCHAR) AS commit_id, blob_id, concat('d/', blob_id) AS path FROM contains x WHERE NOT EXISTS (SELECT 1 FROM anc JOIN contains y ON y.c = anc.a WHERE anc.c = x.c AND y.blob_id = x.blob_id)"""


@query(GIT_SQL)
def git_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of a small history (made of the nations) with the commits that introduced them; trees are expanded first."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    name = lambda c: c.cast("string")
    commits = n.select(name(F.col("n")).alias("commit_id"), F.concat(F.lit("root"), "n").alias("tree_id"))
    parents = n.where("n > 0").select(name(F.col("n")).alias("commit_id"), F.explode(F.array_distinct(F.array(name(F.col("n") - 1), name(F.expr("n div 2"))))).alias("parent_id"))
    root = n.select(F.concat(F.lit("root"), "n").alias("tree_id"), F.lit("d").alias("name"), F.lit("tree").alias("kind"), F.concat(F.lit("sub"), "n").alias("child_id"))
    held = F.explode(F.array(F.concat(F.lit("b"), F.col("n") * 7 % 11), F.concat(F.lit("b"), F.col("n") % 4 + 20))).alias("child_id")
    sub = n.select(F.concat(F.lit("sub"), "n").alias("tree_id"), held).select("tree_id", F.col("child_id").alias("name"), F.lit("blob").alias("kind"), "child_id")
    return gitgraph.first_seen(gitgraph.introduced(commits, root.unionByName(sub), parents), parents).select("commit_id", "blob_id", "path")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) <= 2000")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.octet_length("text") <= 2000).select("doc_id", F.octet_length("text").cast("long").alias("size"))


IGNORE = ["*.pem", "/site1*/", "**/page/1*", "!**/page/12*", "page/?3"]


@query(r"""SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
    WHERE NOT CASE WHEN regexp_matches(path, '^(?:.*/)?page/12[^/]*(?:/.*)?$') THEN false ELSE regexp_matches(path, '^(?:.*/)?[^/]*\.pem(?:/.*)?$|^site1[^/]*/.*$|^(?:.*/)?page/1[^/]*(?:/.*)?$') END
    AND NOT regexp_matches(path, '^page/[^/]3(?:/.*)?$')""")
def ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return rows.where(~ignore.ignored(F.col("path"), IGNORE))


@query("""SELECT page_id, (starts_with(u, 'https://') AND NOT contains(u, '?') AND NOT contains(u, '#') AND NOT contains(u, '@') AND NOT contains(u, '/../')) AS ok FROM
    (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('https://h.example/r', page_id) WHEN 1 THEN concat('http://h.example/r', page_id) WHEN 2 THEN 'https://u:p@h.example/r' WHEN 3 THEN 'https://h.example/r?x=1' WHEN 4 THEN 'https://h.example/a/../r' ELSE 'https://h.example/r#f' END AS u FROM pages)""")
def git_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.concat(F.lit("https://h.example/r"), "page_id")).when(k == 1, F.concat(F.lit("http://h.example/r"), "page_id"))
    url = url.when(k == 2, "https://u:p@h.example/r").when(k == 3, "https://h.example/r?x=1").when(k == 4, "https://h.example/a/../r").otherwise("https://h.example/r#f")
    return table(spark, sf_dir, "pages").select("page_id", blobs.git_url_ok(url).alias("ok"))


@query("SELECT DISTINCT concat('https://h.example/', c_name) AS clone_url FROM customer WHERE c_custkey % 3 <> 0")
def repository_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://h.example/"), "c_name").alias("clone_url"), (F.col("c_custkey") % 3 == 0).alias("fork"))
    return blobs.repositories(repos)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'text/x-python' WHEN 1 THEN 'application/json' END AS mime FROM part")
def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a/b"), "p_partkey", F.element_at(F.array(F.lit(".py"), F.lit(".JSON"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", blobs.guess_type(name).alias("mime"))


@query(STORE + """ SELECT (SELECT count(*) FROM m) AS first_new, CAST(0 AS BIGINT) AS second_new, (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM fd) AS findings, (SELECT count(*) FROM red) AS redundant,
    (SELECT count(DISTINCT blob_id) FROM m) AS blobs""")
def store_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store filled twice from the same input: nothing is new the second time."""
    store, chosen = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}"), rules.demo()
    rows = inputs(spark, sf_dir)
    found, new = blobs.distinct(rows), []
    for _ in range(2):
        m = kept(scan(found, chosen))
        new.append(store.record(m, found, blobs.provenance(rows), rules.frame(spark, chosen)))
    counts = [store.table(t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("match", "matches"), ("finding", "findings"), ("match_redundancy", "redundant"), ("blob", "blobs"))]
    out = spark.createDataFrame([(new[0], new[1])], "first_new long, second_new long")
    for c in counts:
        out = out.join(c)  # one row each
    return out


def entry(spark: SparkSession) -> DataFrame:
    return finding_summary(spark, "/root/testdata/sf0.001")
