"""Secret scans judged by ownership: how many owners and repositories hold the same candidate.

Patterns find candidates in whole texts; their values are hashed, the hashes counted by distinct
owners and repositories over the corpus, and the counts tell widely copied examples from credentials
that one owner has and that look live. The latter's values get spans of the kind ``live``. Either count
makes a copied example: COPIED owners, or COPIED_REPOSITORIES repositories of whichever owners, where
copies of one text count once, as the repository of least name (near copies count each).

DataFrame functions only. Spans come from the JVM's regex: ``split`` gives the text between matches
and ``regexp_extract_all`` the matches, and running sums of their lengths in code points give the
starts. Sums run in blocks, so a text of many matches costs far less than their square.

Owners and repositories are columns by name (here the source and the document). Hot hashes are
counted after partial aggregation; verdicts are joined to candidates by a plain join of written
tables, whose hot keys adaptive execution splits.

Defined cases: null or empty texts have no spans; a null owner counts as one owner; repeated rows
(equal doc_id and text) get equal results, and count once as a repository; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import _work

#: Pattern, group of the value, least length of the value, by kind in the order of the result.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Cheap tests that a text must pass to hold a match that counts.
MAY = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: A candidate that this many owners have is a copied example.
COPIED = 3
#: So is one that this many repositories have, be it of one owner: far more than one owner puts a credential of its own in.
COPIED_REPOSITORIES = 20
#: Values that stand for a secret in texts about them.
PLACEHOLDER = r"(?i)example|changeme|placeholder|your[-_]|dummy|sample|xxxx|0123456|abcdef|password|secret"
#: Matches whose value is a password by its keyword: judged by ownership and placeholders, however short or plain.
PASSWORD = r"^(?i:password|passwd)"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda encloses would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums(lengths: Column) -> Column:
    zero = F.array().cast("array<long>")
    return F.aggregate(lengths, zero, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))


def running(lengths: Column) -> Column:
    """Running sums of an array, in blocks of BLOCK."""
    many = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    blocks = F.transform(many, lambda b: sums(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def join(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(before, lambda before: F.flatten(F.transform(blocks, lambda b, i: let(F.when(i > 0, F.get(before, i - 1)).otherwise(0), lambda base: F.transform(b, lambda x: x + base)))))

    return F.when(F.size(lengths) > 0, let(blocks, join)).otherwise(F.array().cast("array<long>"))


def starts(parts: Column, hits: Column) -> Column:
    """Starts of matches: the sums of lengths of all that stands before them."""
    gaps = F.transform(F.slice(parts, F.lit(1), F.size(hits)), lambda p: F.length(p).cast("long"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits, lambda h: F.length(h).cast("long")))
    return let(F.zip_with(gaps, F.slice(before, F.lit(1), F.size(hits)), lambda g, h: g + h), running)


SPANS = "array<struct<start:long,kind:int,end:long,value:string,password:boolean>>"


def found(text: Column, order: int, kind: str) -> Column:
    """Spans of one kind: (start, order of the kind, end, value), failing matches dropped."""
    pattern, group, least = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def spans(m: Column) -> Column:
        ends = F.zip_with(starts(m["parts"], m["hits"]), m["hits"], lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.rlike(PASSWORD).alias("password")))
        return F.zip_with(ends, m["values"], lambda e, v: F.struct(e["start"].alias("start"), F.lit(order).alias("kind"), e["end"].alias("end"), v.alias("value"), e["password"].alias("password")))

    matches = F.struct(F.split(text, pattern, -1).alias("parts"), hits.alias("hits"), values.alias("values"))
    none = F.array().cast(SPANS)
    return F.when(text.rlike(MAY[kind]), F.filter(let(matches, spans).cast(SPANS), lambda x: F.length(x["value"]) >= least)).otherwise(none)


def live_looking(value: Column, password: Column) -> Column:
    """No placeholder, and a password or else long, of many different characters, letters and digits both."""
    key = (F.length(value) >= 16) & (F.size(F.array_distinct(F.split(value, ""))) >= 9) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return (password | key) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, text_key, base and live spans (arrays of start, kind, end) of every row.

    text_key is xxhash64 of the text; with doc_id it names a row's content.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    spans = F.concat(*[found(F.col("text"), i, kind) for i, kind in enumerate(KINDS)])
    spans = F.transform(F.array_sort(spans), lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("hash"), F.length(x["value"]).alias("n"), live_looking(x["value"], x["password"]).alias("looks_live")))
    rows = _work.materialise(rows.select("doc_id", "text_key", "owner", "repository", spans.alias("spans")), "secret-spans")

    candidates = rows.where(F.size("spans") > 0).select("doc_id", "text_key", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), F.explode("spans").alias("x"))
    candidates = candidates.select("doc_id", "text_key", "owner", "repository", "x.start", "x.end", "x.hash", "x.n", "x.looks_live")
    looks = candidates.where("looks_live")
    owners = looks.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("owners"))
    texts = looks.groupBy("hash", "text_key").agg(F.min("repository").alias("repository"))
    repositories = texts.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("repositories"))
    held = owners.join(repositories, "hash").where((F.col("owners") < COPIED) & (F.col("repositories") < COPIED_REPOSITORIES))
    held = _work.materialise(held.select("hash"), "secret-owned")
    live = looks.join(held, "hash").select("doc_id", "text_key", (F.col("end") - F.col("n")).alias("start"), F.lit(len(KINDS)).alias("kind"), "end")
    live = live.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("live"))
    live = live.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    base = F.transform("spans", lambda x: F.struct(x["start"], x["kind"], x["end"]))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return rows.join(live, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", "text_key", base.alias("base"), F.coalesce("live", none).alias("live"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "live")])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""

    def count(order: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == order)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    every = written(F.array_sort(F.concat("base", "live")))
    return scan(docs).select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with the values of live credentials masked and n_chars brought up to date; copied examples stay."""
    live = scan(docs).where(F.size("live") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("live").alias("_live")).dropDuplicates(["_id", "_key"])
    live = _work.materialise(live, "secret-live")
    rows = docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_text", F.xxhash64("text"))
    chosen = _work.marks(live, "_id", "_key")
    hit = _work.marked(rows, chosen, "_doc", "_text").join(live, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    # Spans of equal or overlapping values are masked from the last to the first; one inside another is skipped.
    outer = F.filter("_live", lambda x: ~F.exists("_live", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["start"] < x["start"]) | (y["end"] > x["end"]))))
    masked = F.aggregate(F.reverse(F.coalesce(outer, F.array().cast("array<struct<start:long,kind:int,end:long>>"))), F.col("text"), lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"].cast("int")), F.lit(mask), F.substring(t, (x["end"] + 1).cast("int"), F.lit(2147483647))))
    hit = hit.withColumn("text", F.when(F.col("_live").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col("_live").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return hit.select(*docs.columns).unionByName(_work.marked(rows, chosen, "_doc", "_text", keep=False).select(*docs.columns))
