"""Queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, fingerprint, minhash, mixing, quality, secrets, sharding, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.Codec(ranks, public_tokenizers.PATTERN))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op5_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(table(spark, sf_dir, "documents"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1], share=1.5, most=2.0).drop("text_key", "times")


def op10_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc_transactions, op3_byte_bpe, op4_minhash_near_dedup, op5_hash_ring_shards, op6_canonical_digest, op7_secret_ownership, op8_prefix_free_parsing, op9_hash_threshold_mix, op10_divergence_quality)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _op2_sql() -> str:
    nibbles = ", ".join(f"'{i:04b}'" for i in range(16))
    digits = ", ".join(f"'{c}'" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
    b AS (SELECT h, top, array_to_string([([{nibbles}])[strpos('0123456789abcdef', x)] for x in string_split(sha1(h), '')], '') AS bits FROM g),
    k AS (SELECT h, top, array_to_string([([{digits}])[1 + 16 * CAST(bits[i] AS INT) + 8 * CAST(bits[i + 1] AS INT) + 4 * CAST(bits[i + 2] AS INT) + 2 * CAST(bits[i + 3] AS INT) + CAST(bits[i + 4] AS INT)]
        for i in range(1, 157, 5)], '') AS digest FROM b)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p JOIN k USING (h)"""


def _op4_sql() -> str:
    return r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 75 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    m AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _op7_sql() -> str:
    kinds = []
    for i, (pattern, group, least) in enumerate(secrets.KINDS.values()):
        p = _text(pattern)
        kinds.append(f"""SELECT rid, doc_id, source, text, {i} AS kind, {least} AS least, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS vals,
        regexp_split_to_array(text, {p}) AS parts FROM d WHERE regexp_matches(text, {p})""")
    names = ", ".join(f"'{k}'" for k in (*secrets.KINDS, "live"))
    one = f"concat(([{names}])[kind + 1], ':', first, ':', last)"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
    h AS ({" UNION ALL ".join(kinds)}),
    s AS (SELECT rid, doc_id, source, kind, least, vals[i] AS value, hits[i] AS hit,
        CAST(list_sum([length(x) for x in parts[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS BIGINT) AS first FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
    f AS (SELECT *, first + length(hit) AS last, (regexp_matches(hit, {_text(secrets.PASSWORD)})
        OR length(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 9 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))
        AND NOT regexp_matches(value, {_text(secrets.PLACEHOLDER)}) AS looks_live FROM s WHERE length(value) >= least),
    repo AS (SELECT value, text, min(coalesce(CAST(doc_id AS VARCHAR), '')) AS repository FROM f JOIN (SELECT rid, text FROM d) USING (rid) WHERE looks_live GROUP BY ALL),
    owned AS (SELECT value FROM f WHERE looks_live GROUP BY value HAVING count(DISTINCT coalesce(source, '')) < {secrets.COPIED}
        INTERSECT SELECT value FROM repo GROUP BY value HAVING count(DISTINCT repository) < {secrets.COPIED_REPOSITORIES}),
    live AS (SELECT DISTINCT rid, last - length(value) AS first, {len(secrets.KINDS)} AS kind, last FROM f WHERE looks_live AND value IN (SELECT value FROM owned)),
    b AS (SELECT rid, string_agg({one}, ',' ORDER BY first, kind) AS base, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS x FROM f GROUP BY rid),
    e AS (SELECT rid, string_agg({one}, ',' ORDER BY first, kind) AS spans FROM (SELECT rid, first, kind, last FROM f UNION ALL SELECT rid, first, kind, last FROM live) GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)"""


def _op10_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    ascii_classes = ("a-z", "A-Z", "0-9", r" \t", r"\n\r\x0B\x0C", ".,", r"!?;:'"+'"'+r"()\-", "#*$%&|<>")
    counts = ", ".join(f"length(regexp_replace(text, {_text(f'[^{c}]')}, '', 'g')) AS c{i}" for i, c in enumerate(ascii_classes))
    some = " + ".join(f"c{i}" for i in range(8))
    each = ", ".join(f"c{i}" for i in range(10))

    def term(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
    w0 AS (SELECT rid, lang, regexp_extract_all(text, '{word}') AS ws FROM d),
    w AS (SELECT rid, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM w0),
    t AS (SELECT rid, pos, w, lead(w) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY rid ORDER BY pos)),
    twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(3) r(k) GROUP BY rid),
    line AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY rid),
    b AS (SELECT d.rid, doc_id, d.lang, text, len(ws) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w0 USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN line USING (rid)),
    c AS (SELECT *, a - ({some}) AS c8, strlen(text) - a AS c9 FROM (SELECT rid, lang, text, length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) AS a, {counts} FROM d)),
    cl AS (SELECT rid, lang, strlen(text) AS bytes, unnest([{each}]) AS n, unnest(range(10)) AS class FROM c),
    rc AS (SELECT lang, class, n / total AS q FROM (SELECT lang, class, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM cl WHERE lang IS NOT NULL GROUP BY lang, class) WHERE total >= {quality.LEAST_SUM_CHARS}),
    top AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(w)) AS place, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, w, count(*)::DOUBLE AS n FROM w WHERE lang IS NOT NULL GROUP BY lang, w)),
    rw0 AS (SELECT lang, w, n / total AS q FROM top WHERE place <= {quality.COMMON} AND total >= {quality.LEAST_SUM_WORDS}),
    rw AS (SELECT * FROM rw0 UNION ALL SELECT lang, NULL, 1 - sum(q) FROM rw0 GROUP BY lang),
    dc AS (SELECT rid, sqrt(greatest(sum({term("p", "q")}) + sum({term("q", "p")}), 0) / 2) AS dist FROM (SELECT rid, n / bytes::DOUBLE AS p, q FROM cl JOIN rc USING (lang, class) WHERE bytes >= {quality.LEAST_CHARS}) GROUP BY rid),
    dw0 AS (SELECT rid, rw0.w AS w, count(*)::DOUBLE AS n FROM w LEFT JOIN rw0 ON rw0.lang = w.lang AND rw0.w = w.w GROUP BY ALL),
    dw AS (SELECT rid, sqrt(greatest(sum({term("p", "q")}) + sum({term("q", "p")}), 0) / 2) AS dist FROM
        (SELECT b.rid, coalesce(dw0.n, 0) / b.n_words AS p, q FROM b JOIN rw USING (lang) LEFT JOIN dw0 ON dw0.rid = b.rid AND dw0.w IS NOT DISTINCT FROM rw.w WHERE b.n_words >= {quality.LEAST_WORDS}) GROUP BY rid),
    f AS (SELECT *, n_words < {quality.LEAST_BASE_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dc.dist, 0) <= {quality.CLASS_LIMIT} + {quality.CLASS_SLACK} / sqrt(greatest(strlen(text), 1))
        AND coalesce(dw.dist, 0) <= {quality.WORD_LIMIT} + {quality.WORD_SLACK} / sqrt(greatest(n_words, 1)) AS kept FROM f LEFT JOIN dc USING (rid) LEFT JOIN dw USING (rid)"""


def oracle_sql() -> dict[str, str]:
    """The others have hashes, models or alphabets that DuckDB lacks; tests hold them against brute force."""
    return {"op2_warc_transactions": _op2_sql(), "op4_minhash_near_dedup": _op4_sql(), "op7_secret_ownership": _op7_sql(), "op10_divergence_quality": _op10_sql()}
