"""Operators beside brute force on small tables, and on odd and empty ones."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftline.llm import _work, bpe, fingerprint, minhash, mixing, quality, secrets, sharding, suffix, toxicity, warc
from siftline.llm.queries import oracle_sql
from tests.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same_as_sql(name, df, result):
    """Whether the query's SQL gives ``result`` over the rows ``df`` as documents."""
    import duckdb

    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return rows_of(result.toPandas()) == rows_of(con.execute(oracle_sql()[name]).df())


# Toxicity


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(["ba", "ko", "ri", "tu", "me"], 3)) for _ in range(300)]
    bad = ["scoundrel", "villainous", "wretched"]
    rows = []
    for i in range(600):
        words = list(rng.choice(clean, 40))
        if i % 3 == 0:
            words[rng.integers(40)] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    model = toxicity.fit([r[1] for r in rows[:400]], [r[2] for r in rows[:400]])
    judge = model.scorer()
    held = [(judge.score(t), y) for _, t, y in rows[400:]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert judge.score(rows[1][1] + " scoundrell") > judge.score(rows[1][1])  # a misspelling never seen


def plain_grams(word):
    """The bag of a word by polynomial hashes of plain integers."""
    marked, full = f"<{word}>", (1 << 64) - 1

    def row(gram, n):
        h = sum((ord(c) + 1) * pow(toxicity._BASE, k, 1 << 64) for k, c in enumerate(gram)) + n & full
        h = (h ^ h >> 31) * 0x7FB5D329728EA185 & full
        return (h ^ h >> 29) % toxicity.BUCKETS

    return [row(marked, 0)] + [row(marked[i : i + n], n) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]


def test_toxicity_scores_and_gradients_beside_plain_loops():
    assert all(toxicity.grams(w) == plain_grams(w) for w in ("a", "ab", "straße", "😀é" * 20))
    texts = ["ab cd ef gh ij kl", "mn op", None, "", "ab ab ab qr st ab uv wx", "yz"]
    target, weight = np.array([1.0, 0, 1, 0]), np.array([0.2, 0.3, 0.1, 0.4])
    rng = np.random.default_rng(3)
    vectors, weights, biases = rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), np.array([0.3, -0.2])

    def logits(text, pool):
        words = [np.mean([vectors[g] for g in plain_grams(w)], axis=0) for w in (text or "").split()]
        runs = [np.mean(words[i : i + toxicity.PASSAGE], axis=0) @ weights for i in range(max(1, len(words) - toxicity.PASSAGE + 1))] if words else [np.zeros(2)]
        return pool(runs) + biases

    def share(z):
        e = np.exp(z - z.max())
        return e[1] / e.sum()

    judge = toxicity.Model(vectors, weights, biases).scorer()
    for text in texts:
        assert judge.score(text) == pytest.approx(share(logits(text, lambda runs: max(runs, key=lambda z: z[1] - z[0]))))

    def plain(*parameters):
        nonlocal vectors, weights, biases
        vectors, weights, biases = parameters
        p = [share(logits(t, lambda runs: np.mean(runs, axis=0))) for t in texts if t]
        return -sum(w * np.log(q if y else 1 - q) for w, q, y in zip(weight, p, target, strict=True))

    parameters = [vectors, weights, biases]
    known = toxicity.bags(texts)
    value, slopes = toxicity.loss(known, target, weight, *parameters, sharp=0.0)  # all runs of a text weigh alike
    assert value == pytest.approx(plain(*parameters))
    places = [(0, (toxicity.grams("ab")[0], 2)), (0, (toxicity.grams("op")[1], 0)), (1, (3, 1)), (1, (0, 0)), (2, (0,)), (2, (1,))]
    for k, at in places:
        moved = [p.copy() for p in parameters]
        moved[k][at] += 1e-5
        assert slopes[k][at] == pytest.approx((plain(*moved) - plain(*parameters)) / 1e-5, rel=1e-3, abs=1e-8)


def test_toxicity_is_not_turned_by_a_neutral_word():
    import pandas as pd

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id")
    held = np.array([toxicity.held_out(i) for i in rows.doc_id])
    judge = toxicity.fit(list(rows.text[~held]), list(rows.toxic[~held])).scorer()
    verdicts = np.array([judge.score(t) >= 0.5 for t in rows.text[held]])
    assert (verdicts == rows.toxic[held]).mean() >= 1 - rows.toxic[held].mean()  # no worse than never calling a text toxic
    assert (verdicts != [judge.score("a " + (t or "")) >= 0.5 for t in rows.text[held]]).sum() <= 1


def test_toxicity_columns_and_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (6, 0, 1), (7, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.reject(odd, model).columns == odd.columns
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, labels.where("false"))).collect()} == {0.0}


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, "http://b/", "x\r\n\r\ny"), (3, None, None), (4, "u", ""), (None, "n", "alone"), (5, "s", "same"), (5, "s", "same"), (6, "e", "WARC/1.1\r\né"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max([x for x in (largest.get(h or ""), i) if x is not None], default=None)
    want = Counter()
    for i, _, h in rows:
        raw, top = (h or "").encode(), largest[h or ""]
        revisit = top is not None and top != i
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(pages.where("false")).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    captures = warc.assemble(warc.read(spark, path))
    assert {r["response"]["payload"] for r in captures.where("response.record_type = 'response'").collect()} >= {b"x\r\n\r\ny", "WARC/1.1\r\né".encode()}
    assert captures.where("request is null or metadata is null").count() == 0


def test_warc_hops_and_broken_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(
        warc.record(k, {"WARC-Record-ID": i} | ({"WARC-Concurrent-To": c} if c else {}), b"b") + b"\r\n\r\n"
        for k, i, c in (("metadata", "<m>", "<q>"), ("request", "<q>", "<r>"), ("response", "<r>", None), ("warcinfo", "<i>", None))))
    (tmp_path / "b.warc").write_bytes(b"no archive")
    records = warc.read(spark, f"file://{tmp_path}")
    assert records.where("broken").count() == 1
    (c,) = warc.assemble(records).collect()
    assert (c["response"]["record_id"], c["request"]["record_id"], c["metadata"]["record_id"]) == ("<r>", "<q>", "<m>")


# Byte-level BPE


@pytest.fixture(scope="module")
def codec(spark):
    import public_tokenizers as P

    return bpe.Codec(bpe.read_ranks(spark, P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_bpe_like_tiktoken(spark, codec, docs, odd, empty):
    import public_tokenizers as P
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for df in (docs, odd):
        want = Counter()
        for i, t in texts(df):
            ids = np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()
            want[(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
        assert Counter(map(tuple, bpe.digests(df, codec).collect())) == want
    for t in ("a" * 3000, "²½ x y\x1c z", "'s 'll 12ab!?", "  \n \t x", "日本語 text"):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == encoding.encode_ordinary(t)
    assert bpe.digests(empty, codec).count() == 0
    back = bpe.decode(bpe.encode(odd, codec), codec)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(t or "" for _, t in texts(odd))
    assert set(bpe.checked(odd, codec).select("round_trip").distinct().toPandas()["round_trip"]) == {True}


def test_a_task_gives_back_its_memory(codec):
    """Its own words, and free memory that a later allocation keeps from the system."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        held = [bytes(1000) for _ in range(200_000)]
        pinned.append(bytes(1000))
        sizes.append(resident())
        for batch in batches:
            codec.encode("words that a task remembers")
            assert codec.memory and held
            yield batch

    pinned, sizes = [], []
    assert list(_work.task(run, codec.forget)(iter([1, 2]))) == [1, 2]
    assert not codec.memory and resident() < sizes[0] - (100 << 20)


def test_perfect_hash():
    ranks = {bytes([i, j]): i * 256 + j for i in range(40) for j in range(40)}
    table = bpe.PerfectHash(ranks)
    assert sorted(t for t in table.tokens if t) == sorted(ranks) and all(table.find(t) == r for t, r in ranks.items()) and table.find(b"zzz") == -1


# Near-duplicates


def sets_of(df):
    out = []
    for i, t in texts(df):
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows):
    """By doc_id; rows without doc_id are left out."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for n, (a, s) in enumerate(known):
        for b, t in known[:n]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("name", ["docs", "odd", "chain"])
def test_near_duplicates(spark, request, name):
    if name == "chain":  # copies of a text with edits that add up: neighbours are linked, ends are not
        words, rows = [f"w{i}" for i in range(120)], []
        for i in range(60):
            words = list(words)
            words[(i * 2) % 120] = f"x{i}"
            rows.append((100 - i, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(name)
    rows = sets_of(df)
    want = brute_components(rows)
    got = minhash.groups(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(s)) for i, s in rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None and r["n_shingles"]] in ([], [(1, False)])


def test_near_duplicates_of_nothing(empty):
    assert minhash.groups(empty).count() == 0


def test_shuffle_files_go_with_their_query(spark, docs):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = set(files.getAllFiles().mkString("\n").split("\n"))
    made = _work.materialise(docs.repartition(3, "doc_id"), "made")
    after = set(files.getAllFiles().mkString("\n").split("\n"))
    assert made.count() == docs.count() and not any("shuffle_" in f for f in after - before)
    assert spark.conf.get(_work.CLEANUP) == "false"


def test_sets_of_no_pair_are_not_dealt(spark):
    n = 400
    sets = spark.createDataFrame([(i, i, [i, -i]) for i in range(1, n)], "id long, key long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    left = _work.marked(sets, _work.marks(pairs.selectExpr("explode(array(a, b)) as id"), "id"), "id")
    assert {1, 2, 3, 4} <= {r["id"] for r in left.collect()} and left.count() < 20
    plan = minhash.verify(pairs, sets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and minhash.verify(pairs, sets).count() == 0


def test_deduplicate_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = b.replace("b0 ", "z ")
    rows = [(3, b), (5, a), (5, b), (6, near), (6, c), (7, d), (7, d), (None, d), (None, "e " + c[::-1]), (None, "e " + c[::-1]), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in minhash.deduplicate(df).collect())
    assert got == Counter([(3, b), (5, a), (6, c), (7, d), (None, "e " + c[::-1]), (8, None)])


def test_sketch_estimates_similarity():
    a = minhash.mix(np.arange(1, 401, dtype=np.uint64))
    b = minhash.mix(np.arange(101, 501, dtype=np.uint64))
    assert abs(np.mean(minhash.sketch(a) == minhash.sketch(b)) - 300 / 500) < 0.12
    assert len(minhash.sketch(a[:1])) == minhash.T


# Sharding


def test_shards(spark, docs, odd, empty):
    for df, shards in ((docs, 7), (odd, 40), (docs, 8)):
        rows = sharding.assign(df, shards).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
        for s, n in counts.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts(df))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.assign(empty, 4).count() == 0


def test_growth_moves_few_rows(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, n, slack=0.2).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.3 * len(a)


def test_shards_beside_a_plain_ring(spark, docs, odd):
    import xxhash

    def h(raw):
        return xxhash.xxh64_intdigest(raw, 42) - (0 if xxhash.xxh64_intdigest(raw, 42) < 1 << 63 else 1 << 64)

    for df, shards in ((docs, 40), (docs, 7), (odd, 3)):
        points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") - (1 << 63), s) for s in range(shards) for v in range(sharding.VNODES))
        rows = texts(df)
        position = [42 if t is None else h(t.encode()) for _, t in rows]
        tie = [42 if i is None else h(i.to_bytes(8, "little", signed=True)) for i, _ in rows]
        order = sorted(range(len(rows)), key=lambda k: (position[k], tie[k]))
        room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
        at = [sum(p < position[k] for p, _ in points) for k in range(len(rows))]  # the next point clockwise
        want, hop, waiting = Counter(), 0, sorted(order, key=lambda k: at[k])
        while waiting:
            left = []
            for k in waiting:  # a row whose shard is full goes on to the next point's
                shard = points[(at[k] + hop) % len(points)][1]
                if room[shard]:
                    room[shard] -= 1
                    want[rows[k][0], rows[k][1] or "", shard] += 1
                else:
                    left.append(k)
            waiting, hop = left, hop + 1
        got = Counter((r["doc_id"], r["shard"]) for r in sharding.assign(df, shards).collect())
        assert got == Counter((i, s) for i, _, s in want.elements())


# Fingerprints


def test_a_bucket_of_several_texts_falls_into_groups(spark):
    df = spark.createDataFrame([(1, "Same text"), (2, "same  TEXT"), (3, "other"), (4, "third"), (5, "OTHER")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.digests(df, mark=lambda raw: "one").collect()}
    assert {i: (r["group_id"], r["group_rows"], r["texts"]) for i, r in got.items()} == {1: (1, 2, 3), 2: (1, 2, 3), 3: (3, 2, 3), 5: (3, 2, 3), 4: (4, 1, 3)}


def test_fingerprints(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(texts(df), key=lambda r: -1e9 if r[0] is None else r[0], reverse=True)
        got = fingerprint.digests(df).collect()
        assert len(got) == len(rows)
        if df is docs:
            by = {r["doc_id"]: r for r in got}
            for k, (i, t) in enumerate(rows):
                following = rows[(k + 1) % len(rows)][1]
                third = len(t) // 3
                changed = t[: len(t) - third] + following[:third]
                r = by[i]
                assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.digest(t))
                assert r["near_edited"] == float(fingerprint.digest(changed) == r["fingerprint"]) and r["near_next"] == float(fingerprint.digest(following) == r["fingerprint"])
    of = {r["doc_id"]: r for r in got}
    assert of[8]["fingerprint"] == of[9]["fingerprint"] and of[9]["group_id"] == 8 and of[2]["group_id"] == 1 and of[2]["group_rows"] == 4
    assert of[3]["fingerprint"] == of[4]["fingerprint"] == of[5]["fingerprint"]
    assert fingerprint.digests(empty).count() == 0
    assert fingerprint.digest("ﬁ  Straße X") == fingerprint.digest(" FI STRASSE x ")


# Secrets


def brute_secrets(text):
    spans = []
    for k, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return sorted(spans)


def test_secrets(spark, docs, odd, empty):
    live = "Zq8-Lk2_Wm5.Vb9=Xc3/Rt"
    rows = [
        (1, f'é😀 Password: "{live}" and token==ab AKIA{"Z" * 20} ' + "0a" * 20, "one"), (2, f"secret={live}", "one"), (3, "API_KEY = 'Aq1Sw2De3Fr4Gt5Hy6'", "x"), (4, "api_key = 'Aq1Sw2De3Fr4Gt5Hy6'", "y"),
        (5, "apikey: Aq1Sw2De3Fr4Gt5Hy6", "z"), (6, "secret=token: abcdefgh", "x"), (8, "PASSWORD=ABCDEFGH", "x"), (9, "Api_Key : 'abcdef'", "x"), (7, "token=" + "a1" * 30 + " " + "passwd:1234567 " * 700, None),
    ]
    more = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, spans string")
    for df in (docs, odd, more):
        got = Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.digests(df).collect())
        want = Counter()
        for i, t in texts(df):
            s = brute_secrets(t)
            want[(i, hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s).encode()).hexdigest(), *(sum(x[1] == k for x in s) for k in range(3)))] += 1
        assert got == want
    spans = {r["doc_id"]: r["spans"] for r in secrets.digests(more).collect()}
    assert "live" in spans[1] and "live" in spans[2] and not any("live" in spans[i] for i in (3, 4, 5))  # three owners: a copied example
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(more).collect()}
    assert live not in masked[1] + masked[2] and masked[3] == rows[2][1] and masked[1].startswith('é😀 Password: "<SECRET>"')
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 13
    assert secrets.digests(empty).count() == 0


def test_secrets_copied_within_one_owner(spark):
    example, own, copied = "Aq1Sw2De3Fr4Gt5Hy6", "Zq8Lk2Wm5Vb9Xc3Rt7", "Pl0Ok9Ij8Uh7Yg6Tf5"
    n = secrets.COPIED_REPOSITORIES
    rows = [(i, f"page {i}: token={example}") for i in range(n)]  # an example in many documents of one source
    rows += [(100 + i, f"page {i}: token={own}") for i in range(n - 1)]
    rows += [(200 + i, f"token={copied}") for i in range(2 * n)]  # copies of one text
    df = spark.createDataFrame([(*r, "hot") for r in rows], "doc_id long, text string, source string")
    live = {r["doc_id"] for r in secrets.digests(df).collect() if "live" in r["spans"]}
    assert live == {i for i, _ in rows if i >= 100}
    assert same_as_sql("op7_secret_ownership", df, secrets.digests(df))
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert masked[0] == rows[0][1] and masked[100] == "page 0: token=<SECRET>"


def test_short_passwords_are_live(spark):
    rows = [(1, "password: hunter2Xq", "a"), (2, "Passwd=834615", "a"), (3, "token=hunter2Xq", "a"), (4, "password=changeme1", "a"), (5, "password=ab1", "a"), *[(6 + i, f"{i} password=letmein77", s) for i, s in enumerate("abc")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in secrets.digests(df).collect() if "live" in r["spans"]} == {1, 2}
    assert same_as_sql("op7_secret_ownership", df, secrets.digests(df))
    assert {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}[1] == "password: <SECRET>"


# Repeated passages


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            part = raw[s : s + 100]
            if part in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcd \n"), int(rng.integers(50, 900))))) for i in range(60)]
    rows += [(60 + i, rows[i % 7][1][30:240] + rows[20 + i][1] + rows[i % 5][1][:150]) for i in range(40)]
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100), (106, "x" * 100)]
    line = "".join(rng.choice(list("abcd "), 130))  # a line in very many contexts
    rows += [(200 + i, "".join(rng.choice(list("efgh "), int(rng.integers(20, 90)))) + line + "".join(rng.choice(list("ijkl "), 40))) for i in range(400)]
    planted = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ord int")
    for df in (docs, planted):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(df).collect()}
        assert got == brute_repeats(texts(df))
    monkeypatch.setattr(suffix, "CROWDED", 2)  # every shared trigger is crowded
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(planted).collect()} == brute_repeats(rows)
    monkeypatch.setattr(suffix, "FULL", 70)  # buckets of the line's triggers and of the runs of one letter are full
    counted = planted.selectExpr("doc_id as ord", "cast(text as binary) as text").mapInArrow(suffix.count, "bucket long, n long")
    assert counted.groupBy("bucket").sum("n").where("`sum(n)` > 70").count() >= 3
    for crowded in (2, 20_000):
        monkeypatch.setattr(suffix, "CROWDED", crowded)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(planted).collect()} == brute_repeats(rows)


def test_what_a_task_remembers(monkeypatch):
    monkeypatch.setattr(suffix, "REMEMBERED", 40)
    rng = np.random.default_rng(5)
    firsts, least, copies = suffix.Firsts(), {}, 0
    for _ in range(200):
        key, ctx, order, pos = rng.integers(0, 30, 8), rng.integers(-2, 2, 8), rng.integers(0, 1000, 8), rng.integers(0, 50, 8)
        for k, c, o, p, copy in zip(key, ctx, order, pos, firsts.copies(key, ctx, order, pos), strict=True):
            place = (int(o), int(p))
            assert not copy or least[k, c] < place  # a copy stands behind one that has gone on
            least[k, c] = min(place, least.get((k, c), place))
            copies += copy
        assert len(firsts.seen) <= 40
    assert copies > 200


def test_parsing_in_pieces(monkeypatch):
    import pyarrow as pa

    text = b"".join(b"%d," % (i * i) for i in range(900)) * 2
    monkeypatch.setattr(suffix, "PIECE", 1000)
    starts = set()
    for b in suffix.parse(iter([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["ord", "text"])])):
        for pos, ctx in zip(b.column("pos").to_pylist(), b.column("ctx").to_pylist(), strict=True):
            first, n = pos >> 8, pos & 255
            starts |= set(range(first, ctx - 99 if n == suffix._COPY else first + n))
    assert starts == set(range(len(text) - 99))


def test_repeats_of_odd_rows(odd, empty):
    rows = suffix.digests(odd).collect()
    assert len(rows) == 13 and Counter(r["doc_id"] for r in rows)[1] == 2
    assert {r["n_removed"] for r in rows if r["doc_id"] == 7} == {len(odd.where("doc_id = 6").first()["text"]) + 1}  # its words come around, and with them the blank before the tail
    assert suffix.digests(empty).count() == 0


# Mixing


def fill(sizes, weights, share, most):
    left, capped = share * sum(sizes), set()
    while True:
        rest = left - sum(most * sizes[i] for i in capped)
        total = sum(w for i, w in enumerate(weights) if i not in capped) or 1
        over = [i for i, w in enumerate(weights) if i not in capped and rest * w / total > most * sizes[i]]
        if not over:
            return [most * s if i in capped else rest * weights[i] / total for i, s in enumerate(sizes)]
        capped |= set(over)


def test_mix(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
        size = defaultdict(int)
        for _, t, s in rows:
            size[s] += len(WORD.findall(t or ""))
        names = sorted(size, key=lambda s: (s is None, s or ""))
        goal = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
        of = {i: s for i, _, s in rows}
        got = mixing.mix(df, [5, 2, 1], 1.5, 2.0).collect()
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        if df is docs:
            for s in names:
                mine = [r for r in got if of[r["doc_id"]] == s]
                assert all(abs(r["target"] - goal[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
                assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine)
            again = mixing.mix(df.repartition(3), [5, 2, 1], 1.5, 2.0).collect()
            assert sorted(map(tuple, again)) == sorted(map(tuple, got))
            assert mixing.apply(df, [5, 2, 1], 1.5, 2.0).count() == sum(r["times"] for r in got)
    assert mixing.mix(empty, [5, 2, 1], 1.5, 2.0).count() == 0


# Quality


def test_quality(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = {r["doc_id"]: r for r in quality.rules(df).collect()}
        for i, t in texts(df):
            w = WORD.findall(t or "")
            windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            many, hit = Counter(windows), set()
            for k, x in enumerate(windows):
                if many[x] > 1:
                    hit |= {k, k + 1, k + 2}
            lines = [x for x in (t or "").split("\n") if WORD.search(x)]
            r = rows[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)) or i is None
            assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) or i is None
            assert not (r["base_failed"] and r["kept"])
    assert quality.rules(empty).count() == 0


def test_quality_judges_by_language(spark, docs):
    known = quality.references(docs)
    text = docs.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").first()["text"]
    n = len(WORD.findall(text))
    assert quality.verdict(text, n, "en", known)[2]
    assert not quality.verdict(re.sub(r"\w+", "<#>", text), n, "en", known)[2]
    assert quality.distance(np.array([1.0, 0]), np.array([0, 2.0])) == pytest.approx(1) and quality.distance(np.array([1.0, 3]), np.array([2, 6.0])) == pytest.approx(0)


def test_quality_of_rare_and_unknown_languages(spark, docs):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("абвгдежзиклмнопрстуя"), int(rng.integers(2, 9)))) for _ in range(400)]
    share = 1 / np.arange(1, 401)
    own = [" ".join(rng.choice(words, 300, p=share / share.sum())) for _ in range(13)]
    rows = [(1000 + i, t, "ru") for i, t in enumerate(own[:10])] + [(1010, own[10], None), (1011, own[11], "uk")]
    rows += [(1012, re.sub(r"\w+", lambda m: "<#>" + m[0][:1], own[12]), "ru")]  # junk of a rare language
    every = docs.select("doc_id", "text", "lang")
    for _ in range(3):
        every = every.unionByName(every)  # so that ru has under 1% of the words
    rows = every.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    total = rows.selectExpr("sum(size(split(text, ' ')))").first()[0]
    assert 11 * 300 < total / 100
    kept = {r["doc_id"]: r["kept"] for r in quality.rules(rows).where("doc_id >= 1000").collect()}
    assert kept == {i: i != 1012 for i in range(1000, 1013)}
    assert same_as_sql("op10_divergence_quality", rows, quality.rules(rows).drop("class_distance", "word_distance"))
