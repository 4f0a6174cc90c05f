"""Byte-level BPE by given ranks: whole pre-tokens through a minimal perfect hash, others by a heap over linked bytes.

Tier 1: a pre-token that is itself in the vocabulary has one id, found by a hash-and-displace
minimal perfect hash (one probe, one comparison of bytes). Tier 2: other pre-tokens are merged
bottom up; a heap holds the ranks of neighbouring pairs of a doubly linked list of pieces, so a
run of n bytes takes O(n log n) steps however long it is.

Nulls are empty texts; an empty text has no ids; rows are handled one by one, so repeated rows,
ties and extra columns do not matter. A very long text takes memory in proportion to its ids, and a run without a
split in it (white space, say) that of its heap. What a task remembers of pre-tokens ends with the task: the codec is
unpickled for each.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from siftline.llm import _work

#: Distinct pre-tokens that a task remembers with their ids (some 200 bytes each); beyond it the memory starts anew.
REMEMBERED = 300_000
#: Longer pre-tokens are not remembered.
LONG = 32


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Reads a rank file (base64 token and rank on each line): a vocabulary, tens of thousands of lines."""
    lines = [r[0].split() for r in spark.read.text(path if "://" in path else f"file://{path}").where("value != ''").collect()]
    return {base64.b64decode(token): int(rank) for token, rank in lines}


#: Texts of these characters alone are split by the faster engine of ``re``, in which classes of properties are spelt out.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = re.compile(f"[\t\n\r -~{LETTERS}]*").fullmatch


def in_plain_letters(pattern: str) -> str | None:
    """``pattern`` for plain texts, with its letter and number classes spelt out; None if it asks for other properties."""
    parts, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if part in ("[", "]"):
            inside = part == "["
        elif part in (r"\p{L}", r"\p{N}"):
            part = LETTERS if part == r"\p{L}" else "0-9"
            part = part if inside else f"[{part}]"
        elif part[:2] in (r"\p", r"\P", r"\w", r"\W", r"\b", r"\B") or part[0] == "(" and "(?i" in pattern:
            return None
        parts.append(part)
    return "".join(parts)


class PerfectHash:
    """Minimal perfect hash from the tokens of a vocabulary to their ids (hash and displace).

    Tokens are put into about n/3 buckets; from the largest bucket on, the first seed is sought
    that sends a bucket's tokens to free slots; a bucket of one token just names a free slot
    (-1 - slot). ``find`` verifies the bytes, so a string that is not a token is never taken for one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(1, len(ranks))
        n_buckets = self.size // 3 + 1
        buckets: list[list[bytes]] = [[] for _ in range(n_buckets)]
        for token in ranks:
            buckets[xxhash.xxh64_intdigest(token) % n_buckets].append(token)
        self.seeds = array("q", bytes(8 * n_buckets))
        self.tokens: list[bytes | None] = [None] * self.size
        self.ids = array("I", bytes(4 * self.size))
        free = iter(range(self.size))
        for bucket in sorted(range(n_buckets), key=lambda b: -len(buckets[b])):
            if len(buckets[bucket]) < 2:
                if not buckets[bucket]:
                    break
                slots = [next(s for s in free if self.tokens[s] is None)]
                self.seeds[bucket] = -1 - slots[0]
            else:
                seed = 1
                while True:
                    slots = [xxhash.xxh64_intdigest(t, seed) % self.size for t in buckets[bucket]]
                    if len(set(slots)) == len(slots) and all(self.tokens[s] is None for s in slots):
                        break
                    seed += 1
                self.seeds[bucket] = seed
            for token, slot in zip(buckets[bucket], slots, strict=True):
                self.tokens[slot], self.ids[slot] = token, ranks[token]

    def find(self, token: bytes) -> int:
        seed = self.seeds[xxhash.xxh64_intdigest(token) % len(self.seeds)]
        slot = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(token, seed) % self.size
        return self.ids[slot] if self.tokens[slot] == token else -1


class Codec:
    """Encodes and decodes texts; small enough to be sent to every worker (it grows with the vocabulary alone)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.table, self.ranks = pattern, PerfectHash(ranks), ranks
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self._start()

    def _start(self) -> None:
        self.memory: dict[str, bytes] = {}
        self.split = regex.compile(self.pattern).findall
        self.split_plain = re.compile(plain).findall if (plain := in_plain_letters(self.pattern)) else self.split

    def forget(self) -> None:
        self.memory.clear()

    def __getstate__(self) -> tuple:
        return self.pattern, self.table, self.ranks, self.vocabulary

    def __setstate__(self, state: tuple) -> None:
        self.pattern, self.table, self.ranks, self.vocabulary = state
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of lowest rank is joined next."""
        rank_of, n = self.ranks.get, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry holds rank, start of the left piece and end of the right piece in one integer.
        heap = [rank << 64 | i << 32 | i + 2 for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            left, end = entry >> 32 & 0xFFFFFFFF, entry & 0xFFFFFFFF
            middle = ends[left]
            if middle < 0 or middle >= n or ends[middle] != end:
                continue  # one of the two has been joined with another piece
            ends[left], ends[middle] = end, -1
            if end < n:
                before[end] = left
                if (rank := rank_of(piece[left : ends[end]])) is not None:
                    heappush(heap, rank << 64 | left << 32 | ends[end])
            if (first := before[left]) >= 0 and (rank := rank_of(piece[first:end])) is not None:
                heappush(heap, rank << 64 | first << 32 | end)
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return ids

    def piece(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.table.find(raw)
        ids = [whole] if whole >= 0 else self.merge(raw)
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= LONG:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = (self.split_plain if PLAIN(text) else self.split)(text)
        known = self.memory.get
        return b"".join([known(word) or self.piece(word) for word in words])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>) to the rows of ``docs``; a column ``ids`` that was there is replaced."""
    _work.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != "ids"]
    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = _work.columns(batch, text)
            ids = pa.array([np.frombuffer(codec.encode(t or ""), "<i4") for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.select(*kept).mapInArrow(_work.task(run, codec.forget), schema)


def decode(docs: DataFrame, codec: Codec, ids: str = "ids") -> DataFrame:
    """Replaces ``ids`` by ``decoded`` (binary): the bytes the ids stand for; null ids give none."""
    _work.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (ids, "decoded")]
    schema = docs.select(*kept).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (rows,) = _work.columns(batch, ids)
            raw = pa.array([codec.decode(np.array(r or [], "<u4").tobytes()) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], raw], names=[*kept, "decoded"])

    return docs.select(*kept, ids).mapInArrow(_work.task(run, codec.forget), schema)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded in one pass."""
    _work.prepare(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = _work.columns(batch, "doc_id", "text")
            packed = [codec.encode(t or "") for t in texts]
            yield _work.out(fields, [
                doc_ids,
                [len(p) // 4 for p in packed],
                [hashlib.sha256(p).hexdigest() for p in packed],
                [hashlib.sha256(codec.decode(p)).hexdigest() for p in packed],
            ])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_work.task(run, codec.forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def checked(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ids, n_tokens and round_trip: whether the decoded ids are the text's bytes."""
    _work.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "round_trip")]
    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = _work.columns(batch, text)
            packed = [codec.encode(t or "") for t in texts]
            same = [codec.decode(p) == (t or "").encode("utf-8", "surrogatepass") for p, t in zip(packed, texts, strict=True)]
            ids = pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(same, pa.bool_())], names=[*kept, "ids", "n_tokens", "round_trip"])

    return docs.select(*kept, text).mapInArrow(_work.task(run, codec.forget), schema)
