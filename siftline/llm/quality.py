"""Quality rules by divergence: how far a document's histograms are from those of its language.

References: for each language the mean histogram of character classes and the shares of its most
common words, summed over all documents. A document's distance to either is the Jensen-Shannon distance
(base 2, 0 to 1); it is kept if neither is above its limit. Guards: each histogram is only judged with enough
characters or words, and the limits widen for short texts, whose histograms are noisy.

The documents are read twice: once for sums by language (words are added up in each task before they are
shuffled), once to be judged. The references are a table of COMMON words and 10 classes for every language,
however rare, and are joined to the documents. Neither distance is judged where the language's own sums are
under LEAST_SUM_CHARS or LEAST_SUM_WORDS.

Defined cases: null or empty texts have no words and fail the base rule; rows of a null language have no
reference and are judged by the base rule only; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import _work

#: Common words of a language.
COMMON = 50
#: Guards: least characters and words for the two judgements.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Guards: least sums of a language that others of its documents are judged by.
LEAST_SUM_CHARS, LEAST_SUM_WORDS = 8_000, 2_000
#: Limits of the distances, and how they widen with the root of the number of characters or words.
CLASS_LIMIT, CLASS_SLACK = 0.30, 1.0
WORD_LIMIT, WORD_SLACK = 0.36, 1.3
#: Words of a task that are counted before the counts are passed on.
COUNTED = 200_000
#: References that a worker holds as histograms at a time.
HELD = 1_000

#: Base rules.
LEAST_BASE_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Character classes by code of ASCII: letters, capitals, digits, space, line ends, full stops, other sentence marks, symbols, others; 9: beyond ASCII.
_CLASSES = np.full(256, 9, np.uint8)
for _chars, _code in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r\v\f", 4), (".,", 5), ("!?;:'\"()-", 6), ("#*$%&|<>", 7)):
    for _c in _chars:
        _CLASSES[ord(_c)] = _code
for _c in range(128):
    if _CLASSES[_c] == 9:
        _CLASSES[_c] = 8


def classes(raw: bytes) -> np.ndarray:
    """Counts of the character classes (of bytes; a character beyond ASCII weighs as its bytes)."""
    return np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=10).astype(float)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, to the base 2."""
    p, q = p / max(p.sum(), 1e-12), q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0.0)))



def counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words by language; the rows with an empty word and a class number are the classes' sums."""
    fields = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])

    def flush(words: dict[str | None, Counter], sums: dict[str | None, np.ndarray]) -> pa.RecordBatch:
        rows = [(lang, w, -1, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, b"", i, int(n)) for lang, s in sums.items() for i, n in enumerate(s)]
        words.clear()
        sums.clear()
        return _work.out(fields, [[r[i] for r in rows] for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(*_work.columns(batch, "lang", "text"), strict=True):
                if raw:
                    words.setdefault(lang, Counter()).update(raw.split())
                    sums[lang] = sums.get(lang, 0) + classes(raw)
            if sum(map(len, words.values())) + len(sums) > COUNTED:
                yield flush(words, sums)
        yield flush(words, sums)

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, word binary, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def reference(classes: list[int], words: list[bytes] | None, times: list[int] | None, total: int | None) -> Reference:
    """Class histogram, places of common words, their counts with the rest last."""
    times = times or []
    return np.array(classes, float), {bytes(w): i for i, w in enumerate(words or [])}, np.array([*times, (total or 0) - sum(times)], float)


def table(docs: DataFrame) -> DataFrame:
    """(lang, classes, words, times, total) of every language that isn't null: its class sums, common words, their counts and the count of all."""
    _work.prepare(docs.sparkSession)
    sums = _work.materialise(counts(docs).where("lang is not null"), "words")
    words = sums.where("class < 0")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # limited in each task before the shuffle
    top = words.withColumn("place", place).where(F.col("place") <= COMMON).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    top = top.select("lang", F.col("top.word").alias("words"), F.col("top.n").alias("times"))
    hist = F.array(*[F.coalesce(F.sum(F.when(F.col("class") == i, F.col("n"))), F.lit(0)) for i in range(10)])
    found = sums.where("class >= 0").groupBy("lang").agg(hist.alias("classes"))
    found = found.join(top, "lang", "left").join(words.groupBy("lang").agg(F.sum("n").alias("total")), "lang", "left")
    return _work.materialise(found.select("lang", "classes", "words", "times", "total"), "references")


def references(docs: DataFrame) -> dict[str, Reference]:
    """By language, here in the driver: for looking at few languages; ``rules`` joins the table."""
    return {r["lang"]: reference(*r[1:]) for r in table(docs).toLocalIterator()}


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = ASCII_WORDS(text)
    n = len(words)
    lines = [line for line in text.split("\n") if HAS_WORD(line)]
    repeated = 0
    if n > 3:
        ids: dict[str, int] = {}
        number = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        if len(ids) < 1 << 20:
            windows = (number[:-2] << 42) | (number[1:-1] << 21) | number[2:]
        else:  # three numbers of any size
            _, pairs = np.unique(number[:-1] * len(ids) + number[1:], return_inverse=True)
            windows = pairs[:-1] * len(ids) + number[2:]
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[place] > 1)
        hit = np.zeros(n, bool)
        hit[twice] = hit[twice + 1] = hit[twice + 2] = True
        repeated = int(hit.sum())
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


ASCII_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]").search


def verdict(text: str, words: int, lang: str | None, known: dict[str, Reference]) -> tuple[float, float, bool]:
    """Both distances (0 where a guard holds back) and whether the text is within the limits."""
    hist, place, shares = known.get(lang) or reference([0] * 10, None, None, None)
    raw = text.encode("utf-8", "surrogatepass")
    by_class = by_word = 0.0
    if len(raw) >= LEAST_CHARS and hist.sum() >= LEAST_SUM_CHARS:
        by_class = distance(classes(raw), hist)
    if words >= LEAST_WORDS and shares.sum() >= LEAST_SUM_WORDS:
        own = np.zeros(len(shares))
        for w, n in Counter(raw.split()).items():
            own[place.get(w, -1)] += n
        by_word = distance(own, shares)
    return by_class, by_word, by_class <= CLASS_LIMIT + CLASS_SLACK / max(len(raw), 1) ** 0.5 and by_word <= WORD_LIMIT + WORD_SLACK / max(words, 1) ** 0.5


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Base figures, base_failed, kept and the distances of every row, by the table ``known``."""
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = pa.schema([(f.split()[0], types[f.split()[1]]) for f in FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Reference] = {}
        for batch in batches:
            rows = []
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("classes", "words", "times", "total")]
            for k, (doc_id, lang, text) in enumerate(zip(*_work.columns(batch, "doc_id", "lang", "text"), strict=True)):
                text = text or ""
                if lang is not None and lang not in held and own[0][k].is_valid:
                    if len(held) >= HELD:
                        held.clear()
                    held[lang] = reference(*[c[k].as_py() for c in own])
                figures = base(text)
                failed = figures[0] < LEAST_BASE_WORDS or 100 * figures[4] > MOST_REPEATED * figures[0]
                by_class, by_word, good = verdict(text, figures[0], lang, held)
                rows.append((doc_id, *figures, failed, not failed and good, by_class, by_word))
            yield _work.out(fields, [[r[i] for r in rows] for i in range(len(fields))])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.join(known, "lang", "left").mapInArrow(run, FIELDS)


def rules(docs: DataFrame) -> DataFrame:
    return judge(docs, table(docs))
