"""Toxicity by averaged subword bags: a word is the mean of the vectors of its character n-grams and of itself,
a passage the mean of its words, and a linear softmax over the two classes scores that mean. Vectors and softmax are
trained jointly in numpy; a misspelling never seen shares most n-grams with its original.

A text is averaged over each run of ``PASSAGE`` words that it holds, from every word on, and its score is that of its
worst run: a few words of abuse vanish in the mean of a whole text (the README has figures of both). Training sends
the gradient to the worst runs.

Fit: on a bounded sample of labelled rows (at most ``TRAIN_ROWS`` of each class, the first by hash of doc_id among
those whose text has at most ``TRAIN_BYTES`` bytes), which goes to the driver. Scoring covers every row and whole texts.

Defined cases: null or empty text has no words and scores the biases alone; rows without label, with a null label or a
null doc_id are not trained on; a doc_id labelled more than once is toxic if one label says so, and of texts that share
a doc_id the one of least hash is trained on; a row of null doc_id is not held out; repeated rows score alike; with no
label at all, or one class only, every score is 0. Long texts take time and memory in proportion. Extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import _work

#: Most labelled rows of each class that are drawn for training, and the most bytes of such a row's text.
TRAIN_ROWS = 2000
TRAIN_BYTES = 20_000
#: Words of a passage; rows of the table of n-gram vectors; length of a vector; lengths of n-grams.
PASSAGE = 4
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5, 6)
EPOCHS = 100
#: Length of a step, and decay, for vectors, softmax weights and biases.
RATES = (40.0, 0.1, 0.1)
DECAYS = (1e-6, 1e-5, 0.0)
#: Words whose logit a task remembers; beyond it the memory starts anew with the words of the batch in hand.
REMEMBERED = 150_000

WORDS = re.compile(r"[^\W_]+", re.UNICODE).findall


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Characters of words that are hashed at once.
AT_ONCE = 1 << 15


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def bags_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, owners): for each word the rows of the vector table of its bag, and the word's place in the list.

    A bag holds the word itself and its n-grams with marked ends. All are hashed from one running sum of powers.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers(_BASE, len(codes)))])
    back = powers(_BACK, len(codes))
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(codes))
    rows, owners = [], []
    for n in (0, *GRAMS):  # 0: the whole word
        first = ends - size if n == 0 else np.flatnonzero(left >= n)
        last = ends if n == 0 else first + n
        rows.append((mix((total[last] - total[first]) * back[first] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[first])
    return np.concatenate(rows), np.concatenate(owners)


def grams(word: str) -> list[int]:
    return bags_of([word])[0].tolist()


def worst(values: np.ndarray) -> float:
    """The highest mean of PASSAGE successive values (of all, where there are fewer); 0 of none."""
    if len(values) <= PASSAGE:
        return float(values.sum()) / max(len(values), 1)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return float((total[PASSAGE:] - total[:-PASSAGE]).max()) / PASSAGE


@dataclass
class Model:
    """Vectors (BUCKETS x DIM), softmax weights (DIM x 2), biases (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def scorer(self) -> Scorer:
        """What scoring needs: as all is linear, the difference of the classes' logits for each n-gram."""
        return Scorer(self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.biases[1] - self.biases[0]))


@dataclass
class Scorer:
    by_gram: np.ndarray
    bias: float

    def logits(self, words: list[str]) -> list[float]:
        found, at = [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) < AT_ONCE):
                size += len(words[end]) + 2
                end += 1
            rows, owners = bags_of(words[at:end])
            found += (np.bincount(owners, self.by_gram[rows], end - at) / np.bincount(owners, minlength=end - at)).tolist()
            at = end
        return found

    def scores(self, texts: list[str | None], memory: dict[str, float] | None = None) -> list[float]:
        """Probabilities of the toxic class; ``memory`` keeps words' logits from one call to the next."""
        memory = {} if memory is None else memory
        words = [WORDS((text or "").lower()) for text in texts]
        new = {w for part in words for w in part if w not in memory}
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = {w for part in words for w in part}
        new = list(new)
        memory.update(zip(new, self.logits(new), strict=True))
        top = np.array([worst(np.fromiter(map(memory.__getitem__, part), float, len(part))) for part in words], float)
        return (1 / (1 + np.exp(-np.clip(top + self.bias, -60, 60)))).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


class Constant:
    """Where nothing can be learnt."""

    def scorer(self) -> Constant:
        return self

    def scores(self, texts: list[str | None], memory: dict[str, float] | None = None) -> list[float]:
        return [0.0] * len(texts)


@dataclass
class Bags:
    """Texts as runs of words, words as bags of n-grams. Texts without words have no run and aren't among ``docs``."""

    docs: np.ndarray
    doc_start: np.ndarray
    first: np.ndarray
    size: np.ndarray
    word_of: np.ndarray
    gram: np.ndarray
    bag_size: np.ndarray

    def by_run(self, by_gram: np.ndarray) -> np.ndarray:
        """Means over the runs of means over the words' bags of a number for each n-gram."""
        start = np.cumsum(self.bag_size) - self.bag_size
        by_word = np.add.reduceat(by_gram[self.gram], start) / self.bag_size
        total = np.concatenate([[0.0], np.cumsum(by_word[self.word_of])])
        return (total[self.first + self.size] - total[self.first]) / self.size

    def to_grams(self, of_run: np.ndarray) -> np.ndarray:
        """The transpose of ``by_run``: what a number for each run gives to the n-grams."""
        each, n = of_run / self.size, len(self.word_of)
        of_word = np.cumsum(np.bincount(self.first, each, n + 1) - np.bincount(self.first + self.size, each, n + 1))[:n]
        of_word = np.bincount(self.word_of, of_word, len(self.bag_size)) / self.bag_size
        return np.bincount(self.gram, np.repeat(of_word, self.bag_size), BUCKETS)


def bags(texts: list[str | None]) -> Bags:
    ids: dict[str, int] = {}
    docs, doc_start, first, size, word_of = (array("q") for _ in range(5))
    for doc, text in enumerate(texts):
        if words := WORDS((text or "").lower()):
            docs.append(doc)
            doc_start.append(len(first))
            runs = max(1, len(words) - PASSAGE + 1)
            first.extend(range(len(word_of), len(word_of) + runs))
            size.extend([min(PASSAGE, len(words))] * runs)
            word_of.extend(ids.setdefault(w, len(ids)) for w in words)
    gram, owner = bags_of(list(ids)) if ids else (np.empty(0, np.int64),) * 2
    gram, bag_size = gram[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(ids))
    return Bags(*(np.array(x, np.int64) for x in (docs, doc_start, first, size, word_of, gram, bag_size)))


def loss(known: Bags, target: np.ndarray, weight: np.ndarray, vectors: np.ndarray, weights: np.ndarray, biases: np.ndarray, sharp: float) -> tuple[float, list[np.ndarray]]:
    """Weighted cross entropy of the texts and its gradients by vectors, weights and biases.

    A text's logit is the mean over its runs, weighted by a softmax (of sharpness ``sharp``) that counts as constant.
    """
    lead = known.by_run(vectors @ (weights[:, 1] - weights[:, 0]))  # a softmax over two classes asks for the difference alone
    runs = np.diff([*known.doc_start, len(known.first)])
    share = np.exp(sharp * (lead - np.repeat(np.maximum.reduceat(lead, known.doc_start), runs)))
    share /= np.repeat(np.add.reduceat(share, known.doc_start), runs)
    logit = np.add.reduceat(share * lead, known.doc_start) + biases[1] - biases[0]
    p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    error = weight * (p - target)  # of class 1; that of class 0 is its negative
    to_gram = known.to_grams(np.repeat(error, runs) * share)
    value = -(weight * np.log(np.maximum(np.where(target == 1, p, 1 - p), 1e-300))).sum()
    to_weights = vectors.T @ to_gram
    return float(value), [to_gram[:, None] * (weights[:, 1] - weights[:, 0]), np.stack([-to_weights, to_weights], axis=1), np.array([-error.sum(), error.sum()])]


def fit(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model | Constant:
    """Joint training of vectors and softmax on the whole (bounded) sample, both classes of equal weight.

    A step has a fixed length for each parameter as a whole, not for each n-gram: rare n-grams move
    in proportion to their evidence and aren't learnt by heart.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Constant()
    known = bags(texts)
    target = y[known.docs]
    if not len(target) or target.min() == target.max():
        return Constant()
    weight = np.where(target == 1, 0.5 / target.sum(), 0.5 / (1 - target).sum())
    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.7, (DIM, 2)), np.array([0.5, -0.5])]
    state = [[np.zeros_like(p), 0.0] for p in parameters]
    for step in range(1, epochs + 1):
        _, slopes = loss(known, target, weight, *parameters, sharp=1.0 + 4.0 * step / epochs)
        for p, g, s, rate, decay in zip(parameters, slopes, state, RATES, DECAYS, strict=True):
            g = g + decay * p
            s[0] += 0.1 * (g - s[0])
            s[1] += 0.1 * (float((g * g).sum()) - s[1])
            p -= rate * (s[0] / (1 - 0.9**step)) / ((s[1] / (1 - 0.9**step)) ** 0.5 + 1e-9)
    return Model(*parameters)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model | Constant:
    """Fits on labelled rows that are not held out (crc32 of doc_id as text, mod 5, is not 0)."""
    labelled = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").where(F.octet_length("text") <= TRAIN_BYTES)
    fit_for = labelled.join(texts.groupBy("doc_id").agg(F.min("text_key").alias("text_key")), "doc_id")
    fit_for = _work.materialise(fit_for, "labelled")  # three numbers for each labelled row
    drawn = [fit_for.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for k in (0, 1)]
    drawn = _work.materialise(drawn[0].unionByName(drawn[1]), "drawn")  # at most 2 * TRAIN_ROWS rows
    rows = texts.join(F.broadcast(drawn), ["doc_id", "text_key"]).select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels, lang, source and doc_id are no inputs of the score."""
    _work.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())  # BUCKETS numbers, whatever the input
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, memory = shared.value, {}
        for batch in batches:
            doc_ids, texts = _work.columns(batch, "doc_id", "text")
            scores = judge.scores(texts, memory)
            yield _work.out(fields, [doc_ids, [held_out(i) for i in doc_ids], scores, [int(s >= 0.5) for s in scores]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_work.task(run), "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """Rows of ``docs`` that score under 0.5, columns as they are."""
    _work.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, memory = shared.value, {}
        for batch in batches:
            (texts,) = _work.columns(batch, "text")
            yield batch.filter(pa.array([p < 0.5 for p in judge.scores(texts, memory)], pa.bool_()))

    return docs.mapInArrow(_work.task(run), docs.schema)
