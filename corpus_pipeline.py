"""Training-data pipeline over documents; each stage is written as Parquet and read again by the next.

All stages but the last return the columns of documents. A document that the mix takes twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import _work, bpe, minhash, mixing, secrets, toxicity
from siftline.llm.queries import table

WEIGHTS, SHARE, MOST = [5, 2, 1], 1.5, 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, learnt from the labels of rows that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of least doc_id (a null one last); rows without words are in no group and stay."""
    return minhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; the values of live credentials are masked and n_chars follows. Null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, once or twice. A null source is a source; rows of no words are drawn by their hash like others."""
    return mixing.apply(docs, WEIGHTS, SHARE, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding the ids gives the text's bytes again."""
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.checked(docs.select("doc_id", "lang", "source", "text"), codec)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("secret scans", mask_secrets),
    ("mix sources", mix_sources),
    ("byte-level bpe", encode),
]
#: The classifier and the sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = _work.materialise(docs, "stage-" + name.replace(" ", "-"))
    return docs
