"""A corpus pipeline of five stages; each takes and returns documents, the last one their packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, near_dup, packing, secrets, substrings, toxicity
from graphloom.llm.queries import tokenizer
from graphloom.session import cut, table

#: Stage results are lists of pieces and decisions of trained models, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; it learns from labelled documents of the same folds as op6.

    Null and empty texts get the score of an empty window; without labels of both kinds nothing goes; rows without an
    id are judged by their text; equal texts share one fate; other columns, whatever their names, stay as they are.
    """
    train = language.remainder(docs["doc_id"], 5) != 0
    model = toxicity.train_toxicity_model(docs, table(spark, sf_dir, "labels"), train)
    return toxicity.without_toxic(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Null and empty texts are copies of nothing and stay; rows without an id stay; repeated rows of one id all stay, or
    all go; other columns, whatever their names, stay as they are.
    """
    return near_dup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that stand in a window of 13 words which a document of smaller id holds too; n_chars follows the text.

    Null, empty and short texts stay as they are, as do texts that lose nothing; rows without an id keep all words.
    """
    return _counted(substrings.without_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text. Null texts stay null, texts without secrets unchanged."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences: the columns of op10, none of ``docs``. A null text is empty."""
    return packing.pack_documents(docs, *tokenizer("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, in its place; tables without that column stay without."""
    counted = F.coalesce(F.length("text").cast("long"), F.lit(0)).alias("n_chars")
    return docs.select(*[counted if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
