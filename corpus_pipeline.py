"""Corpus pipeline: language ID, line dedup, near-duplicate removal, repeated-passage removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept, which was written as Parquet and read again. All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars) with n_chars renewed; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.language_mix import held_out, identify, train
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.ngram_join import near_components
from tickloom.llm.packing import pack
from tickloom.llm.queries import tokenizer_file
from tickloom.llm.suffix_array import remove_repeats
from tickloom.session import prepare, settle

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, further ones dropped, n_chars renewed."""
    return docs.withColumn("n_chars", F.length("text")).select(*(F.col(c).cast(kind) for c, kind in COLUMNS.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null text, no letter); a null lang becomes the predicted one. Null ids are kept."""
    prepare(spark)
    own = docs.select(*COLUMNS)
    model = train(own.withColumn("held_out", held_out(F.col("doc_id"))).filter("NOT held_out"))
    found = identify(own, model, tuple(COLUMNS))
    return _documents(found.filter("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand earlier in the corpus; a document that loses lines and has nothing but white space left goes."""
    prepare(spark)
    return _documents(dedup_lines(docs.select(*COLUMNS)).filter("n_dropped = 0 OR trim(BOTH ' \\n\\t\\r' FROM text) <> ''"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of the n-gram Jaccard join, that with the smallest id; a null id links with nothing and stays."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    gone = settle(near_components(docs).filter("component_id < doc_id").select("doc_id").distinct())
    kept = docs.filter("doc_id IS NOT NULL").join(gone.hint("merge"), "doc_id", "left_anti")
    # rows that share an id are one component; the join has brought them together
    one = kept.withColumn("row__", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "lang", "source"))).filter("row__ = 1").drop("row__")
    return _documents(one.unionByName(docs.filter("doc_id IS NULL")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove byte strings that stand in a document with a smaller id; a document that loses bytes and has only white space left goes."""
    prepare(spark)
    rest = remove_repeats(docs.select(*COLUMNS), ("text", "lang", "source", "n_chars"))
    return _documents(rest.filter("n_removed = 0 OR trim(BOTH ' \\n\\t\\r' FROM text) <> ''"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    prepare(spark)
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Neither the language mixture, byte-level repeats nor retrieval packing can be put as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again in the shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir)) if name != STAGES[-1][0] else stage(spark, docs, sf_dir)
    return docs
