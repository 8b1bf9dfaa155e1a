"""The numbered queries over the driver's tables; importing this module adds nothing by itself."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import encode_bytes
from tickloom.llm.cross_polytope import VECTORS_SQL, near_vectors
from tickloom.llm.divergence import DIVERGENCE_SQL, divergence
from tickloom.llm.fingerprints import fingerprints_with_classes
from tickloom.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from tickloom.llm.language_mix import identify_documents
from tickloom.llm.licenses import scan
from tickloom.llm.line_dedup import REPORT_SQL, line_report
from tickloom.llm.merge_dropout import encode_documents
from tickloom.llm.ngram_join import COMPONENTS_SQL, near_components
from tickloom.llm.packing import pack
from tickloom.llm.suffix_array import remove_repeats
from tickloom.llm.warc import PAGES_SQL, archive_pages
from tickloom.session import prepare

def tokenizer_file(name: str) -> str:
    """The place of a vocabulary file, the same on every machine; TOKENIZER_DIR names another folder than the installed one."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def numbered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@numbered
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprint of every document and of its edited text, with likeness figures and the class of verified near duplicates."""
    return fingerprints_with_classes(table(spark, sf_dir, "documents"))


@numbered
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of documents with smaller ids."""
    return remove_repeats(table(spark, sf_dir, "documents"))


@numbered
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stand earlier in the corpus, equal or one edit apart."""
    return line_report(table(spark, sf_dir, "documents"))


@numbered
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives and read back."""
    return archive_pages(table(spark, sf_dir, "pages"))


@numbered
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 5-word Jaccard likeness of at least 0.75."""
    return near_components(table(spark, sf_dir, "documents"))


@numbered
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return scan(table(spark, sf_dir, "documents"))


@numbered
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with equal labels and a cosine of at least 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@numbered
def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with seeded merge dropout and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), seed=7, chance=0.1)


@numbered
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the three quarters that are not held out."""
    return identify_documents(table(spark, sf_dir, "documents"))


@numbered
def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens with their lexical neighbours."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@numbered
def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the terms of every source diverge from those of other sources and of its language."""
    return divergence(table(spark, sf_dir, "documents"))


@numbered
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of ids divisible by 7 are moved on by one first."""
    vectors = table(spark, sf_dir, "embeddings")
    return hard_negatives(vectors.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (cast(label AS long) + 1) % 10 ELSE label END")))


@numbered
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with byte-level BPE and decoded again."""
    return encode_bytes(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


ORACLES.update(op3_line_dedup=REPORT_SQL, op4_warc=PAGES_SQL, op5_ngram_jaccard=COMPONENTS_SQL, op7_cross_polytope=VECTORS_SQL, op11_divergence_audit=DIVERGENCE_SQL, op12_hard_negatives=NEGATIVES_SQL)
