"""Documents to packed training sequences in five stages.

Counted as part of ``logloom.llm``.  Every stage takes ``(spark, docs, sf_dir)``
and works on all its predecessor kept; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import langid, mixing, nearcopies, packing, suffix
from logloom.llm.queries import MIX_TARGETS, tokenizer_path
from logloom.llm.shared import write_and_read

#: A document that finds less than this share of the n-grams a text of its language finds is not in one of them.
LEAST_SCORE = 0.1
SHINGLE = 5  # words


def _aside(docs: DataFrame, *names: str):
    """``docs`` with columns of these names renamed, and what brings its columns back."""
    held = {c: f"_aside_{c}" for c in names if c in docs.columns}
    back = lambda df: df.drop(*names).withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
    return docs.withColumnsRenamed(held), back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no known language: without a letter, or with hardly an n-gram of any.

    The filters are learned from the rows the language query learns from; the
    language column stays as it was.
    """
    filters = langid.learn(docs, langid.split_of("doc_id", 4) != 2)
    held, back = _aside(docs, "lang_pred", "score")
    told = langid.predict(held, filters)
    return back(told.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.least_scores(filters, LEAST_SCORE))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word Jaccard similarity of 0.8 or more.

    Texts to compare are those whose five-word SimHash is within 2 bits, which
    hardly finds more than tiny changes, and those that share a band of minima;
    the similarity of the whole texts decides.
    """
    return nearcopies.keep_first(docs, size=SHINGLE)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes or more that a document with a smaller id has.

    Documents of which nothing is left go; ``n_chars`` is counted anew.
    """
    held, back = _aside(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    less = suffix.remove_repeats(held)
    left = less.where(~((F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)))
    return back(left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents so that sources reach their target weights; a global shuffle."""
    held, back = _aside(docs, "copy", "shuffle_key")
    return back(mixing.mix(held, MIX_TARGETS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4,096 tokens; repeated rows are documents of their own."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("simhash", drop_near_duplicates),
    ("repeats", remove_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL has no XXH64, tokenizer or learned filters: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
