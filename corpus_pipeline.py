"""The corpus pipeline: five operators of tracewright.llm, one after the other, over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.base import fold_of, materialize, table
from tracewright.llm.byte_bpe import token_digests
from tracewright.llm.language import UNDETERMINED, fit_languages, predict_languages
from tracewright.llm.mixing import mix_documents
from tracewright.llm.near_duplicates import one_of_each
from tracewright.llm.pseudonyms import DEMO_KEY, pseudonymize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined (no text, or no letter in it) go; a missing language is filled in.

    Where no document to learn from names its language there is no network: texts with a letter stay, a missing language stays null.
    """
    network = fit_languages(docs.filter(docs["doc_id"].isNull() | (fold_of("doc_id", 3) != 1)))
    if network is None:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    known = predict_languages(docs, network).filter(F.col("lang_pred") != UNDETERMINED)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more) stays: that with the smallest id."""
    return one_of_each(docs)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    done = pseudonymize(docs, DEMO_KEY)
    return done.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed, _ = mix_documents(docs, F.array("source"), keep=tuple(docs.columns))
    return mixed.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return token_digests(docs)


STAGES = [("language", language), ("near_duplicates", deduplicate), ("pseudonyms", protect), ("mixing", mix), ("byte_bpe", tokenize)]

#: Trained networks, similarity and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
