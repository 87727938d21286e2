"""The corpus pipeline: documents that the corpus keeps, as token ids.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns
a DataFrame; ``run`` writes each as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from lodestream.llm.common import cut, table

#: A document whose language has less than this mean probability is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. Trained on the labelled ones among them; null,
    empty and letterless texts go, a null ``lang`` teaches nothing and takes nothing away."""
    net = language_id.fit(docs)
    named = language_id.identify(docs, net)
    return named.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten documents or more have; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, min_docs=10).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item stand."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids for ``text``, with ``n_tokens`` and the text decoded from them (``decoded``)."""
    tok = bpe.public_tokenizer()
    out = bpe.decode(bpe.encode(docs, tok), tok)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded", F.col("decoded").cast("string"))


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near), ("decontamination", benchmarks), ("BPE", tokens)]

#: Language ID is a trained network: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
