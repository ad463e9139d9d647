"""A training corpus from raw documents, stage by stage.

Each stage gets all rows that its predecessor kept and returns the columns of
``documents`` (the last adds tokens); other columns are dropped.  ``run`` writes each
stage to the shared folder, so that a lost executor repeats tasks of one stage
only.  In every stage an empty table gives no rows, and rows are judged by
themselves: one that shares its id with others (null ids included) stays or goes by
its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, line_templates, simhash, weak_labels
from lattica.llm.common import materialize, scratch, table

#: Bits within which the trees propose near-duplicates.
RADIUS = 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text, which tells rows that share an id apart."""
    return docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("hash")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose key ``gone`` (column _key) holds."""
    gone = gone.select(F.col("_key.doc_id").alias("_id"), F.col("_key.hash").alias("_hash")).distinct()
    same = docs.doc_id.eqNullSafe(gone["_id"]) & (F.xxhash64(docs.text) == gone["_hash"])
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as low in quality or toxic, go.

    Null and empty texts are of low quality; repeated rows get the same verdict.
    """
    model = weak_labels.fit(docs, table(spark, sf_dir, "labels"))
    return weak_labels.score(docs, model).where("not rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the document that has them first.

    Null and empty texts stay as they are; of documents that share a line the smallest
    id keeps it (null ids come first, all rows of that id keep it); n_chars is that of
    the text that is left.
    """
    table(spark, sf_dir, "documents")
    return _like_documents(line_templates.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Groups are linked by a share of 0.8 or more of the five-word shingles; null and
    empty texts are one group.  Null ids come first, ties are settled by the hash of
    the text, and rows that share both stay together.
    """
    table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(_key(docs), doc_id="_key", shingle=5, radius=RADIUS, verify=True)
    return _without(docs, found.where(~F.col("_key").eqNullSafe(F.col("component_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    found = decontaminate.decontaminate(_key(docs), table(spark, sf_dir, "benchmark"), doc_id="_key")
    return _without(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, as ids joined by spaces; null and empty texts have none, repeated rows their own row each."""
    table(spark, sf_dir, "documents")
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encode", encode),
]

#: The classifier, the template tree and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        with scratch() as own:
            docs = own.keep(materialize(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
