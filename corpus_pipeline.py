"""The corpus pipeline: from documents to packed sequences.

Each stage works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, simhash, toxicity
from tidemark.llm.common import ready, table, unused_name, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents still here, doesn't call toxic.

    Null and empty texts get the classifier's base score; rows of one id are
    judged each by its own text; without labels of both kinds the base rate
    decides; an empty table stays empty.
    """
    ready(spark)
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return docs.filter(toxicity.scorer(model)("text") < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the bulk of their language and source.

    Null and empty texts have too few words and go; null languages and sources
    are groups of their own; rows of one id are judged each by its own text; an
    empty table stays empty.
    """
    ready(spark)
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, then the smallest fingerprint; rows without an id come last.

    An id may stand on several rows. Rows of one id in different groups are
    told apart by their fingerprint, so no group loses its document and none
    keeps two. Of rows equal in both, the first by text, language, source and
    length stays. Null texts count as empty; an empty table stays empty.
    """
    ready(spark)
    made, first = simhash.representatives(docs)
    chosen = written(first, "kept-prints")
    repeated = written(made.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    id_, said, print_, kept_print = (unused_name(docs, stem) for stem in ("kept_id", "same_text", "print", "kept_print"))
    single = chosen.join(repeated, "doc_id", "left_anti").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_))
    kept = docs.join(single, F.col("doc_id") == F.col(id_), "left_semi").select(docs.columns)
    if repeated.isEmpty():
        return kept
    # Only rows whose id does not name them get their fingerprints again.
    again = docs.join(repeated.select(F.col("doc_id").alias(id_)), F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    texts = again.select(F.coalesce("text", F.lit("")).alias("doc_id")).distinct().withColumn("text", F.col("doc_id"))
    prints = simhash.fingerprints(texts).select(F.col("doc_id").alias(said), F.col("print").alias(print_))
    marked = again.join(prints, F.coalesce("text", F.lit("")) == F.col(said)).join(
        chosen.select(F.col("doc_id").alias(id_), F.col("print").alias(kept_print)), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(print_) == F.col(kept_print)), "left_semi")
    order = F.struct(F.coalesce("text", F.lit("")), "lang", "source", "n_chars")
    one = marked.groupBy("doc_id", print_).agg(F.min_by(F.struct(docs.columns), order).alias(said)).select(f"{said}.*")
    return kept.unionByName(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents left, with their sequences.

    A null text counts as empty: one piece of the end token. Rows of one id, and
    rows without an id, are packed each for itself.
    """
    ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: None: the classifier's and the estimator's verdicts are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each works on what its predecessor wrote."""
    docs = table(ready(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
