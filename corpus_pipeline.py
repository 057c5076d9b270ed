"""From documents to packed sequences: toxicity, language ID, near-duplicates, packing.

Each stage takes what the one before it kept; all but the last return the columns of documents, whatever
these are besides doc_id, text and lang.

Cases, for every stage: rows with nulls in any column and texts of any length are judged like others; an
empty table gives an empty one. A null or empty text is clean, but in no known language, so it goes in the
second stage. Repeated rows are judged alike until the third stage, which keeps one of them; of texts that tie
for a group the one with the smallest doc_id (null last), then with the smallest digest, stays. A score of
exactly 0.3 is toxic. Models of a table without labels judge nothing toxic and know no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, langid, packing, simhash_dedup, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.3 or more."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.clean(docs, toxicity.fit(toxicity.labelled_sample(docs, labels)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters, or less likely than calibration allows under every model."""
    return langid.accepted(docs, langid.fit(langid.labelled_sample(docs)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more, found by SimHash, verified."""
    return simhash_dedup.one_of_each(docs, simhash_dedup.near_duplicates_by_similarity(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Models are fitted and texts tokenised on the way, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"), keep=True)
    return docs
