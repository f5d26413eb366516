"""The corpus pipeline: five stages over documents, each calling one operator of fabula.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of docs. Rows are kept or dropped whole, each by its own text where rows share an id; null texts count as empty, empty
tables stay empty, further columns pass through, and of repeated rows (equal id and text) one stays from exact dedup on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from fabula.llm.common import cut, drop_cut, scratch, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (score of 0.3 or more) go; it learns from the labels that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.first_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    with scratch():
        gone = cut(near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id", "text_hash"), "near-copies", outer=True)
    return without(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go."""
    with scratch():
        found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
        gone = cut(found.where("contaminated").select("doc_id", "text_hash"), "contaminated", outer=True)
    return without(docs, gone)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, digests of them and of the decoded text."""
    return bpe.encode_documents(docs, bpe.default_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written to the shared folder and read again, and a stage's own tables go when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            kept = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"), outer=True)
        drop_cut(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
