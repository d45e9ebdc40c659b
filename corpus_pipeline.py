"""The corpus pipeline: toxicity, language, near-duplicates, benchmark decontamination, packing, over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import id_crc, materialise, table
from tracewell.llm.decontaminate import contaminated
from tracewell.llm.language import identify_language
from tracewell.llm.packing import pack_documents
from tracewell.llm.simhash import near_duplicates
from tracewell.llm.toxicity import score_toxicity

ORACLE_SQL = None  # classifiers and fingerprints; tests compare the stages with brute force


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, which an operator carries along whatever its columns are called."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, the network trained on the labels of the documents outside the held-out fifth.

    Null, empty and wordless texts score near 0 and stay; repeated rows stay; an empty table stays empty.
    """
    everything = table(spark, sf_dir, "documents")
    scored = score_toxicity(_with_row(docs), everything.where(id_crc("doc_id") % 5 != 0), table(spark, sf_dir, "labels"), carry=("row",))
    return scored.where("score < 0.5").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject stay: texts with letters, near enough to a centroid.

    Null texts and texts without letters go; repeated rows stay; an empty table stays empty.
    """
    everything = table(spark, sf_dir, "documents")
    found = identify_language(_with_row(docs), everything.where(id_crc("doc_id") % 4 != 2), carry=("row",))
    return found.where("not rejected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays, once.

    Texts without words are like no other and stay. Of rows with one id, one stays. Null ids are not compared by id and stay; an
    empty table stays empty.
    """
    classes = near_duplicates(docs)
    kept = docs.join(classes.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    again = materialise(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if not again.take(1):
        return kept
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits allowed for, stay; so do null and empty texts, and rows without id."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' token ids, one per power-of-two piece; a null or empty text gives its end id."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
