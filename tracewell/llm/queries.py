"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import id_crc, scratch, table
from tracewell.llm.decontaminate import contaminated
from tracewell.llm.fingerprints import fingerprint_edits
from tracewell.llm.html_text import extract_main_text
from tracewell.llm.language import UNKNOWN, identify_language
from tracewell.llm.neighbours import nearest_neighbours
from tracewell.llm.packing import pack_documents
from tracewell.llm.ranked_search import ranked_search
from tracewell.llm.simhash import simhash_components
from tracewell.llm.token_files import read_token_files, write_token_files
from tracewell.llm.tool_calls import TOOLS, calls_of_conversations, link_tool_calls
from tracewell.llm.toxicity import score_toxicity
from tracewell.llm.vector_codes import vector_codes
from tracewell.llm.warc import read_warc, write_warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.where(id_crc("doc_id") % 5 != 0)
    scored = score_toxicity(docs, training, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*calls_of_conversations(table(spark, sf_dir, "conversations")), TOOLS)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    names = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, names).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, docs.where(id_crc("doc_id") % 4 != 2))
    return found.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_neighbours, op3_token_files, op4_tool_calls, op5_decontaminate, op6_warc, op7_main_text, op8_simhash, op9_language, op10_packing, op11_vector_codes, op12_fingerprints, op13_ranked_search, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """For what SQL can express on whole tables; the rest is tested against brute force."""
    from tracewell.llm.oracles import ORACLES

    return ORACLES
