"""The corpus queries ``opN_<name>`` and ``pipeline``, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import fingerprints, licences, linededup, mixing, ngramjoin, pieces, pii, tokencounts, toxicity, vectors

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), tokencounts.tokenizer_path(WORD_BPE))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), mixing.quality_domain(), mixing.TARGETS, keep=["doc_id"])
    shares = [F.col("posteriors")[d].alias(f"p_{d}") for d in mixing.TARGETS]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # source and language are the directories that the table has; only whole licence texts are their licence files,
    # as one short notice would give its licence to all others
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")]
    return licences.scanned(_table(spark, sf_dir, "documents"), F.concat_ws("/", *parts), file_words=licences.TEXT_WORDS)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(_table(spark, sf_dir, "documents")))


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.counted(pieces.encoded(docs, tokencounts.tokenizer_path(PIECE_BPE), dropout=0.1, seed=1))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.label_chain())
    return toxicity.scored(docs, chain).drop("text").withColumnRenamed("flagged", "toxic")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_near_vectors": op2_near_vectors,
        "op3_line_dedup": op3_line_dedup,
        "op4_ngram_join": op4_ngram_join,
        "op5_mixing": op5_mixing,
        "op6_licences": op6_licences,
        "op7_personal_data": op7_personal_data,
        "op8_piece_dropout": op8_piece_dropout,
        "op9_toxicity_chain": op9_toxicity_chain,
        "op10_fingerprints": op10_fingerprints,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_vectors": vectors.ORACLE_SQL,
        "op4_ngram_join": ngramjoin.ORACLE_SQL,
    }
