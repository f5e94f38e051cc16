"""The corpus pipeline: five stages over ``documents``, each over all that its predecessor kept.

Defined results: a null text counts as empty, is never toxic, links with nothing and has no pieces; a null id is
never labelled and links with nothing; rows that repeat an id and a text pass or go together, except that one with
a smaller id stands for a group of near copies; an empty table gives an empty one; all other columns, whatever
their names, pass through unread, but ``n_chars`` follows the text, and the last stage puts its own ``pieces`` and
``lossless`` in the place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import linededup, mixing, ngramjoin, pieces, tokencounts, toxicity
from tripleweave.llm.shared import small_side, written
from tripleweave.sources.folders import scratch

PIECE_BPE = "piece_bpe_32k.model"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but id and text under names that no operator uses, and the way back."""
    held = {c: c if c in ("doc_id", "text") else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in held.items())), lambda df: df.select(*(F.col(n).alias(c) for c, n in held.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not flag."""
    plain, back = _aside(docs)
    chain = toxicity.train(plain, _labels(spark, sf_dir), toxicity.label_chain())
    return back(toxicity.scored(plain, chain).where(~F.col("flagged")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and nearly repeated lines; documents of which nothing is left go."""
    plain, back = _aside(docs)
    kept = linededup.deduplicated(plain).where((F.col("n_exact") + F.col("n_near") == 0) | (F.trim("text") != ""))
    kept = back(kept)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by word 5-grams (Jaccard 0.8 or more) the one with the smallest id."""
    groups = ngramjoin.ngram_join(docs, k=5, percent=80)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, 24), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the high-quality domain once each, the others as often as their rates say, once at most.

    The target weights are met by thinning the low-quality domain; a document that is more likely clean than not stays.
    """
    plain, back = _aside(docs)
    rated = mixing.mixed_rates(plain, _labels(spark, sf_dir), mixing.quality_domain(), mixing.TARGETS, anchor="high")
    return back(rated.where((F.coalesce(F.col("posteriors")["high"], F.lit(1.0)) >= 0.5) | (F.col("copies") > 0)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces under merge-dropout."""
    return pieces.encoded(docs, tokencounts.tokenizer_path(PIECE_BPE), dropout=0.1, seed=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mix),
    ("pieces", encode),
]

#: The classifiers, the mixing and the encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
