"""The documents' way to tokens: each stage's result is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from stepweave.llm.common import new_path, table
from stepweave.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three and more sources stay where they come first only; n_chars follows the text."""
    cleaned = line_dedup.remove_spread_lines(docs, min_sites=3, min_chars=10)
    return cleaned.selectExpr(*["cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in cleaned.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return jaccard_join.drop_near_duplicates(docs, n=2, threshold=0.6)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens instead of its text."""
    return bpe.encode_documents(docs, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents: doc_id, lang, source, n_tokens, token_ids."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := new_path(spark, f"pipeline-{k}-{name}"))
        docs = spark.read.parquet(path)
    return docs


#: No SQL: the tokens of the last stage come from a tokenizer's merges.
ORACLE_SQL = None
