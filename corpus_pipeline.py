"""From raw documents to shards: language, near duplicates, benchmark passages, source mix, uniform shuffle.

Each stage is a function (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceline.llm import decontaminate, langid, mixing, neardup, sharding
from paceline.llm.store import dropped, written

#: weighted similarity of shingles of five words from which documents are near duplicates
NEAR = 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, whatever its score; only texts that are null or have no letter go."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near duplicates; documents without words all stay."""
    return neardup.deduplicated(docs, threshold=NEAR)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item: no window of eight words (or whole shorter item of five or more) occurs."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's target, repeated by epoch."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix, with source, lang and n_chars; texts are not carried along."""
    return sharding.shards(docs, keep=("source", "lang", "n_chars"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can express neither the language network nor the signatures; the stages are tested one by one
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    out = written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
    dropped(docs)
    return out
