"""The registered queries of the subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, licenses, mixing, neardup, quality, sharding, suffixdedup, transport
from .oracles import oracle_sql  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("source")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat.END + chat.START + "assistant ok"
    record = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    more = chat.canonical(spark.createDataFrame([(-1, record)], "conv_id long, record string")).select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(chat.table_turns(_read(spark, sf_dir, "conversations")).unionByName(more)))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_read(spark, sf_dir, "documents"))


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.unpacked(transport.packed(_read(spark, sf_dir, "documents"))).drop("counter_errors", "units")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_read(spark, sf_dir, "documents"))


def op10_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_mix, op3_shard, op4_licenses, op5_chat, op6_neardup, op7_transport, op8_quality, op9_langid, op10_suffixdedup)}
