"""The training-text pipeline: toxic and bad documents go, shared lines go, near duplicates go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last return the columns of documents; labels to learn from come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keylake.llm import line_dedup, near_dedup, packing, quality_rules, toxicity
from keylake.llm.common import stored, table
from keylake.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op8(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_copies), ("packing", pack)]
#: SQL can't express learning and packing; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
