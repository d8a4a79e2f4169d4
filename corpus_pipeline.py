"""A cleaning pipeline over ``documents``: each stage works on all that the one before kept.

Null and empty texts, and those without a letter, have no language and go in the first
stage.  Stages tell documents apart by doc_id: rows that share one are kept or dropped
together, and rows without doc_id are kept.  Of equal and near texts the smallest doc_id
stays.  Texts of any length are handled whole; more columns are carried up to the last
stage, whose rows are pieces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import materialise, table
from tessella.llm.exact_dedup import keep_first
from tessella.llm.language import known_language
from tessella.llm.order_minhash import keep_one
from tessella.llm.packing import pack_stage
from tessella.llm.suffix_dedup import cut_repeats

#: (name, function of (spark, docs, sf_dir)); each result is the next one's docs.
STAGES = [
    ("language", known_language),
    ("exact_dedup", keep_first),
    ("near_dedup", keep_one),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_stage),
]

#: Neither language models, near duplicates nor packing can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
