"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import decontamination, line_dedup, packing, quality_rules, simhash
from daybook.llm.common import discard, settle, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: The pipeline hashes with XXH64 and tokenises, which SQL cannot express; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's whole result is written as Parquet in the shared folder and read again as the next one's input; it is
    deleted when the next one's result is written."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        if place:
            discard(before)
    return docs
