"""The corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import common, exact, mixing, packing, simhash, toxicity

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mix_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained models, hashes and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table in the shared folder that the next stage reads."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
