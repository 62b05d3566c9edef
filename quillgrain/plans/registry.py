"""All registered queries of the library proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrain.plans import basics, corpus, folds, investigation, recall, streams

MODULES = [basics, corpus, folds, investigation, recall, streams]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall."""
    return QUERIES["r09_hybrid_search"](spark, sf_dir)
