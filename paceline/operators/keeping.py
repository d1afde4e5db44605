"""Cuts of lineage between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _kept(d: DataFrame) -> DataFrame:
    """A reliable checkpoint; a local session without a folder for it caches, where there are no executors to lose."""
    spark = d.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return d.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
    return d.persist()
