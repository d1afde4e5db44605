"""Plumbing of the corpus operators: shared tables, keys, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session that leaves it unset gets a temporary folder if it is local, where driver
    and executors are one process, and an error on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="paceline-shared-")
    return _own_dir[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the running stage, not the plan
    that led to the table.  The shuffle files of finished jobs can go afterwards,
    so they are released at once rather than at the driver's next collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paceline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (in any case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def binary_list(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return column(batch, name).to_pylist()


def text_bytes(name: str = "text"):
    return F.col(name).cast("binary").alias(name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the smallest node.

    Alternates large-star and small-star rounds, each a grouped minimum and a join
    on it; AQE splits the join partitions of a hub.  Every round is written and
    reread.  Self loops and repeated edges are fine; an empty input gives no rows.
    """
    e = stash(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(tops).groupBy("node").agg(F.min("component").alias("component"))
