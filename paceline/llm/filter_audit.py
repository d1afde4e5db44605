"""Filter interaction audit: what each filter removes, alone and after others, in every order.

The files of a folder are streamed as available-now micro-batches.  Four filters judge a
text by itself, the fifth fails each copy of a text but that with the smallest id, which
is known only once all files are in.  So texts are keyed state: the smallest id of each
text and its document's part and marks.  A micro-batch adds its documents to the counters
of their part and mask of failed filters; where it brings a smaller id of a known text,
the former holder's mask is retracted and counted again as a copy.  The counters are sums
of these changes, written by an exactly-once sink, and the same however files fall into
micro-batches.  From the counters of the 32 masks follow all orders and steps.

State is dealt to buckets of texts' digests, each about ``bucket_rows`` texts; tasks
merge the copies of a batch before they send them, so a text that a third of all
documents have sends a row for each batch of records.  A stopped run goes on from its
checkpoint; files added later are taken up by the next run in the same ``work`` folder.

Defined results: a null text is empty; a null lang is the part ''; a null id fails no
copy filter and makes none fail; rows that repeat a text's smallest id all keep it; of
repeated labels of an id any 1 counts; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir

FILTERS = "ABCDE"
COPY = 16  # the bit of E

_STATE = "spark.sql.streaming.stateStore"
#: State on disk, without space taken in advance: most partitions hold little.
_STORE = {f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STATE}.rocksdb.allowFAllocate": "false", f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true"}
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Audit:
    batches: int = 4  # micro-batches over the files that are there
    bucket_rows: int = 10_000  # texts of a state bucket, about
    least_buckets: int = 256


def failed_alone(text: Column) -> Column:
    """Bits 1, 2, 4, 8: few words, few distinct words, many capitals, code symbols."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size(words)
    fails = [
        n < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, part, mask, digest, good, toxic) of each document, batch or stream; texts go no further than this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), failed_alone(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    return d.join(marks, "id", "left").select("id", "part", "mask", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


_KIND = ["part", "mask", "good", "toxic"]
_SENT = "digest binary, id long, part string, mask int, good int, toxic int, n long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by text and kind: a text's smallest id stays, other copies are counted without a digest."""
    schema = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        d = batch.to_pandas()
        if not len(d):
            continue
        least = d.groupby("digest").id.transform("min")
        known, first = d.id.notna(), d.id == least
        d["mask"] = d["mask"].where(~known | first, d["mask"] | COPY)
        d["digest"] = d["digest"].where(known & first, None)
        d["id"] = d["id"].where(known & first).astype("Int64")
        out = d.groupby(["digest", "id", *_KIND], dropna=False, sort=False).size().rename("n").reset_index()
        yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of the counters by a micro-batch; state: the rows of each text's smallest id."""
    fresh = pd.concat(list(frames), ignore_index=True).drop(columns="bucket")
    copies, fresh = fresh[fresh.digest.isna()], fresh[fresh.digest.notna()]
    out = [copies[[*_KIND, "n"]]]
    if len(fresh):
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else fresh.iloc[:0]
        both = pd.concat([held, fresh], ignore_index=True)
        first = both.id == both.groupby("digest").id.transform("min")
        was_held = both.index < len(held)
        copy = both["mask"] | COPY
        lost = both[was_held & ~first]
        out += [lost.assign(n=-lost.n)[[*_KIND, "n"]], both.assign(mask=copy)[~first][[*_KIND, "n"]], both[~was_held & first][[*_KIND, "n"]]]
        now = both[first].groupby(["digest", "id", *_KIND], sort=False).n.sum().reset_index()
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(now, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    yield pd.concat(out).groupby(_KIND, sort=False).n.sum().reset_index()


def counter_changes(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Stream of (part, mask, good, toxic, n): what each micro-batch adds to and takes from the counters."""
    rows = judged(docs, labels).mapInArrow(_merged, _SENT)
    spread = F.when(F.col("digest").isNull(), F.xxhash64(*_KIND)).otherwise(F.xxhash64("digest"))
    rows = rows.withColumn("bucket", F.pmod(spread, F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(_changes, "part string, mask int, good int, toxic int, n long", "rows binary", "append", "NoTimeout")


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, work: str | None = None, params: Audit = Audit()) -> DataFrame:
    """(part, mask, n, good, toxic) over all files of ``path``; ``work`` holds checkpoint and changes of a run that may go on."""
    table = spark.read.parquet(path)
    files, rows = len(table.inputFiles()), table.count()
    work = work or f"{shared_dir(spark)}/paceline/audit-{uuid.uuid4().hex}"
    buckets = max(params.least_buckets, -(-rows // params.bucket_rows))
    # A stream takes a path for a folder unless it is a pattern; this one also matches a single file.
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // params.batches))).parquet(f"{path[:-1]}[{path[-1]}]")
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        q = counter_changes(docs, labels, buckets).writeStream.format("parquet").option("path", f"{work}/changes").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema("part string, mask int, good int, toxic int, n long").parquet(f"{work}/changes")
    return changes.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders_report(counters: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, good, toxic)."""
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(FILTERS)))
    rows = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    rows = rows.withColumn("before", F.expr("aggregate(sequence(1, 5), 0, (a, i) -> if(i < step, a + shiftleft(1, ascii(substring(filter_order, i, 1)) - 65), a))"))
    mask, bit = F.col("mask"), F.col("bit")
    here, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("before")) != 0

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0))

    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~here & ~earlier).alias("kept"),
        total("n", here & ~earlier).alias("removed"),
        total("n", here & earlier).alias("redundant"),
        total("n", mask == bit).alias("unique_fails"),
        total("good", here & ~earlier).alias("good_lost"),
        total("toxic", here & ~earlier).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_files(spark: SparkSession, path: str, labels: DataFrame, work: str | None = None, params: Audit = Audit()) -> DataFrame:
    """The report of all files of ``path``."""
    return orders_report(stream_counters(spark, path, labels, work, params))
