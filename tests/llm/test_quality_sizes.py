"""Every trusted document counts, and verdicts are alike at every size."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paceline.llm import quality

DATA = Path("/root/testdata")


def test_all_trusted_documents_count(spark):
    """25,000 trusted documents, more than any bound of a fit, are all in the target."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    raw, target = quality.counts(docs, spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality"))
    assert raw.sum() > 25_000 * 5 and (raw == target).all()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_verdicts_do_not_follow_size(spark, size):
    """Of labelled documents past the base rules, each scored without itself, good ones stay and bad ones go."""
    if not (DATA / size).exists():
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(str(DATA / size / f"{t}.parquet")) for t in ("documents", "labels"))
    out = quality.quality_digest(docs, labels).where("not base_failed").join(labels.dropDuplicates(["doc_id"]), "doc_id")
    kept = {r.quality: r.share for r in out.where("quality is not null").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.95 and kept[0] <= 0.1


def test_no_trusted_document(spark):
    """Without a trusted document only the base rules decide; one alone keeps itself."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "l m n"), (None, "q r s t u v w x y z 1 2"), (3, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(None, 1)], [(2, 1)], [(1, 1)]):
        out = quality.quality_digest(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        kept = {r.doc_id: r.kept for r in out}
        assert kept[1] and not kept[2] and not kept[3] and len(out) == 4
        assert (1, 1) in labels or kept[None]
