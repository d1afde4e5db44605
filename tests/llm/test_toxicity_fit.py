"""The corpus is read in parallel for the fit."""

from pathlib import Path

from pyspark import TaskContext

from paceline.llm import toxicity


def test_fit_reads_the_corpus_in_parallel(spark, tmp_path):
    seen = str(tmp_path)

    def run(batches):
        for batch in batches:
            Path(seen, str(TaskContext.get().partitionId())).touch()
            yield batch

    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'bad vile words', 'good kind words') AS text").mapInArrow(run, "doc_id long, text string")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS int) AS toxic")
    weights = toxicity.fit(docs, labels)
    assert weights and len(list(tmp_path.iterdir())) == 8
