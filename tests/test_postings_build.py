"""The keyword index's build: each text is tokenised once, and the statistics are those of the texts."""

from pyspark.sql import functions as F

from recallgrid.operators import postings


def test_tokenised_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "id long, content string")
    plan = postings.occurrences(docs.repartition(3, "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "split(" not in plan.split("RepartitionByExpression")[1]


def test_statistics(spark, tmp_path):
    for i, rows in enumerate([[(1, "a b c"), (2, ""), (3, None), (4, "d, d")], [(1, "...")], [(1, None)]]):
        docs = spark.createDataFrame(rows, "id long, content string")
        postings.build(docs, f"file://{tmp_path}/{i}")
        index = postings.load(spark, f"file://{tmp_path}/{i}")
        assert index.stats.collect() == postings.statistics(docs).select("n", "avg_len").collect()
        assert index.stats.schema["n"].dataType == postings.statistics(docs).schema["n"].dataType
        assert sorted(index.postings.collect()) == sorted(postings.occurrences(docs).collect())
