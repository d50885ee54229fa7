"""Labels of held-out documents must not reach the model."""

from pyspark.sql import functions as F

from auctionstream.llm import toxicity
from llm_rows import prose


def test_held_out_labels_change_no_score(spark, frame):
    rows = [(i, prose(600 + i, 40) + (" What a vile scoundrel." if i % 4 == 0 else ""), "t") for i in range(160)]
    docs = frame(rows)
    labels = spark.createDataFrame([(d, int("vile" in t)) for d, t, _ in rows] + [(9_999, 1)], "doc_id long, toxic int")
    usable = toxicity.not_held_out("doc_id")
    flipped = labels.withColumn("toxic", F.when(usable & (F.col("doc_id") < 1_000), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert flipped.exceptAll(labels).count() > 10
    models = [toxicity.train(docs, x, usable) for x in (labels, flipped)]
    assert models[0].weights and models[0] == models[1]
    one_kind = [toxicity.train(docs, x.where(~usable | (F.col("toxic") == 0)), usable) for x in (labels, flipped)]
    assert not one_kind[0].weights and one_kind[0] == one_kind[1]
