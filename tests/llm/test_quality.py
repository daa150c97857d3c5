import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import quality, queries
from postmill.llm.common import fold
from llm_tables import docs_table, messy_rows, words


@pytest.fixture(scope="module")
def labelled(spark):
    """Plain texts are good, texts of marked words bad."""
    import random
    draw, rows, labels = random.Random(1), [], []
    for i in range(240):
        good = i % 3 > 0
        text = words(draw, 30 + i % 50)
        rows.append((i, text if good else text.replace(" ", "*** "), "en", "a"))
        labels.append((i, int(good), 0))
    return docs_table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels, fold("doc_id", 5) != 0).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and all(r.predicted == r.quality for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    learn = fold("doc_id", 5) != 0
    assert sorted(map(tuple, quality.classify(docs, labels, learn).collect())) == sorted(
        map(tuple, quality.classify(docs, turned, learn).collect()))


def test_compiled_rules_equal_numpy(spark, labelled):
    docs, _ = labelled
    draw = np.random.default_rng(2)
    x = draw.random((300, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4) | (x[:, 7] > 0.8)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.predict(x) >= 0.5) == (y > 0)).mean() > 0.97
    assert any(len(r) > 1 for r in model.rules)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.allclose([r[0] for r in frame.select(model.score()).collect()], model.predict(x))


def test_messy_rows_and_no_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.classify(messy, none, F.lit(True)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in messy_rows())
    assert {r.score for r in got} == {0.5}
    assert quality.classify(empty, none, F.lit(True)).collect() == []
    odd = spark.createDataFrame([(10, None), (11, 7), (12, 1), (12, 0), (12, 1), (None, 0)], "doc_id bigint, quality int")
    assert len(quality.classify(messy, odd, F.lit(True)).collect()) == len(messy_rows())


def test_whole_text_counts():
    assert quality.text_statistics("a " * 100_000 + "***" * 5_000) != quality.text_statistics("a " * 100_000)
    assert len(quality.text_statistics("")) == len(quality.STATISTICS)


def test_sample_is_bounded_and_repeatable(labelled):
    from postmill.llm.common import hash_sample
    docs, _ = labelled
    a = [r.doc_id for r in hash_sample(docs, 50, "doc_id").collect()]
    assert len(a) == 50 and a == [r.doc_id for r in hash_sample(docs.repartition(5), 50, "doc_id").collect()]


def test_query_on_held_out_documents(spark):
    """Scores of the registered query order held-out documents as their labels do."""
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op1_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    good, bad = ([r.score for r in held if label[r.doc_id] == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 10
    pairs = [(a > b) + 0.5 * (a == b) for a in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
