import zlib

import numpy as np
import pytest

import edges
from tablecraft.llm import toxicity, toxicity_tables
from tablecraft.llm.common import table

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    return docs, labels, toxicity_tables.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, classifier = fitted
    rows = toxicity_tables.score(docs, classifier).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    score, toxic = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows]) == 1
    rank = score.argsort().argsort()
    area = (rank[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum()
    caught = np.array([r["predicted"] for r in rows]) == 1
    assert area > 0.93 and caught[toxic].mean() > 0.85 and toxic[caught].mean() > 0.85


def test_held_out_labels_and_other_columns_do_not_matter(spark, fitted):
    docs, labels, classifier = fitted
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(doc_id AS STRING)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    other = toxicity_tables.fit(docs.selectExpr("doc_id", "text", "'x' AS lang", "1 AS n_chars"), turned)
    assert np.array_equal(other.weights, classifier.weights) and other.evidence == classifier.evidence


def test_odd_rows(spark, fitted):
    docs = edges.documents(spark)
    got = toxicity_tables.score(docs, fitted[2])
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert got.where("predicted != CASE WHEN score >= 0.3 THEN 1 ELSE 0 END").count() == 0
    assert toxicity_tables.score(edges.empty(spark), fitted[2]).count() == 0


def test_without_labels_or_documents(spark):
    docs = edges.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    null = spark.createDataFrame([(None, 1), (1, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    for labels in (none, null):
        for rows in (docs, edges.empty(spark)):
            scores = toxicity_tables.fit(rows, labels).score(["a", "", None])
            assert len(set(scores)) == 1 and scores[0] < 0.3


def test_risk_stays_non_negative_when_the_prior_is_too_high():
    toxic = [[b"bad%d" % (k % 3), b"x%d" % k] for k in range(60)]
    mixed = [[b"good%d" % (k % 5), b"y%d" % k] for k in range(300)] + toxic[:15]
    fitted = toxicity.train(toxic, mixed, 0.3)
    assert np.isfinite(fitted.weights).all()
    bad, good = fitted.score(["bad1 bad2", "good1 good2"])
    assert bad > good
