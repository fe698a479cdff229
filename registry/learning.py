"""Learned models, each fitted anew by its query with the library's defaults.

What a fit finds has no SQL. What must hold of any fit has: how many rows are scored,
that the confusion adds up, that the metrics follow from the scored rows, that the
importances share out a whole.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from registry import query
from registry.encoding import LINE_CATEGORIES, LINE_FEATURES
from registry.fixtures import LINES, lines, rounded, table
from tablecraft.functions.cluster import fresh_path, local_table
from tablecraft.operators import classify, evaluate, split
from tablecraft.plans import training
from tablecraft.sources import models

KEY = ["l_orderkey", "l_linenumber"]
LEARNERS = ("logistic", "random_forest", "linear_svm", "gbt")
IN_TEST = (
    "CAST('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, '42')), 1, 8) AS BIGINT)"
    " / 4294967296.0::DOUBLE >= 0.8"
)


def _trained(spark, sf: str, learner: str) -> training.Trained:
    return training.run(lines(spark, sf), LINE_FEATURES, LINE_CATEGORIES, "label", learner, key=KEY)


def _metrics(learner: str):
    def run(spark, sf):
        return rounded(_trained(spark, sf, learner).metrics, ["value"])

    return run


def _importance(learner: str):
    def run(spark, sf):
        return rounded(_trained(spark, sf, learner).importance, ["importance", "importance_pct"])

    return run


for _learner in LEARNERS:
    query(_learner)(_metrics(_learner))
    query(f"feature_importance_{_learner}")(_importance(_learner))


def _accuracy_again(scored):
    """Accuracy, precision and recall of class 1 straight from the rows, without the confusion table."""
    hit = F.col("label") == F.col("prediction")
    yes, said = F.col("label") == 1, F.col("prediction") == 1
    row = scored.agg(
        F.avg(hit.cast("double")).alias("accuracy"),
        F.coalesce(F.count_if(hit & yes) / F.nullif(F.count_if(said), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.count_if(hit & yes) / F.nullif(F.count_if(yes), F.lit(0)), F.lit(0.0)).alias("recall"),
    ).first()
    return row.asDict()


def _facts(learner: str):
    """What must hold of any fit of the learner, one row per fact."""

    def run(spark, sf):
        found = _trained(spark, sf, learner)
        counts = found.scored.agg(
            F.count("*").alias("n"), F.sum("label").alias("p"), F.count_if(F.col("score").isNull()).alias("none")
        ).first()
        told = {r["metric"]: r["value"] for r in found.metrics.collect()}
        again = _accuracy_again(found.scored)
        shares = found.importance.agg(F.count("*").alias("n"), F.sum("importance_pct").alias("t")).first()
        facts = [
            ("rows scored", float(counts["n"])),
            ("labels of class 1", counts["p"]),
            ("rows without score", float(counts["none"])),
            ("confusion in all", float(found.confusion.agg(F.sum("count")).first()[0])),
            ("metrics that differ", float(sum(abs(told[m] - v) > 1e-9 for m, v in again.items()))),
            ("area outside of 0 to 1", float(not 0 <= told["auc"] <= 1)),
            ("features weighed", float(shares["n"])),
            ("shares in all", round(shares["t"], 6)),
        ]
        found.scored.unpersist()
        return local_table(spark, facts, "fact string, value double")

    return run


def _facts_sql() -> str:
    n_features = len(LINE_FEATURES) + len(LINE_CATEGORIES)
    return "WITH " + LINES + f""", test AS (SELECT label FROM lines WHERE {IN_TEST})
SELECT 'rows scored' AS fact, CAST(count(*) AS DOUBLE) AS value FROM test
UNION ALL SELECT 'labels of class 1', sum(label) FROM test
UNION ALL SELECT 'rows without score', 0
UNION ALL SELECT 'confusion in all', count(*) FROM test
UNION ALL SELECT 'metrics that differ', 0
UNION ALL SELECT 'area outside of 0 to 1', 0
UNION ALL SELECT 'features weighed', {n_features}
UNION ALL SELECT 'shares in all', 100"""


for _learner in LEARNERS:
    query(f"fit_facts_{_learner}", _facts_sql())(_facts(_learner))


@query("logistic_sigmoid", "WITH " + LINES + f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM lines WHERE {IN_TEST}""")
def logistic_sigmoid(spark, sf):
    """Scores against the logistic function of the model's own coefficients, row by row."""
    train, test = split.hash_split(lines(spark, sf), KEY)
    model = classify.fit(train, "logistic", LINE_FEATURES, LINE_CATEGORIES)
    fitted = model.stages[-1]
    scored = classify.score(model, test).withColumn("parts", vector_to_array("features"))
    linear = F.lit(float(fitted.intercept))
    for i, weight in enumerate(fitted.coefficients.toArray().tolist()):
        linear = linear + F.lit(weight) * F.col("parts")[i]
    expected = 1 / (1 + F.exp(-linear))
    return scored.agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("score") - expected) > 1e-9).alias("differing")
    )


@query("train_and_evaluate_roc")
def train_and_evaluate_roc(spark, sf):
    return _trained(spark, sf, "logistic").roc


@query("train_and_evaluate_confusion")
def train_and_evaluate_confusion(spark, sf):
    return _trained(spark, sf, "random_forest").confusion


@query("compare_learners")
def compare_learners(spark, sf):
    found = training.run_each(lines(spark, sf), LINE_FEATURES, LINE_CATEGORIES, "label", LEARNERS, key=KEY)
    return rounded(evaluate.compare({name: trained.scored for name, trained in found.items()}), ["value"])


@query("score_saved_model")
def score_saved_model(spark, sf):
    return _saved_and_scored(spark, sf)[1].select(
        *KEY, "label", "prediction", F.round("score", 6).alias("score")
    )


def _saved_and_scored(spark, sf):
    """Test rows scored by a model and by what was read back after saving it."""
    path = fresh_path(spark, "model")
    train, test = split.hash_split(lines(spark, sf), KEY)
    model = classify.fit(train, "logistic", LINE_FEATURES, LINE_CATEGORIES)
    models.save(model, path)
    return classify.score(model, test), classify.score(models.load(path), test)


@query("saved_model_scores_alike", "WITH " + LINES + f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM lines WHERE {IN_TEST}""")
def saved_model_scores_alike(spark, sf):
    before, after = (
        s.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("prediction").alias("p"))
        for s in _saved_and_scored(spark, sf)
    )
    after = after.withColumnsRenamed({"n": "n2", "score": "score2", "p": "p2"})
    same = (F.col("n") == F.col("n2")) & (F.abs(F.col("score") - F.col("score2")) < 1e-9) & (F.col("p") == F.col("p2"))
    return before.join(after, KEY, "left").agg(
        F.sum("n").alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing")
    )


@query("random_split_facts", "SELECT count(*) AS n, 0::BIGINT AS on_both_sides FROM orders")
def random_split_facts(spark, sf):
    train, test = split.random_split(table(spark, sf, "orders").select("o_orderkey"))
    sides = train.withColumn("test", F.lit(0)).unionAll(test.withColumn("test", F.lit(1)))
    keys = sides.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("test").alias("sides"))
    return keys.agg(F.sum("n").alias("n"), F.count_if(F.col("sides") > 1).alias("on_both_sides"))


@query("label_renamed", "SELECT doc_id, CAST(quality AS DOUBLE) AS label FROM labels")
def label_renamed(spark, sf):
    from tablecraft.operators.features import with_label

    return with_label(table(spark, sf, "labels").select("doc_id", "quality"), "quality")


@query("positive_score_of_vectors", "WITH " + LINES + """
SELECT l_orderkey, l_linenumber, round(score, 4) + 0.0 AS second FROM lines""")
def positive_score_of_vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    pairs = lines(spark, sf).withColumn("pair", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    scored = evaluate.positive_score(pairs, "pair", "second").select(*KEY, "second")
    return rounded(scored, ["second"])


@query("document_quality")
def document_quality(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rows = documents.join(labels, "doc_id")
    found = training.run(
        rows, ["n_chars"], ["lang", "source"], "quality", "logistic", key="doc_id", encoding="onehot"
    )
    return rounded(found.metrics, ["value"])
