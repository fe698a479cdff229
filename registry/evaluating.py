"""Evaluation of a scored table that needs no model."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import LINES, lines, rounded
from tablecraft.operators import curves, evaluate


def _scored(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "label", "prediction", "score")


@query("positive_score", "WITH " + LINES + "SELECT l_orderkey, l_linenumber, score FROM lines")
def positive_score(spark, sf):
    scored = _scored(spark, sf)
    pair = F.array(1 - F.col("score"), F.col("score"))
    found = evaluate.positive_score(scored.withColumn("probability", pair).drop("score"), "probability")
    return found.select("l_orderkey", "l_linenumber", "score")


@query("confusion", "WITH " + LINES + """
SELECT label, prediction, count(*) AS count FROM lines GROUP BY label, prediction""")
def confusion(spark, sf):
    return evaluate.confusion(_scored(spark, sf))


@query("confusion_wide", "WITH " + LINES + """
SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
FROM lines GROUP BY label""")
def confusion_wide(spark, sf):
    return evaluate.confusion_wide(_scored(spark, sf))


def classes(prediction: str = "prediction", name: str = "per_class") -> str:
    return f"""
{name}_counts AS (
  SELECT k AS class, count(*) FILTER (label = k) AS support,
         count(*) FILTER ({prediction} = k) AS predicted,
         count(*) FILTER (label = k AND {prediction} = k) AS true_positive
  FROM lines, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS k) GROUP BY k),
{name}_rates AS (
  SELECT *, coalesce(true_positive / nullif(predicted, 0), 0) AS precision,
         coalesce(true_positive / nullif(support, 0), 0) AS recall FROM {name}_counts),
{name} AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
  FROM {name}_rates)"""


def metric_rows(name: str = "per_class") -> str:
    weighted = "round(sum({c} * support) / sum(support), 4)"
    return f"""
SELECT 'accuracy' AS metric, round(sum(true_positive) / sum(support), 4) AS value FROM {name}
UNION ALL SELECT 'f1', {weighted.format(c="f1")} FROM {name}
UNION ALL SELECT 'weighted_precision', {weighted.format(c="precision")} FROM {name}
UNION ALL SELECT 'weighted_recall', {weighted.format(c="recall")} FROM {name}
UNION ALL SELECT 'precision', round(max(precision) FILTER (class = 1), 4) FROM {name}
UNION ALL SELECT 'recall', round(max(recall) FILTER (class = 1), 4) FROM {name}"""


@query("metrics", "WITH " + LINES + "," + classes() + metric_rows())
def metrics(spark, sf):
    return rounded(evaluate.metrics(_scored(spark, sf)), ["value"])


@query("per_class_metrics", "WITH " + LINES + "," + classes() + """
SELECT class, support, predicted, true_positive, round(precision, 4) AS precision,
       round(recall, 4) AS recall, round(f1, 4) AS f1 FROM per_class""")
def per_class_metrics(spark, sf):
    return rounded(evaluate.per_class_metrics(_scored(spark, sf)), ["precision", "recall", "f1"])


def steps(score: str = "score", name: str = "steps") -> str:
    return f"""
{name} AS (
  SELECT threshold, tp, fp, sum(tp) OVER down AS ctp, sum(fp) OVER down AS cfp,
         sum(tp) OVER () AS p, sum(fp) OVER () AS n
  FROM (SELECT {score} AS threshold, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp
        FROM lines GROUP BY 1)
  WINDOW down AS (ORDER BY threshold DESC))"""


@query("roc_curve", "WITH " + LINES + "," + steps() + """
SELECT threshold, round(cfp / n, 4) AS fpr, round(ctp / p, 4) AS tpr FROM steps
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_curve(spark, sf):
    return rounded(curves.roc(_scored(spark, sf)), ["fpr", "tpr"])


@query("roc_curve_corners", "WITH " + LINES + "," + steps() + """
SELECT threshold, round(cfp / n, 4) AS fpr, round(ctp / p, 4) AS tpr
FROM (SELECT *, lead(tp) OVER (ORDER BY threshold DESC) AS next_tp,
             lead(fp) OVER (ORDER BY threshold DESC) AS next_fp FROM steps)
WHERE next_tp IS NULL OR next_tp <> tp OR next_fp <> fp
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_curve_corners(spark, sf):
    return rounded(curves.roc(_scored(spark, sf), drop_collinear=True), ["fpr", "tpr"])


@query("roc_curve_fine", "WITH " + LINES + "," + steps("l_extendedprice / l_quantity") + """
SELECT threshold, round(cfp / n, 4) AS fpr, round(ctp / p, 4) AS tpr FROM steps
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_curve_fine(spark, sf):
    scored = lines(spark, sf).withColumn("score", F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(curves.roc(scored.select("label", "score")), ["fpr", "tpr"])


@query("pr_curve", "WITH " + LINES + "," + steps() + """
SELECT threshold, round(ctp / p, 4) AS recall, round(ctp / (ctp + cfp), 4) AS precision FROM steps""")
def pr_curve(spark, sf):
    return rounded(curves.pr(_scored(spark, sf)), ["recall", "precision"])


AREA = "round(sum(fp * (ctp - tp / 2.0::DOUBLE)) / (any_value(p) * any_value(n)), 6)"


@query("auc", "WITH " + LINES + "," + steps() + f"SELECT {AREA} AS auc FROM steps")
def auc(spark, sf):
    return rounded(curves.auc(_scored(spark, sf)), ["auc"], 6)


EDGES = [k / 20 for k in range(1, 30)]
BINNED = """,
bins AS (
  SELECT min(score) AS threshold, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label <> 1) AS fp
  FROM lines GROUP BY """ + " + ".join(f"CAST(score >= {e} AS INTEGER)" for e in EDGES) + """),
down AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n
  FROM bins WINDOW w AS (ORDER BY threshold DESC))
"""


@query("roc_binned", "WITH " + LINES + BINNED + """
SELECT threshold, round(cfp / n, 4) AS fpr, round(ctp / p, 4) AS tpr FROM down
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_binned(spark, sf):
    return rounded(curves.binned(_scored(spark, sf), edges=EDGES).roc, ["fpr", "tpr"])


@query("pr_binned", "WITH " + LINES + BINNED + """
SELECT threshold, round(ctp / p, 4) AS recall, round(ctp / (ctp + cfp), 4) AS precision FROM down""")
def pr_binned(spark, sf):
    return rounded(curves.binned(_scored(spark, sf), edges=EDGES).pr, ["recall", "precision"])


@query("auc_binned", "WITH " + LINES + BINNED + """
SELECT round(sum(fp * (ctp - tp / 2)) / (any_value(p)::DOUBLE * any_value(n)), 6) AS auc,
       round(sum(fp * tp / 2) / (any_value(p)::DOUBLE * any_value(n)), 6) AS error FROM down""")
def auc_binned(spark, sf):
    return rounded(curves.binned(_scored(spark, sf), edges=EDGES).auc, ["auc", "error"], 6)


@query("binned_curves_hold", "SELECT true AS few, 0::BIGINT AS off_curve, true AS within, true AS small")
def binned_curves_hold(spark, sf):
    """With ranges of its own choice: points on the exact curve, the exact area within the error."""
    scored = lines(spark, sf).withColumn("score", F.col("l_extendedprice") / F.col("l_quantity"))
    found = curves.binned(scored, bins=100)
    exact = curves.roc(scored).withColumnsRenamed({"fpr": "f", "tpr": "t"})
    points = found.roc.join(exact, "threshold", "left")
    off = (F.abs(F.col("fpr") - F.col("f")) < 1e-12) & (F.abs(F.col("tpr") - F.col("t")) < 1e-12)
    facts = points.agg(
        (F.count(F.lit(1)) <= 101).alias("few"), F.count_if(~F.coalesce(off, F.lit(False))).alias("off_curve")
    )
    area, bound = found.auc.first()
    apart = abs(curves.auc(scored).first()["auc"] - area)
    return facts.select("*", F.lit(apart <= bound).alias("within"), F.lit(bound < 0.01).alias("small"))


@query("metric_report", "WITH " + LINES + "," + classes() + "," + steps() + metric_rows() + f"""
UNION ALL SELECT 'auc', round({AREA}, 4) FROM steps""")
def metric_report(spark, sf):
    return rounded(evaluate.report(_scored(spark, sf)), ["value"])


def _named(model: str, rows: str) -> str:
    return f"SELECT '{model}' AS model, metric, value FROM ({rows})"


@query("compare_models", "WITH " + LINES + "," + classes() + "," + steps() + ","
       + classes("CAST(l_discount > 0.05 AS DOUBLE)", "other_class") + ","
       + steps("l_discount", "other_steps")
       + _named("both", metric_rows() + f" UNION ALL SELECT 'auc', round({AREA}, 4) FROM steps")
       + " UNION ALL "
       + _named("discount", metric_rows("other_class")
                + f" UNION ALL SELECT 'auc', round({AREA}, 4) FROM other_steps"))
def compare_models(spark, sf):
    base = lines(spark, sf)
    other = base.select(
        "label",
        (F.col("l_discount") > 0.05).cast("double").alias("prediction"),
        F.col("l_discount").alias("score"),
    )
    both = base.select("label", "prediction", "score")
    return rounded(evaluate.compare({"both": both, "discount": other}), ["value"])
