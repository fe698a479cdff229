import re
from collections import Counter

import edges
from tablecraft.llm import quality, queries

SF_DIR = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(inside), failed,
    )


def test_numbers(spark):
    docs = edges.documents(spark)
    got = quality.statistics(docs)
    assert got.columns[-1] == "kept"
    want = edges.in_order((i, *brute(t)) for i, t in edges.texts_of(docs))
    assert edges.in_order(tuple(r)[:-1] for r in got.collect()) == want


def test_kept_never_if_base_failed(spark):
    assert quality.statistics(edges.documents(spark)).where("base_failed AND kept").count() == 0


def test_cascade_agrees_with_statistics_in_any_order(spark):
    docs = edges.documents(spark)
    kept = edges.in_order([r[0]] for r in quality.statistics(docs).where("kept").collect())
    assert edges.in_order([r["doc_id"]] for r in quality.cascade(docs).collect()) == kept
    turned = docs.where(quality.verdict(quality.RULES[::-1], docs["text"], quality.words(docs["text"])))
    assert edges.in_order([r["doc_id"]] for r in turned.collect()) == kept
    assert quality.cascade(docs).columns == docs.columns


def test_order_is_by_rejection_per_cost(spark):
    measured = quality.measured(edges.documents(spark))
    assert {m[0].name for m in measured} == {r.name for r in quality.RULES}
    assert all(cost > 0 and 0 <= share <= 1 for _, cost, share in measured)


def test_empty(spark):
    assert quality.statistics(edges.empty(spark)).count() == 0
    assert quality.cascade(edges.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op10_quality_cascade"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sample_is_drawn_in_all_tasks(spark):
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    task = F.udf(lambda i: str(TaskContext.get().partitionId()), "string")
    docs = spark.range(0, 400, 1, 4).select(task("id").alias("text"))
    rules = [quality.Rule(k, lambda t, w, k=k: t == k) for k in "0123"]
    assert [share for _, _, share in quality.measured(docs, rules)] == [0.25] * 4
