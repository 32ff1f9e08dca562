"""What a task gets stays the same at every size: plans are dealt by rows, or aggregated before they grow."""

from tidemark.operators import graph as G
from tidemark.plans import learner as PL


def edges(spark, n=200):
    rows = [(f"n{i}", f"n{j}", "p", (i * j % 7) / 7) for i in range(n // 5) for j in range(i + 1, i + 6)]
    return spark.createDataFrame(rows, "source string, target string, predicate string, confidence double")


def test_more_rows_more_tasks_same_results(spark, monkeypatch):
    e = edges(spark)
    results = lambda: [sorted(map(tuple, df.collect())) for df in (G.label_propagation(e, 2), G.best_neighbour(e), G.modularity(e, G.label_propagation(e, 1)).selectExpr("round(modularity, 9)"))]
    want = results()
    real = G.in_parts
    monkeypatch.setattr(G, "in_parts", lambda rows, *frames: real(rows, *frames, each=20))
    assert results() == want
    assert G.in_parts(200, (e, ["source"]))[0].rdd.getNumPartitions() == 10 and real(200, (e, ["source"]))[0].rdd.getNumPartitions() == 4


def test_items_are_cut_before_they_are_copied(spark):
    plan = PL.next_item(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # printed from the end: the first aggregate lies below
