"""Small fixtures for what the generated tables don't hold: CJK, nulls, ties, cycles."""

import hashlib
import math
import random
import re

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import governance as V
from tidemark.operators import graph as G
from tidemark.operators import inference as I
from tidemark.operators import learner as L
from tidemark.operators import predicates as P
from tidemark.operators import retrieval as R
from tidemark.operators import stats as S
from tidemark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_two_valued_predicates(spark):
    df = spark.createDataFrame([("abc",), (None,), ("7",)], "v string")
    got = lambda op, x: [tuple(r) for r in df.select(P.condition(F.col("v"), op, x), P.condition(F.col("v"), op, x, True)).collect()]
    assert got("gt", 3) == [(False, True), (False, True), (True, False)]
    assert got("contains", "b") == [(True, False), (False, True), (False, True)]
    assert got("ne", "7") == [(True, False), (True, False), (False, True)]
    with pytest.raises(ValueError):
        P.condition(F.col("v"), "like", 1)


def test_tokens(spark):
    text = "The Dy<sup>3+</sup> ion, F9/2 镝的光谱 and <b>x-ray</b> of"
    assert one(spark, T.tokens(F.lit(text))) == ["dy3+", "ion", "f9/2", "x-ray", "镝", "光", "谱"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_chunks_and_sentences(spark):
    assert one(spark, T.fixed_chunks(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, T.fixed_chunks(F.lit("ab"), 4, 1)) == ["ab"]
    assert one(spark, T.fixed_chunks(F.lit(""), 4, 1)) == []
    assert one(spark, T.sentences(F.lit("One. Two?  Three"))) == ["One.", "Two?", "Three"]


def test_cosine_and_jaccard(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, T.cosine(a, b)) == pytest.approx(math.sqrt(0.5))
    assert one(spark, T.cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_bm25_repeated_terms_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "ring ring blue"), (2, "blue"), (3, ""), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "ring ring"), (8, "the")], "query_id long, text string")
    got = R.bm25(docs, q, 5).collect()
    idf = math.log((2 - 1 + 0.5) / 1.5 + 1)
    assert [(r.query_id, r.doc_id) for r in got] == [(9, 1)]
    assert got[0].score == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), abs=1e-5)


def test_mmr_prefers_variety(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, key long, score double, vector array<double>")
    assert [r.key for r in R.mmr(hits, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def test_graph_cycles_and_missing_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "source string, target string")
    assert {(r.source, r.target) for r in G.closure(e).collect()} >= {("a", "a"), ("a", "c"), ("d", "e")}
    assert G.shortest_path(e, "a", "e", 5).count() == 0
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert {r.node: r.layer for r in G.layers(e, nodes).collect()} == {"d": 0, "e": 1, "f": 0}
    assert {r.node: r.component for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    rank = {r.node: r.rank for r in G.page_rank(nodes, e.withColumn("weight", F.lit(1.0)), 60).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] == pytest.approx(rank["b"], abs=1e-4)


def test_bkt_and_ability(spark):
    p = 0.5
    for c in (True, False, True):
        p = jobs.bkt_update(p, c)
    a = spark.createDataFrame([(1, "k", i, i, c) for i, c in enumerate((True, False, True))], "learner long, kp string, ts long, event_id long, correct boolean")
    assert L.knowledge_tracing(a).first().mastery == pytest.approx(p)
    th, se = 0.0, 1.0
    r = random.Random(1)
    rows = [(7, i, i, r.random() < 0.8, 1.0, r.uniform(-1, 1), 0.1) for i in range(20)]
    for _, _, _, c, x, y, z in rows:
        grid = [-3 + 0.1 * k for k in range(61)]
        w = [math.exp(-0.5 * ((t - th) / se) ** 2) * (q if c else 1 - q) for t in grid for q in [z + (1 - z) / (1 + math.exp(-x * (t - y)))]]
        th2 = sum(t * v for t, v in zip(grid, w)) / sum(w)
        se = math.sqrt(sum((t - th2) ** 2 * v for t, v in zip(grid, w)) / sum(w))
        th = th2
    got = L.ability(spark.createDataFrame(rows, "learner long, ts long, event_id long, correct boolean, a double, b double, c double")).first()
    assert (got.theta, got.se, got.n) == (pytest.approx(th, abs=1e-6), pytest.approx(se, abs=1e-6), 20)


def test_late_answers_are_rejected(spark, tmp_path):
    schema = "learner long, kp string, ts timestamp, event_id long, correct boolean"
    at = lambda h: f"2024-01-01 {h:02}:00:00"
    for n, hours in enumerate(([1, 3], [2, 3, 4])):
        spark.createDataFrame([(1, "k", at(h), 10 * n + h, True) for h in hours], "learner long, kp string, ts string, event_id long, correct boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "b=*"))
        jobs.run_all(jobs.trace(s), str(tmp_path / "w"), "update")
    got = spark.read.schema(f"{jobs.TRACED}, batch int").parquet(str(tmp_path / "w" / "out")).orderBy("batch").collect()
    assert (got[-1].attempts, got[-1].rejected) == (4, 1)


def test_topic_patterns():
    assert P.topic_pattern("a.*.c") == r"^a\.[^.]+\.c$"
    assert P.topic_pattern("a.**") == r"^a\..*$"


def test_translation_reaches_all_entities(spark, monkeypatch):
    rows = [(f"{'cs'[i % 2]}:{i}", "located_in", f"n:{i % 7}") for i in range(60)] + [(f"n:{i}", "part_of", f"r:{i % 2}") for i in range(7)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    e, p = I.translate(t, sample=4)
    got = {r.entity: r.vector for r in e.collect()}
    assert set(got) == {x for s, _, o in rows for x in (s, o)} and e.count() == len(got)
    assert {r.predicate for r in p.collect()} == {"located_in", "part_of"}
    assert all(math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6) for v in got.values())
    query = __spark_entry__.queries()["transe_ranking"]
    monkeypatch.setattr("tidemark.plans.more.triples", lambda spark, sf: t)
    ranked = query(spark, "").groupBy("subject", "predicate").count().collect()
    assert {(r.subject, r.predicate) for r in ranked} == {(s, k) for s, k, _ in rows}
    assert all(r["count"] == 5 for r in ranked)


def test_predicates_take_odd_values(spark):
    from tidemark.operators.predicates import condition

    df = spark.createDataFrame([("a1",), ("(",), (None,), ("7",)], "x string")
    count = lambda *a: df.where(condition(F.col("x"), *a)).count()
    assert count("regex", "(") == 0 and count("regex", "(", True) == 4
    assert count("gt", "many") == 0 and count("gt", None) == 0 and count("gt", "6") == 1
    assert count("in", "7") == 1 and count("in", ["7", "a1"]) == 2


def test_counter_refuses_to_fall(spark):
    from tidemark.operators import stats

    df = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", -1.0)], "k string, v double")
    assert stats.counter(df.where("v > 0"), F.col("k"), "v").first().total == 3.5
    with pytest.raises(Exception, match="can't fall"):
        stats.counter(df, F.col("k"), "v").collect()


def test_store_operators(spark):
    """Ingestion, drift and ancestry on small fixtures, against plain versions."""
    from tidemark.operators import store as S

    new = spark.createDataFrame([(1, "x" * 12), (2, "x" * 12), (3, None), (4, "short"), (5, "known already"), (6, "y" * 12)], "id long, text string")
    got = S.ingest(new, spark.createDataFrame([("known already",), (None,)], "text string"), "text", "id", F.length("text") >= 10)
    assert {r.id: r.status for r in got.collect()} == {1: "success", 2: "skipped", 3: "failed", 4: "failed", 5: "skipped", 6: "success"}
    assert S.ingest(new.limit(0), new.select("text"), "text", "id", F.lit(True)).count() == 0

    wrong = [i % 10 == 0 for i in range(200)] + [i % 2 == 0 for i in range(100)]
    want = [0, 0]
    k, best = 0, None
    for i, w in enumerate(wrong, 1):
        k += w
        p = k / i
        s = (p * (1 - p) / i) ** 0.5
        if i >= 30:
            best = min(best or (9, 9, 9), (p + s, p, s))
            want[0] += p + s > best[1] + 2 * best[2]
            want[1] += p + s > best[1] + 3 * best[2]
    rows = spark.createDataFrame([("l", i, w) for i, w in enumerate(wrong)], "k string, t int, w boolean")
    got = S.ddm(rows, "k", ["t"], F.col("w")).first()
    assert [got.warnings, got.drifts] == want and want[1] > 0

    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "top")], "node string, parent string")
    assert {r.node: r.path for r in S.ancestry(tree, 5).collect()} == {"a": ["b", "c", "top"], "x": ["c", "top"]}


def test_nearest_with_many_equal_vectors(spark):
    """Far more equal vectors than k, in many batches: the smallest keys win."""
    rows = [(i, [1.0, 1e-9 * (i % 7)]) for i in range(3000, 0, -1)] + [(9000, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "key long, vector array<double>").repartition(16)
    got = R.nearest(df, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), 5).orderBy("rank")
    assert [r.key for r in got.collect()] == [1, 2, 3, 4, 5]


def test_order_statistics(spark):
    """Against sorted lists: hot values, small groups, nulls, a sketch too coarse to hold all values."""
    r = random.Random(5)
    groups = {"hot": [r.choice((1.0, 2.0, r.gauss(0, 50))) for _ in range(5000)], "flat": [r.random() for _ in range(3000)], "two": [3.0, 1.0], "one": [4.0], None: [5.0, None, 6.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(7)
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    small = {f"r{i}": (q, lambda n, q=q: F.least(n - 1, F.floor(n * q))) for i, q in enumerate(qs.values())}
    coarse = {x.k: x for x in S.order_statistics(df, "k", "v", small, accuracy=100).collect()}
    got = {x.k: x for x in S.quantiles(df, "k", "v", qs).collect()}
    assert len(got) == len(groups)
    for k, values in groups.items():
        v = sorted(x for x in values if x is not None)
        assert got[k].n == len(v)
        for i, (name, q) in enumerate(qs.items()):
            if not v:
                assert got[k][name] is None and coarse[k][f"r{i}"] is None
                continue
            at = (len(v) - 1) * q
            lo = math.floor(at)
            want = v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)
            assert got[k][name] == pytest.approx(want)
            assert coarse[k][f"r{i}"] == v[min(len(v) - 1, math.floor(len(v) * q))]


def test_folds_over_days_equal_plain_folds(spark):
    """Histories of several days, shuffled, with ties in time; a long one would underflow without its scale."""
    r = random.Random(3)
    rows = [(k, "p", r.randrange(0, 12 * 86400) // 1000 * 1000, i, r.random() < 0.6, r.uniform(0, 9)) for k, n in ((1, 1), (2, 40), (3, 3000)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "learner long, kp string, ts long, event_id long, correct boolean, value double")
    traced = {x.learner: x for x in L.traced(df, ["learner", "kp"]).collect()}
    ema = {x.learner: x.ema for x in L.ema(df, "learner", ["ts", "event_id"], "value", 0.3).collect()}
    chain = {x.learner: x for x in V.audit_chain(df, "learner", ["ts", "event_id"], F.col("event_id").cast("string")).collect()}
    for k in (1, 2, 3):
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[3]))
        p, log, e, head = 0.5, 0.0, own[0][5], hashlib.sha256(b"genesis").hexdigest()
        for x in own:
            right = p * 0.8 + (1 - p) * 0.1
            log += math.log(right if x[4] else 1 - right)
            p = jobs.bkt_update(p, x[4])
            e += 0.3 * (x[5] - e)
            head = hashlib.sha256(f"{head}|{x[3]}".encode()).hexdigest()
        t = traced[k]
        assert (t.attempts, t.correct_count) == (len(own), sum(x[4] for x in own))
        assert (t.mastery, t.log_likelihood, ema[k]) == (pytest.approx(p), pytest.approx(log), pytest.approx(e))
        assert (chain[k].n, chain[k].head) == (len(own), head)
    assert V.audit_chain(df.where("learner = 9"), "learner", ["ts"], F.lit("x")).collect() == []


def test_recall_of_approximate_neighbours(spark):
    """Each query has near copies among many unrelated vectors; nulls and zeros are left out."""
    import numpy as np

    from tidemark.operators import retrieval as R

    g = np.random.default_rng(2)
    base = g.standard_normal((2000, 32))
    near = np.repeat(base[:50], 5, axis=0) + 0.25 * g.standard_normal((250, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 32)], "key long, vector array<double>")
    q = df.where("key < 50").withColumnRenamed("key", "query_id")
    exact = {(r.query_id, r.key) for r in R.nearest(df, q, 6).where("score >= 0.9").collect()}
    got = {(r.query_id, r.key) for r in R.approximate_nearest(df, q, 6).collect()}
    assert len(exact) > 250 and len(exact & got) / len(exact) >= 0.95
    assert not {k for _, k in got} & {9000, 9001}


def test_resolved_entities(spark):
    """Against all pairs and plain merging: identifiers, names, aliases, edits; digits, types, empty and null names."""
    from tidemark.operators import store

    r = random.Random(4)
    stems = ["garnet laser", "ruby", "erbium glass", "ytterbium fibre", "host"]
    rows = []
    for i in range(120):
        name = list(r.choice(stems)) + ([str(r.randrange(3))] if r.random() < 0.5 else [])
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            name[r.randrange(len(name))] = r.choice(["", "x", "er"])
        rows.append((f"e{i:03}", r.choice("xy"), "".join(name).upper() if i % 3 else "  " + "".join(name), r.random()))
    rows += [("z1", "x", None, 1.0), ("z2", "x", "", None), ("z3", "x", "Nd:YAG", 0.5), ("z4", "y", "ndyag", 0.5), ("z5", "y", "Neodymium garnet", 0.9)]
    identifiers = [("e001", "CAS", "12-a"), ("e050", "CAS", "12-A"), ("e051", "other", "12-A"), ("e052", None, "x"), ("e053", "k", None)]
    aliases = [("Nd:YAG", "Neodymium Garnet"), ("ndyag", "neodymium garnet"), ("nobody", "none")]
    squeeze = lambda n: re.sub(r"\s+", "", n.strip().lower())

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                last, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, last + (x != y))
        return d[-1]

    def tied(a, b):
        if not a[2] or not b[2]:
            return False
        m, n = squeeze(a[2]), squeeze(b[2])
        full = lambda x: {squeeze(c) for k, c in aliases if squeeze(k) == x or squeeze(c) == x}
        if m == n or full(m) & full(n):
            return True
        (p, u), (q, v) = ((re.sub("[0-9]", "", x), re.sub("[^0-9]", "", x)) for x in (m, n))
        short = min(len(p), len(q))
        return a[1] == b[1] and u == v and short >= 5 and distance(p, q) <= (1 if short < 12 else 2)

    root = {x[0]: x[0] for x in rows}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and tied(a, b)] + [("e001", "e050"), ("e050", "e001")]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if root[i] < root[j]:
                root[j], changed = root[i], True
    frame = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, confidence double")
    got = store.resolve(frame, spark.createDataFrame(identifiers, "entity_id string, id_type string, id_value string"), spark.createDataFrame(aliases, "alias string, canonical string")).collect()
    assert {x.entity_id: x.cluster for x in got} == root
    for x in got:
        own = [y for y in rows if root[y[0]] == x.cluster]
        assert x.members == len(own)
        assert x.canonical == min(own, key=lambda y: (-(-1 if y[3] is None else y[3]), -(-1 if y[2] is None else len(y[2])), y[0]))[2]
    assert {x.entity_id: x.kinds for x in got if x.entity_id in ("e001", "z1", "z3")}["z3"] == ["alias"]
    assert len({x.cluster for x in got}) > 10


def test_numbered_names_stay_apart(spark):
    from tidemark.operators import store

    rows = [(f"c{i}", "customer", f"Customer#{i:09}") for i in range(500)] + [("d1", "customer", "Custmer#000000007")]
    got = {x.entity_id: x.cluster for x in store.resolve(spark.createDataFrame(rows, "entity_id string, entity_type string, name string")).collect()}
    assert len(set(got.values())) == 500 and got["d1"] == got["c7"]


def test_student_points_have_no_jump(spark):
    from tidemark.plans.aggregate import STUDENT_95, student_95

    want = {30: STUDENT_95[-1], 31: 2.0395, 40: 2.0211, 60: 2.0003, 120: 1.9799, 100_000: 1.96}
    got = spark.createDataFrame([(v,) for v in want], "v long").select("v", student_95(F.col("v")).alias("t")).collect()
    assert all(abs(r.t - want[r.v]) < 5e-4 for r in got)


@pytest.mark.parametrize("name", ["spreading_activation", "multi_hop_propagation"])
def test_scores_multiply_in_the_order_of_the_sql(spark, tmp_path, name):
    import duckdb

    days = [19, 290, 943, 1383, 1468, 1748, 1909, 1942, 2057, 2178]  # a score of this chain is 0.01 or next to it by the order
    r = random.Random(5)
    rows = [(k + 1, 1, d) for k, d in enumerate(days)] + [(100 + k, 2 + k // 10, r.randrange(2400)) for k in range(2000)]
    o = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d int")
    o.select("o_orderkey", "o_custkey", F.expr("date_add(date'1995-01-01', d)").cast("timestamp").alias("o_orderdate")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert sorted(tuple(x) for x in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == want


def test_pairs_of_large_keys_are_dealt(spark):
    a = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    b = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("part"))
    got = G.dealt_pairs(a, b, ["k"], "x", rows=100)
    want = a.join(b, "k")
    assert got.count() == want.count() == 300_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 150_000  # a key's pairs lie in several tasks


def test_policy_conflicts_in_many_tasks(spark, tmp_path):
    rows = [(i, "brand", "ECONOMY" if i % 3 else ("PROMO" if i % 2 else None), i % 2) for i in range(6000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["policy_conflicts"](spark, str(tmp_path))
    allow, deny = [sum(1 for r in rows if r[3] == k and r[2] == "ECONOMY") for k in (0, 1)], [sum(1 for r in rows if r[3] == k and r[2] == "PROMO") for k in (0, 1)]
    assert got.count() == sum(x * y for x, y in zip(allow, deny, strict=True))
    assert got.where("a_id >= b_id").isEmpty() and got.groupBy(F.spark_partition_id()).count().count() > 1


def test_dealt_pairs_copy_rows_some_times_only(spark, monkeypatch):
    """Dealt rows grow in proportion to the sides, not with the square; what they make is counted nowhere else."""
    a = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    b = spark.range(2_000).select(F.lit(1).alias("k"), F.col("id").alias("part"))
    dealt, real = [], type(a).repartition
    monkeypatch.setattr(type(a), "repartition", lambda self, *args: (dealt.append(self), real(self, *args))[1])
    G.dealt_pairs(a, b, ["k"], "x", rows=100)
    assert len(dealt) == 2 and sum(x.count() for x in dealt) < 1_000_000
    small, few = a.where("x < 500"), b.where("part < 90")
    assert G.dealt_pairs(small, few, ["k"], "x", rows=10, held=20).exceptAll(small.join(few, "k")).isEmpty()
    assert G.dealt_pairs(small, few, ["k"], "x", rows=10, held=20).count() == 500 * 90


@pytest.mark.parametrize("odd", [None, float("nan")])
def test_pattern_match_of_odd_lines(spark, tmp_path, odd):
    import shutil

    import duckdb

    import __spark_entry__

    rows = [(p, s, q, d) for p, s, q, d in [(1, 1, 50.0, 0.0), (2, 1, 50.0, 0.05), (2, 1, 2.0, 0.0), (3, 1, 44.0, 0.0), (4, 2, 50.0, odd), (4, 2, 1.0, 0.07), (5, 2, 50.0, odd), (6, 3, odd, 0.0), (None, 3, 46.0, 0.0), (7, None, 46.0, 0.0), (8, 3, None, 0.0), (8, 3, 45.0, 0.1)]]
    for t in ("supplier", "customer", "nation"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    lines = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    lines.withColumn("l_shipdate", F.expr("timestamp'1995-01-01 00:00:00'")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for t in ("supplier", "customer", "nation"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    order = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    want = order(db.execute(__spark_entry__.oracle_sql()["pattern_match"]).fetchall())
    assert want and order(__spark_entry__.queries()["pattern_match"](spark, str(tmp_path)).collect()) == want
