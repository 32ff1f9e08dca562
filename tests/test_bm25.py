"""BM25 that counts terms where texts are, against the join of terms, and tokens of one text against the column's."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import retrieval as R

ODD = [None, "", "The a of", "C++ h<sub>2</sub>o <b>bold</b> x-ray/y", "知识点 of 的 KK İx Été ﬁ", "<a\nb>tag</a> a<b", "\x00nul a1+\n\tnew"]


def test_tokens_of_one_text_are_those_of_the_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string").withColumn("t", T.tokens(F.col("text")))
    assert {r.i: r.t for r in df.collect()} == {i: T.token_list(t) for i, t in enumerate(ODD)}


def drawn(spark, n=120):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["the", "知", "<b>x</b>"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, text(rng.randint(0, 30))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(40)] + [(1000, None), (1001, "")]  # equal scores go by key
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, text(8)) for i in range(7)] + [(90, "the"), (91, "nowhere"), (92, None)], "query_id long, text string")


@pytest.mark.parametrize("limits", [{"max_terms": 3}, {"max_weights": 5}])
def test_counted_where_texts_are_as_joined(spark, limits, monkeypatch):
    docs, queries = drawn(spark)
    want = {tuple(r) for r in R.bm25(docs, queries, 6, **limits).select("query_id", "doc_id", "score", "rank").collect()}
    monkeypatch.setattr(R, "PRODUCTS", 50)  # several blocks of documents in a batch
    got = {tuple(r) for r in R.bm25(docs, queries, 6).select("query_id", "doc_id", "score", "rank").collect()}
    assert got == want and len(got) == 7 * 6


def test_texts_and_postings_are_not_shuffled(spark):
    docs, queries = drawn(spark)
    plan = R.bm25(docs, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange", plan)) == 1  # only the best of each batch are ranked
