import re
from collections import Counter

import corpus_pipeline
from test_lines import brute as brute_lines
from test_minhash import brute as brute_classes
from test_quality import brute_counts

from tidemark.llm.mixing import targets

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = quality(spark, docs, SF).cache()
    assert kept.columns == columns
    ids = {r["doc_id"] for r in rows(kept)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows(docs):
        if brute_counts(r["text"])[-1]:
            assert r["doc_id"] not in ids
        elif labels.get(r["doc_id"]) == 1:
            assert r["doc_id"] in ids

    cut = lines(spark, kept, SF).cache()
    assert cut.columns == columns
    want = {i: t for i, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in rows(kept)])}
    assert {r["doc_id"]: r["text"] for r in rows(cut)} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows(cut))

    single = near(spark, cut, SF).cache()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows(cut)])
    assert {r["doc_id"] for r in rows(single)} == {c for _, c in classes}

    mixed = mix(spark, single, SF).cache()
    assert mixed.columns == columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, got = Counter(), Counter()
    for r in rows(single):
        sizes[r["source"]] += size(r["text"])
    for r in rows(mixed):
        got[r["source"]] += size(r["text"])
    want = targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
    largest = max(size(r["text"]) for r in rows(single))
    assert all(abs(got[s] - want[s]) <= largest / 2 + 1 for s in sizes)
    assert max(Counter(r["doc_id"] for r in rows(mixed)).values()) <= 2

    pieces = rows(pack(spark, mixed, SF))
    times = Counter(r["doc_id"] for r in rows(mixed))
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert set(tokens) == set(times)
    covered = Counter()
    for p in pieces:
        covered[p["doc_id"]] += p["length"]
    assert all(covered[i] == times[i] * tokens[i] for i in times)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[:3] == ["doc_id", "start", "length"]


def test_stages_with_nulls_repeats_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    schema = docs.schema
    text = "Plain words stand here and there in this line of text. " * 3
    odd = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, None, None, None, None), (5, "", "en", None, 0), (7, text + "one", "en", "s", 1), (7, "Another text that shares no line with any of the others stands here, and it is long enough to be kept by the rules.", "en", "s", 1)]
    odd += [(7, text + "one", "en", "s", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    some = spark.createDataFrame([tuple(dict(zip(names, r))[f.name] for f in schema) for r in odd], schema)
    sizes = {"near dedup": 6, "line dedup": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, some, SF).collect()
        if name in sizes:
            assert len(out) == sizes[name], name
        if name == "near dedup":
            assert len([r for r in out if r.doc_id == 7]) == 2
        if name == "mixing":
            count = Counter((r.doc_id, r.text) for r in out)
            assert all(n <= 2 * odd.count(next(o for o in odd if o[:2] == k)) for k, n in count.items()) and all(r.text for r in out)
        assert stage(spark, some.limit(0), SF).count() == 0
