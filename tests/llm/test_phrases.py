import random
import re
from collections import Counter

import numpy as np

from tidemark.llm.buckets import bitmap, is_set, slice_rows
from tidemark.llm.phrases import mine_phrases, windows

SCHEMA = "doc_id long, text string, lang string, phrase string, a int"


def brute(docs, least, longest=5, top=2000, same_percent=100):
    f, n, out = {}, Counter(), []
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] = f.get((lang, tuple(words[i : i + k])), 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and 100 * b >= same_percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, p, left, right, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], p.decode(), -a, left, right, total, -score))
    return sorted(rows)


def found(df, **k):
    return sorted(tuple(r) for r in mine_phrases(df, **k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(r, n):
    words = ["the", "The", "of", "new", "York", "city", "é", "ß x", "\x1c", "a-b", "(x)", *"abcdefgh"]
    ends = [" ", "\t", "  ", ". ", ",", "\n", "\r\n", "!", "\x0b"]
    docs = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice(ends if r.random() < 0.3 else [" "]) for _ in range(r.randrange(60)))
        docs.append((text + ("new york city of the" if r.random() < 0.4 else ""), r.choice(["en", "en", "de", None])))
    return docs + [(None, "en"), ("", "fr"), (" .\n", None), ("solo", "xx")]


def test_against_every_phrase(spark):
    docs = corpus(random.Random(1), 120)
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(docs)], SCHEMA)
    want = brute(docs, 6)
    assert len(want) > 100
    assert found(df.repartition(3), least=6, bits=20) == want
    assert found(df, least=6, bits=16, top=7) == brute(docs, 6, top=7)


def test_chunks_cut_texts_anywhere(spark):
    """A chunk may end inside a text, or inside a phrase; crowded buckets let more through to the same counts."""
    docs = corpus(random.Random(2), 60)
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(docs)], SCHEMA)
    for size in (7, 50):
        assert found(df, least=5, bits=16, chunk=size, same_percent=90) == brute(docs, 5, same_percent=90)


def test_long_texts_and_repeats(spark, monkeypatch):
    import tidemark.llm.phrases as phrases

    text = " ".join(["x y z"] * 3000) + " " + "w" * 100_000
    df = spark.createDataFrame([(1, text, "en", "", 0)] * 3, SCHEMA)
    assert found(df, least=100, bits=16) == brute([(text, "en")] * 3, 100)
    data, out = (text * 3).encode(), []
    for words in phrases._strips(data):
        out += words
    assert out == data.split()


def test_empty(spark):
    assert mine_phrases(spark.createDataFrame([], SCHEMA), bits=16).count() == 0


def test_windows_stop_at_breaks():
    assert windows(np.array([1, 2, 3, 0, 4, 0, 0, 5, 6]), 2).tolist() == [2, 2, 1, 0, 1, 0, 0, 2, 1]


def test_bitmap_is_of_sums(spark):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 18, 4000) ** 2 % (1 << 18) for _ in range(5)]
    rows = [tuple(x) for p in parts for x in zip(*(c.to_pylist() for c in slice_rows(p, 3).columns), strict=True)]
    got = bitmap(spark.createDataFrame(rows, "slice int, offsets binary, counts binary"), 18, 3)
    want = np.bincount(np.concatenate(parts), minlength=1 << 18) >= 3
    assert (is_set(got, np.arange(1 << 18)) == want).all()
