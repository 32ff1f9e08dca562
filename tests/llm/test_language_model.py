import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import context_mix as cm
from tidemark.llm.language_model import score_texts

SF = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, score int, held int"


def scored(df, **k):
    return score_texts(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, **k)


def base(rows):
    """Contract columns by plain Python."""
    cut = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k in cut if not held[k] for w in cut[k])
    n, v = sum(c.values()), len(c)
    return [(rows[k][0], held[k], len(cut[k]), sum(c[w] > 0 for w in cut[k]), n, sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in cut[k])) for k in cut]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_base_columns(spark):
    df = spark.read.parquet(SF)
    rows = [tuple(r) for r in scored(df).collect()]
    same([r[:6] for r in rows], base([(r.doc_id, r.text) for r in df.collect()]))


def test_learns(spark):
    """Held-out texts cost less than under the plain counts, and much less than eight bits a byte."""
    held = scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert 0 > held[0] > 0.95 * held[1]
    assert held[2] < 5


def test_edges(spark):
    rows = [(1, "A a b \x1c\x85 c\n\n"), (1, "A a b"), (2, None), (3, ""), (None, "a"), (4, "w" * 300_000 + " a"), (5, "a " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA)
    for size in (1, 1 << 20):
        got = [tuple(r) for r in scored(df, chunk=size).collect()]
        same([r[:6] for r in got], base(rows))
        assert all(math.isfinite(r[6]) and r[6] <= 0 and r[7] >= 0 for r in got)
    assert scored(df.limit(0)).count() == 0
    nothing = score_texts(df, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in nothing} == {(0, 0, 0.0)}


def plain_bits(seen, weights, refined, symbols):
    """Bits of (kind, node, bit, contexts) by a dictionary of counts: the model without tables, batches or packing."""
    out = 0.0
    for kind, name, bit, contexts in symbols:
        n = [seen[t, c, name] for t, c in enumerate(contexts)]
        logits = [math.log((b + cm.DELTA) / (a + cm.DELTA)) for a, b in n]
        level = [(a + b > 0) + (a + b > 2) + (a + b > 15) for a, b in n[1:]]
        dot = sum(w * x for w, x in zip(weights[kind * 16 + level[1] * 4 + level[0]], logits, strict=True))
        step = int(np.clip(dot * 2 + cm.STEPS // 2 + 0.5, 0, cm.STEPS - 1))
        p = (1 / (1 + math.exp(-dot)) + refined[(kind * 4 + level[1]) * cm.STEPS + step]) / 2
        out -= math.log2(p if bit else 1 - p)
    return out


def test_tables_against_dictionaries():
    """On a small text no slots clash, so tables and plain dictionaries give the same bits."""
    words = [b"", b"the", b"cat", b"sat", b"qq", b"zebra"]
    ranks = np.array([1, 0, 2, 3, -1, -1])
    spelled = b"qq zebra "
    hashes = np.array([zlib.crc32(w) * 2654435761 + 1 for w in words], np.int64)
    code = cm.huffman({0: 9, 1: 7, 2: 2, cm.ESCAPE: 2})
    ids = np.array([1, 2, 3, 1, 4, 0, 1, 2, 5, 0, 1, 2, 3, 0], "<i4")
    tokens = cm.Tokens(ids, ranks, hashes, spelled, 0, code)
    learner = cm.Learner()
    for _ in range(5):
        learner.learn(tokens, np.arange(len(ids)))
    scorer = cm.Scorer(np.stack([cm.packed(t.astype(np.int64)) for t in learner.counts]), learner.cells())
    got = sum(scorer.bits(tokens)).sum()

    symbols, one, two = [], 0, 0
    for t in ids.tolist():
        r, ctx = int(ranks[t]) + 1, (None, ("w", one), ("w", one, two))
        k = r.bit_length() - 1 if r else cm.ESCAPE
        symbols += [(cm.LENGTH, n, b, ctx) for n, b in zip(*code[k], strict=True)]
        symbols += [(cm.REST, (k, r >> j), r >> (j - 1) & 1, ctx) for j in range(k, 0, -1)] if r else []  # SHALLOW is more
        if not r:
            a = b = 32
            for c in words[t] + b" ":
                full = c | 256
                symbols += [(cm.SPELLING, full >> j, full >> (j - 1) & 1, (None, ("l", a), ("l", a, b))) for j in range(8, 0, -1)]
                a, b = c, a
        two, one = (0, 0) if t == 0 else (one, t)
    seen = defaultdict(lambda: [0, 0])
    for kind, name, bit, contexts in symbols:
        for o, c in enumerate(contexts):
            seen[o, c, (kind, name)][bit] += 5
    want = plain_bits(seen, scorer.weights.tolist(), scorer.refined.tolist(), [(k, (k, name), b, c) for k, name, b, c in symbols])
    assert abs(got - want) < 0.02 * want


def test_codes_are_complete():
    code = cm.huffman({0: 5, 1: 1, 2: 1, 7: 9, cm.ESCAPE: 1})
    assert sum(2.0 ** -len(bits) for _, bits in code.values()) == 1
    assert cm.huffman({cm.ESCAPE: 1}) == {cm.ESCAPE: ([], [])}


def test_probabilities_add_up_to_one():
    """Over all ranks of a length and the other lengths' codes, whatever was learned."""
    ranks, code = np.array([0, 1, 2, 3, 4, 5, 6, -1]), cm.huffman({0: 3, 1: 3, 2: 2, cm.ESCAPE: 1})
    learner = cm.Learner()
    hashes = np.arange(1, 9) * 7919
    learner.learn(cm.Tokens(np.array([0, 3, 1, 5, 0, 7, 3, 3, 0, 1] * 5, "<i4"), ranks, hashes, b"x ", 0, code), np.arange(50))
    scorer = cm.Scorer(np.stack([cm.packed(t.astype(np.int64)) for t in learner.counts]), learner.cells())
    total = 0.0
    for w in range(8):
        path, _ = scorer.bits(cm.Tokens(np.array([3, 1, w], "<i4"), ranks, hashes, b"x ", 0, code))
        total += 2.0 ** -path[2]
    assert abs(total - 1) < 1e-3
