import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import B, K1, Index, deal, pack_documents, pack_shard, ranked

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n int, key string, shard string"


def plain_scores(texts, idf, mean, seed):
    counts = lambda t, x: int((x == t).sum())
    return [sum(idf[t] * counts(t, x) * (K1 + 1) / (counts(t, x) + K1 * (1 - B + B * max(1, len(x)) / mean)) for t in set(texts[seed].tolist()) if counts(t, x)) for x in texts]


def some_texts(r, n=50, terms=30):
    texts = [np.array([min(terms - 1, int(r.expovariate(0.15))) for _ in range(r.randint(1, 60))]) for _ in range(n)]
    df = np.array([sum(t in x for x in texts) for t in range(terms)])
    return texts, np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def test_scores_against_plain_bm25():
    texts, idf = some_texts(random.Random(1))
    mean = sum(map(len, texts)) / 50
    index = Index(texts, idf, mean)
    for seed in range(50):
        assert np.allclose(index.scores(seed), plain_scores(texts, idf, mean, seed), rtol=1e-4)


def test_ranking_is_whole():
    r = np.random.default_rng(4)
    scores, unused = r.integers(0, 300, 2000).astype(np.float32), r.random(2000) < 0.8
    got = [i for block in ranked(scores, unused) for i in block]
    assert got == sorted((i for i in range(2000) if unused[i] and scores[i] > 0), key=lambda i: (-scores[i], i))


def test_greedy_packing_against_plain_packer():
    """Each window: the longest unused text, then at every step the unused text whose plain BM25 score is highest."""
    texts, idf = some_texts(random.Random(9), 80)
    window = 128
    mean = sum(map(len, texts)) / 80
    left = {i: len(t) for i, t in enumerate(texts)}
    windows = {}
    for i, s, n, q, o in pack_shard(texts, idf, window, mean):
        windows.setdefault(q, []).append((o, i, s, n))
    for q in sorted(windows):
        pieces = sorted(windows[q])
        seed = pieces[0][1]
        assert left[seed] == max(left.values()) or pieces[0][3] == left[seed]
        scores = plain_scores(texts, idf, mean, seed)
        for k, (o, i, s, n) in enumerate(pieces):
            assert s == len(texts[i]) - left[i]
            if k:
                assert scores[i] >= max(scores[j] for j, x in left.items() if x) - 1e-4
            assert n == min(left[i], window - o)
            left[i] -= n
    assert not any(left.values())


def test_shard_is_whole_and_full():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 100, n) for n in (1, 0, 5, 64, 65, 200, 17, 3, 63, 40)]
    pieces = pack_shard(texts, np.ones(100, np.float32), 64)
    cover = {}
    for i, s, n, q, o in pieces:
        assert n > 0
        for k in range(n):
            assert cover.setdefault((i, s + k), (q, o + k)) == (q, o + k)
    assert set(cover) == {(i, k) for i, t in enumerate(texts) for k in range(len(t))}
    assert len(set(cover.values())) == len(cover)
    sizes = {}
    for q, o in cover.values():
        sizes.setdefault(q, set()).add(o)
    assert all(v == set(range(len(v))) for v in sizes.values())
    assert sorted(map(len, sizes.values()))[1:] == [64] * (len(sizes) - 1)


def test_neighbours_share_a_window():
    texts = [np.full(20, t) for t in (1, 2, 3, 1, 2, 3, 1, 2, 3)]
    by = {}
    for i, _, _, q, _ in pack_shard(texts, np.ones(5, np.float32), 60):
        by.setdefault(q, set()).add(int(texts[i][0]))
    assert all(len(v) == 1 for v in by.values())


def test_shards_are_dealt_by_size():
    dealt, n = deal({0: 50, 1: 60, 3: 1000, 4: 10, 7: 100}, 100)
    assert dealt == [(0, 0, 1), (1, 0, 1), (3, 1, 9), (4, 10, 1), (7, 10, 1)] and n == 11
    assert deal({}, 100) == ([], 0)


def test_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "été", "#", "gamma"]) for _ in range(r.randint(0, 300)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "no id"), (17, "again"), (17, "again"), (902, "long text " * 9000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "s", 1, "t", "u") for x in rows], SCHEMA)
    got = pack_documents(df, WORD, shard_ids=10_000).collect()
    lib = Tokenizer.from_file(WORD)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
        assert any(len(x) == g.doc_tokens and zlib.crc32(x[g.start : g.start + g.length].tobytes()) == g.ids_crc32 for x in want[g.doc_id])
    assert sum(g.length for g in got) == sum(len(x) for v in want.values() for x in v)
    for v in sequences.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    for i, v in want.items():
        if len(v) == 1:
            at = 0
            for g in sorted((g for g in got if g.doc_id == i), key=lambda g: g.start):
                assert g.start == at
                at += g.length
            assert at == len(v[0])


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_equal_rows_are_dealt_over_shards(spark):
    """A group of equal rows without an id, larger than several shards, is no single task's work."""
    df = spark.createDataFrame([(None, "the same words stand in every row " * 3, "s", 1, "t", "u")] * 3000, SCHEMA)
    got = pack_documents(df, WORD, shard_ids=10_000)
    shards = got.groupBy(F.shiftright("sequence_id", 32).alias("shard")).agg(F.sum("length").alias("n")).collect()
    assert len(shards) > 3 and max(r.n for r in shards) < 20_000


def test_neighbours_meet_in_shards(spark):
    """Topics of near neighbours over many shards: of a seed's best ten texts by plain BM25 nearly all share its shard."""
    r = random.Random(7)
    words = [a + b + c for a in "bdfgklmnpr" for b in ("ar", "en", "il", "os") for c in "bdfgklmnpr"]
    rows = []
    for g in range(60):
        own = r.sample(words, 12)
        rows += [(g * 100 + k, " ".join(r.choice(own) for _ in range(120))) for k in range(20)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "s", 1, "t", "u") for x in rows], SCHEMA)
    got = pack_documents(df, WORD, window=1024, shard_ids=12_000).collect()
    windows, shard = {}, {}
    for g in got:
        windows.setdefault(g.sequence_id, []).append((g.doc_id // 100, g.length))
        shard[g.doc_id] = g.sequence_id >> 32
    assert len(set(shard.values())) > 8
    lib = Tokenizer.from_file(WORD)
    ids = [np.array(lib.encode(t, add_special_tokens=False).ids) for _, t in rows]
    df = np.zeros(lib.get_vocab_size())
    for x in ids:
        df[np.unique(x)] += 1
    index = Index(ids, np.log1p((len(ids) - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(x) for x in ids])))
    found = total = 0
    for seed in range(0, len(rows), 10):
        scores = index.scores(seed)
        scores[seed] = 0
        best = np.argsort(-scores, kind="stable")[:10]
        found += sum(shard[rows[i][0]] == shard[rows[seed][0]] for i in best)
        total += 10
    assert found / total >= 0.9
    best = sum(max(sum(n for h, n in v if h == g) for g in {h for h, _ in v}) for v in windows.values())
    assert best / sum(g.length for g in got) > 0.6


def test_all_terms_are_asked_for():
    """The only neighbour shares just one of the seed's many terms, its lightest, and is shorter than a stranger."""
    texts = [np.arange(40), np.array([39] * 20), np.array([50] * 30)]
    got = pack_shard(texts, np.linspace(2, 1, 60).astype(np.float32), 60)
    assert {i for i, _, _, q, _ in got if q == 0} == {0, 1}
