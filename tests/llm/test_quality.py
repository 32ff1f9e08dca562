import itertools
import random
import re

import numpy as np

from tidemark.llm.crf import Chain, fit, gradient, labelled_lines, viterbi
from tidemark.llm.quality import CONTENT_SHARE, fit_chain, judge, line_features, lines_of, quality_rules, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept int, verdict string"
LABELS = "doc_id long, quality int, toxic int"


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_viterbi_against_all_paths():
    r = random.Random(2)
    for n in range(1, 9):
        g = lambda: r.uniform(-2, 2)
        c = Chain((), ((g(), g()), (g(), g())), (g(), g()))
        e = [g() for _ in range(n)]
        score = lambda p: c.starts[p[0]] + sum(x for x, y in zip(e, p) if y) + sum(c.moves[a][b] for a, b in itertools.pairwise(p))
        assert abs(score(viterbi(c, e)) - max(map(score, itertools.product((0, 1), repeat=n)))) < 1e-9
    assert viterbi(c, []) == []


def test_gradient_against_differences():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(5, 6, 3)), r.integers(0, 2, (5, 6)).astype(float)
    mask = np.arange(6) < np.array([6, 1, 3, 6, 2])[:, None]
    parts = [r.normal(size=3), r.normal(size=(2, 2)), r.normal(size=2)]
    grads = gradient(x, y * mask, mask, *parts)[1:]
    for p, g in zip(parts, grads):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = gradient(x, y * mask, mask, *parts)[0]
            p[i] -= 2e-5
            down = gradient(x, y * mask, mask, *parts)[0]
            p[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_fit_learns_runs():
    r = np.random.default_rng(1)
    seqs = []
    for _ in range(60):
        y = np.repeat(r.integers(0, 2, 6), 5).astype(float)
        seqs.append((np.stack([np.ones(30), y + r.normal(size=30)], 1), y))
    c = fit(seqs[:40], 2)
    hits = [np.mean(np.array(viterbi(c, (x @ np.array(c.weights)).tolist())) == y) for x, y in seqs[40:]]
    alone = [np.mean((x[:, 1] > 0.5) == y) for x, y in seqs[40:]]  # the best that a line by itself allows
    assert np.mean(hits) > np.mean(alone) + 0.08


def test_counts_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(150):
        text = "".join(r.choice(["a", "b", "c"]) + r.choice([" ", " ", "\n", "\t", "\x0b", " # ", "\xa0", "\x1c", "é"]) for _ in range(r.randint(0, 90)))
        rows.append((i, text, 1, "x"))
    rows += [(500, None, 1, "x"), (None, "null id " * 30, 1, "x"), (501, "", 1, "x"), (501, "", 1, "x"), (502, "w" * 300_000, 1, "x")]
    rows += [(600 + i, " ".join(r.choice("the quick brown fox jumps over lazy dogs and cats".split()) for _ in range(60)) + ".", 1, "x") for i in range(20)]
    rows += [(700 + i, " ".join(f"W{r.randint(0, 999)}***" for _ in range(60)), 1, "x") for i in range(20)]
    labels = [(i, int(i < 700), 0) for i in range(600, 720)] + [(None, 1, 0), (3, None, None)]
    got = quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    key = lambda x: str(tuple(x))
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got), key=key) == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=key)
    kept = {g.doc_id: g.kept for g in got}
    assert all(kept[600 + i] for i in range(20)) and not any(kept[700 + i] for i in range(20))
    assert not kept[500] and not kept[501]


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "Plain words stand here and there in this line of text so that it may be kept by rules, surely.", 0, "")], SCHEMA)
    assert quality_rules(docs, labels).first().kept
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_repeated_windows_of_long_text():
    words = [str(i % 1000) for i in range(5000)]
    assert repeated_words(words) == 5000
    assert repeated_words(list(map(str, range(100)))) == 0
    assert judge("a", Chain((0.0,) * 12, ((0, 0), (0, 0)), (0, 0)))[-1] is False


def prose(r, n=1):
    words = "the quick brown fox jumps over lazy dogs and cats near a river while it rains on old stone walls".split()
    return [" ".join(r.choice(words) for _ in range(r.randint(9, 15))).capitalize() + "." for _ in range(n)]


def menu(r, n=1):
    return [" | ".join(f"{r.choice(['Home', 'News', 'Login', 'Shop', 'About'])} {r.randint(1, 99)}" for _ in range(8)) for _ in range(n)]


def mixed_corpus(r):
    """Good texts of prose, some with a menu on top; bad ones of menus, most with a line or two of prose on top."""
    good = [menu(r, r.choice([0, 0, 1])) + prose(r, r.randint(4, 9)) for _ in range(60)]
    bad = [prose(r, r.choice([0, 1, 1])) + menu(r, r.randint(4, 9)) for _ in range(60)]
    return [(i, "\n".join(x), int(i < 60)) for i, x in enumerate(good + bad)]


def test_lines_get_labels_of_their_own(spark):
    r = random.Random(8)
    rows = mixed_corpus(r)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows] + [(0, rows[0][1], 1, "x")] * 50, SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)
    chain = fit_chain(docs, labels)
    switches = chain.moves[0][1] + chain.moves[1][0], chain.moves[0][0] + chain.moves[1][1]
    assert switches[0] < switches[1]  # runs of lines
    for _ in range(20):
        text = prose(r, 4) + menu(r, 3) + prose(r, 4)
        *_, share, kept = judge("\n".join(text), chain)
        want = sum(len(w) for i, x in enumerate(text) if not 4 <= i < 7 for w in x.split()) / sum(len(w) for x in text for w in x.split())
        assert 0 < share < 1 and abs(share - want) < 1e-9 and kept == (want >= CONTENT_SHARE)


def test_share_and_verdict_against_all_label_paths(spark):
    r = random.Random(12)
    rows = mixed_corpus(r)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)
    c = fit_chain(docs, labels)
    assert {g.doc_id: (g.content_share, g.kept) for g in quality_rules(docs, labels).collect()} == {i: judge(t, c)[-2:] for i, t, _ in rows}
    for _, text, _ in rows[::7]:
        lines, words, again = lines_of(text)
        e = [float(np.dot(line_features(*x), c.weights)) for x in zip(lines, words, again)]
        sizes = [len(re.sub(r"\s", "", x)) for x in text.split("\n")]
        score = lambda p: c.starts[p[0]] + sum(x for x, y in zip(e, p) if y) + sum(c.moves[a][b] for a, b in itertools.pairwise(p))
        best = max(itertools.product((0, 1), repeat=len(e)), key=score)
        share = sum(n for n, y in zip(sizes, best) if y) / sum(sizes)
        *_, failed, got, kept = judge(text, c)
        assert abs(got - share) < 1e-9 and kept == (not failed and share >= CONTENT_SHARE)


def test_labels_of_lines_agree_with_texts():
    r = np.random.default_rng(3)
    texts = []
    for k in range(40):
        y = np.repeat(r.random(5) < (0.8 if k % 2 else 0.2), 3).astype(float)
        size = np.ones(15)
        texts.append((np.stack([np.ones(15), y + 0.2 * r.normal(size=15)], 1), size, bool(y.mean() >= 0.5)))
    for (x, size, good), y in zip(texts, labelled_lines(texts, 0.5)):
        assert (y.mean() >= 0.5) == good
        assert np.mean(y == (x[:, 1] > 0.5)) > 0.9
