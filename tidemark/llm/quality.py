"""Quality rules: counts over whole texts, and the share of content lines by a conditional random field."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Chain, fit, labelled_lines, viterbi

#: Labelled documents that the field is fitted on at most, in the order of a hash of their ids, and lines of each.
TRAIN_DOCS = 1000
TRAIN_LINES = 256
#: Share of a text's word characters that must stand in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_BLANKS = " \t\n\v\f\r"
FEATURES = 12
#: Used where no labelled rows of both kinds exist: symbols, capitals, exclamations and repetition speak against a line.
PRIOR = Chain((2.0, -3.0, -4.0, -3.0, -4.0, -1.0, -0.5, 0.5, -1.0, -0.5, 0.0, 0.0), ((0.5, -0.5), (-0.5, 0.5)), (0.0, 0.5))


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    n = len(line) or 1
    count = lambda kind: len(line) - len(line.translate(None, kind))
    upper, lower = count(_UPPER), count(_LOWER)
    k = len(words) or 1
    return [
        1.0,
        min(3.0, count(_SYMBOLS) / k),
        upper / (upper + lower + 1),
        min(3.0, line.count(b"!") / k),
        1.0 - len(set(words)) / k,
        float(b" | " in line),
        float(len(words) < 4),
        float(line.rstrip()[-1:] in (b".", b"?", b"!", b":")),
        count(_DIGITS) / n,
        float(again),
        min(2.0, n / k / 20),
        min(1.0, math.log1p(len(words)) / 5),
    ]


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that stand in a window of so many words that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.uint64, count=len(words))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    seen: dict[bytes, int] = {}  # equal keys are only candidates: the windows themselves decide
    at = np.flatnonzero(np.isin(key, twice)).tolist()
    exact = [ids[i : i + window].tobytes() for i in at]
    for x in exact:
        seen[x] = seen.get(x, 0) + 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, x in zip(at, exact, strict=True):
        if seen[x] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def lines_of(text: str) -> tuple[list[bytes], list[list[bytes]], list[bool]]:
    """Lines, their words, and whether a line with a word equals an earlier one."""
    lines = text.encode().split(b"\n")
    words = [line.split() for line in lines]
    seen: set[bytes] = set()
    again = []
    for line, own in zip(lines, words, strict=True):
        again.append(bool(own) and line in seen)
        seen.add(line)
    return lines, words, again


def judge(text: str, chain: Chain) -> tuple:
    lines, words, again = lines_of(text)
    every = [w for own in words for w in own]
    n_words = len(every)
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    n_symbols = sum(map(text.count, _SYMBOLS.decode()))
    n_repeat = repeated_words(every)
    failed = n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words
    used = [i for i, own in enumerate(words) if own]
    share = 0.0
    if used:
        scores = np.array([line_features(lines[i], words[i], again[i]) for i in used]) @ np.array(chain.weights)
        sizes = [sum(map(len, words[i])) for i in used]
        share = sum(s for s, y in zip(sizes, viterbi(chain, scores.tolist()), strict=True) if y) / sum(sizes)
    return n_words, word_chars, n_symbols, sum(again), n_repeat, failed, share, not failed and share >= CONTENT_SHARE


def fit_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """A field fitted on at most TRAIN_DOCS labelled documents.

    Labels are of whole documents, the field's are of lines: labelled_lines finds those, so that the field sees texts
    that switch between content and boilerplate. The sample is the smallest hashes of labelled ids, so reruns agree.
    PRIOR where only one kind is labelled.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")

    def features(batches):
        for pdf in batches:
            out = []
            for text in pdf.text:
                lines, words, again = lines_of(text)
                used = [i for i, own in enumerate(words) if own]
                first = max(0, len(used) - TRAIN_LINES) // 2
                x = [[*line_features(lines[i], words[i], again[i]), sum(map(len, words[i]))] for i in used[first : first + TRAIN_LINES]]
                out.append(np.array(x, dtype=np.float32).tobytes())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "quality": pdf.quality, "x": out})

    x = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInPandas(features, "doc_id long, quality int, x binary")
    rows = x.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).collect()  # an id may repeat
    texts = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        x = np.frombuffer(r.x, dtype=np.float32).reshape(-1, FEATURES + 1).astype(np.float64)
        if len(x):
            texts.append((x[:, :FEATURES], x[:, FEATURES], r.quality > 0))
    if len({good for *_, good in texts}) < 2:
        return PRIOR
    return fit([(x, y) for (x, *_), y in zip(texts, labelled_lines(texts, CONTENT_SHARE), strict=True)], FEATURES)


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def with_verdict(docs: DataFrame, chain: Chain, name: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column of counts and the verdict on the whole text. A null text has no words and fails."""

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        rows = [judge(t or "", chain) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT.split(", ")])

    return docs.withColumn(name, verdict(F.col(text_col).cast("string")))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, content_share and kept.

    Words are runs of other characters than space and \\t..\\r. base_failed: fewer than MIN_WORDS words, or more than
    REPEAT_PERCENT % of them in repeated windows. Otherwise Viterbi decoding marks each line with a word as content or
    boilerplate, and the content lines' share of word characters decides. Nulls, empty texts and empty tables are
    defined (no words: failed; no rows); repeated rows are judged one by one; other columns are ignored.
    """
    chain = fit_chain(docs, labels)
    out = with_verdict(docs.select("doc_id", "text"), chain, "verdict")
    return out.select("doc_id", "verdict.*")


def op1_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
