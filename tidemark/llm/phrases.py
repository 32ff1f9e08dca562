"""Phrases mined by passes of growing length: hashed bucket counts of the next length, bitmaps, Apriori, exact counts."""

from __future__ import annotations

import functools
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .buckets import bitmap, bucket_of, is_set, slice_rows
from .common import stored

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bitmaps of 2**BITS buckets (8 MB) are broadcast, at every size of the corpus. Where buckets overflow they prune less,
#: and Apriori bitmaps and exact counts do the work; results are the same.
BITS = 26
#: Words of a chunk, the unit that a task counts at once.
CHUNK = 1 << 21
#: Bytes of text that are cut into words at once.
STRIP = 1 << 21
#: A byte that no UTF-8 text has: between two pieces.
BREAK = b"\xff"
#: Lower case, tabs as spaces, every piece break as a line feed.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
#: Ways, by hash, that exact counts are added up in; a task holds the counted phrases of one way and language at a time.
WAYS = 1 << 12
#: Ways that the ranks of a language are cut in before one task has the rest.
SALTS = 64

CHUNKS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("own", pa.int64()), ("words", pa.binary()), ("slice", pa.int32()), ("offsets", pa.binary()), ("counts", pa.binary())])
GRAMS = pa.schema([("lang", pa.string()), ("way", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary()), ("slice", pa.int32()), ("offsets", pa.binary()), ("counts", pa.binary())])


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _bucket_rows(schema: pa.Schema, buckets: np.ndarray, most: int) -> pa.RecordBatch:
    part = slice_rows(buckets, most)
    return _rows(schema, part.num_rows, **{c: part.column(c) for c in part.schema.names})


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases from the hashes of all but their last words, and of the last words."""
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word


def phrase_hashes(lang: str, phrases: list[bytes], length: int) -> np.ndarray:
    words = word_hashes(lang, b" ".join(phrases).split(b" ")).reshape(-1, length).T
    return functools.reduce(longer, words)


class Chunk:
    """Words of one language in reading order, as places in a list of its own; place 0 is a break."""

    def __init__(self, first: list[bytes] = ()):
        self.place = defaultdict(count().__next__)
        self.place[BREAK]
        self.ids = [self._placed(first)]
        self.size = len(first)

    def _placed(self, words) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def add(self, words: list[bytes]) -> None:
        self.ids.append(self._placed(words))
        self.size += len(words)


def _strips(text: bytes):
    """Words of a text, a strip at a time, breaks among them; strips are cut between words."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > STRIP:
            cut = max(text.rfind(b" ", at, at + STRIP), text.rfind(b"\n", at, at + STRIP))
            if cut <= at:  # a word longer than a strip
                cut = min((x for x in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if x > 0), default=end)
            end = cut
        yield text[at:end].replace(b"\n", b" \xff ").split()
        at = end


def windows(ids: np.ndarray, length: int) -> np.ndarray:
    """Words from each place on to the next break, at most length."""
    run = np.zeros(len(ids) + 1, np.int8)
    for k in range(1, length + 1):
        grown = np.zeros(len(ids) + 1, np.int8)
        grown[: len(ids)] = np.where(ids != 0, 1 + run[1:], 0)
        run = np.minimum(grown, k)
    return run[: len(ids)]


def _first_pass(least: int, longest: int, bits: int, size: int):
    def run(batches):
        open_chunks: dict[str, Chunk] = {}

        def flush(lang: str, ended: bool):
            chunk = open_chunks.pop(lang)
            ids, words = np.concatenate(chunk.ids), list(chunk.place)
            own = len(ids) if ended else max(0, len(ids) - (longest - 1))
            if not ended:  # the last words begin the next chunk too, as phrases that begin before them reach into them
                open_chunks[lang] = Chunk([words[i] for i in ids[own:]])
            n = np.bincount(ids[:own], minlength=len(words))
            seen = np.flatnonzero(n[1:]) + 1
            yield _rows(CHUNKS, len(seen), lang=[lang] * len(seen), word=[words[i] for i in seen], n=n[seen])
            yield _rows(CHUNKS, 1, lang=[lang], ids=[ids.astype("<i4").tobytes()], own=[own], words=[b" ".join(words)])
            h = word_hashes(lang, words)[ids]
            at = np.flatnonzero(windows(ids, 2)[:own] >= 2)
            yield _bucket_rows(CHUNKS, bucket_of(longer(h[at], h[at + 1]), bits), least)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in _strips(memoryview(text.as_buffer()).tobytes()):
                    if lang not in open_chunks:
                        open_chunks[lang] = Chunk()
                    open_chunks[lang].add(words)
                    if open_chunks[lang].size >= size:
                        yield from flush(lang, False)
                if lang in open_chunks:
                    open_chunks[lang].add([BREAK])
                while sum(c.size for c in open_chunks.values()) >= size:
                    yield from flush(max(open_chunks, key=lambda k: open_chunks[k].size), True)
        for lang in list(open_chunks):
            yield from flush(lang, True)

    return run


def _later_pass(length: int, frequent, buckets, least: int, longest: int, bits: int):
    """Exact counts, in each chunk, of the phrases of length whose shorter parts are frequent and whose bucket is, and
    bucket counts of the phrases one longer that are made of two such."""

    def run(batches):
        for batch in batches:
            for lang, ids, own, words in zip(*(batch.column(c).to_pylist() for c in ("lang", "ids", "own", "words")), strict=True):
                ids, words = np.frombuffer(ids, "<i4"), words.split(b" ")
                if len(ids) < length:
                    continue
                word, reach = word_hashes(lang, words)[ids], windows(ids, length + 1)
                shorter = word
                for k in range(1, length - 1):
                    shorter = longer(shorter[:-1], word[k:])
                good = is_set(frequent.value, bucket_of(shorter, bits))
                may = np.zeros(len(ids) + 1, bool)
                at = np.flatnonzero(good[:-1] & good[1:] & (reach[: len(good) - 1] >= length))
                h = longer(shorter[at], word[at + length - 1])
                ok = is_set(buckets.value, bucket_of(h, bits))
                at, h = at[ok], h[ok]
                may[at] = True
                if length < longest:
                    two = may[at] & may[at + 1] & (reach[at] > length) & (at < own)
                    yield _bucket_rows(GRAMS, bucket_of(longer(h[two], word[at[two] + length]), bits), least)
                at, h = at[at < own], h[at < own]
                order = np.argsort(h)
                at, h = at[order], h[order]
                # runs of equal words: phrases whose hashes clash are told apart
                new = np.ones(len(at), bool)
                new[1:] = np.any([ids[at[1:] + j] != ids[at[:-1] + j] for j in range(length)], axis=0)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                way = bucket_of(h[first], WAYS.bit_length() - 1)
                order = np.argsort(way, kind="stable")
                places, n, way = ids[at[first[order]][:, None] + np.arange(length)].tolist(), n[order], way[order]
                cuts = [0, *(np.flatnonzero(np.diff(way)) + 1).tolist(), len(way)]
                spans = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(way) else []
                some = [b"\n".join([b" ".join([words[i] for i in p]) for p in places[i:j]]) for i, j in spans]
                yield _rows(GRAMS, len(spans), lang=[lang] * len(spans), way=[int(way[i]) for i, _ in spans], phrases=some, n=[n[i:j].tobytes() for i, j in spans])

    return run


def _added(least: int):
    """Phrases that reach least, of parts in the order of (way, lang)."""

    def run(batches):
        total, of = defaultdict(int), None

        def reached():
            kept = [(p, n) for p, n in total.items() if n >= least]
            return pa.RecordBatch.from_arrays([pa.array([of[1]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for way, lang, phrases, n in zip(*(batch.column(c).to_pylist() for c in ("way", "lang", "phrases", "n")), strict=True):
                if (way, lang) != of:
                    if of:
                        yield reached()
                    total.clear()
                    of = (way, lang)
                for phrase, k in zip(phrases.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    total[phrase] += k
        if of:
            yield reached()

    return run


def _hashed(length: int, bits: int):
    def run(batches):
        for batch in batches:
            of = defaultdict(list)
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                of[lang].append(phrase.encode())
            if of:
                yield slice_rows(bucket_of(np.concatenate([phrase_hashes(lang, some, length) for lang, some in of.items()]), bits), 1)

    return run


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = BITS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of every phrase of 1 to longest words that occurs at least least times in its language,
    and (lang, total) words of each language.

    The first pass cuts texts into words, writes them as places in word lists, counts words exactly and pairs by
    bucket. Pass k reads those chunks: a phrase of k words is counted exactly, by its words, where both of its parts of
    k-1 words are frequent (a bitmap of hashes) and its bucket reached least (another); phrases of k+1 words made of two
    such are counted by bucket for the next pass. A bitmap may only let more through to the exact counts.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    first = stored(d.mapInArrow(_first_pass(least, longest, bits, chunk), _spark_schema(CHUNKS)), "chunks")
    words = first.where("word is not null")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    named = lambda df, k: df.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("words"), "n")
    frequent = words.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = [stored(named(frequent, 1), "phrases-1")]
    chunks, counted = first.where("ids is not null").select("lang", "ids", "own", "words"), first
    for k in range(2, longest + 1):
        of_buckets = sc.broadcast(bitmap(counted.where("slice is not null").select("slice", "offsets", "counts"), bits, least))
        of_frequent = sc.broadcast(bitmap(found[-1].select("lang", "phrase").mapInArrow(_hashed(k - 1, bits), "slice int, offsets binary, counts binary"), bits, 1))
        counted = stored(chunks.mapInArrow(_later_pass(k, of_frequent, of_buckets, least, longest, bits), _spark_schema(GRAMS)), f"grams-{k}")
        parts = counted.where("way is not null").select("way", "lang", "phrases", "n").repartition("way").sortWithinPartitions("way", "lang")
        found.append(stored(named(parts.mapInArrow(_added(least), "lang string, phrase binary, n long"), k), f"phrases-{k}"))
        of_buckets.destroy()
        of_frequent.destroy()
    return functools.reduce(DataFrame.unionAll, found), totals


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, same_percent: int = 100, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends and into words at spaces and tabs. A
    phrase of 2 to longest words that occurs a >= least times scores floor(1000 * a * n / (l * r)) at the cut where that
    is least, the first such; l and r count both sides, n the words of the language. A phrase goes if its words lie in a
    longer one that occurs same_percent of a times or more. Ranks are by score and a descending, then by phrase.

    A null text is empty, a null language is `und`; repeated rows count each; an empty table gives an empty result;
    other columns are ignored. Products are taken in decimals of 38 digits.
    """
    known, totals = frequent_phrases(docs, text_col, lang_col, least, longest, bits, chunk)
    candidates = known.where("words > 1")
    split = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))

    cuts = split.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * big("total")), big("l") * big("r")
    cuts = cuts.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("s")).select("lang", "phrase", "s.*")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.concat_ws(" ", F.slice("w", s, m)))))
    inside = split.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < same_percent * F.col("a")))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    # at most SALTS * top rows of a language meet here
    best = salted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_a"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))).alias("all"))
    ranked = best.select("lang", F.posexplode(F.slice("all", 1, top)).alias("pos", "x"))
    return ranked.select("lang", (F.col("pos") + 1).cast("long").alias("rank"), *(F.col("x")[c].alias(c) for c in ("phrase", "a", "l", "r", "n", "score")))


def op11_pcy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best-scoring phrases of two to five words of each language of documents, as mine_phrases has them."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, regexp_split_to_array(replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9), ' '), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(string_split(unnest(ps), ' '), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k.k AS words, array_to_string(w[i.i:i.i + k.k - 1], ' ') AS phrase
      FROM p, (SELECT unnest(range(1, 6)) AS k) k, LATERAL (SELECT unnest(range(1, len(w) - k.k + 2)) AS i) i),
t AS (SELECT lang, count(*) AS n FROM g WHERE words = 1 GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
c AS (SELECT s.lang, s.phrase, s.a, k.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * s.a * t.n) // (x.a::HUGEINT * y.a) AS score
      FROM s JOIN (SELECT unnest(range(1, 5)) AS k) k ON k.k < s.words
      JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:k.k], ' ')
      JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[k.k + 1:], ' ')
      JOIN t ON t.lang = s.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT q.lang, q.phrase FROM s q JOIN s z ON z.lang = q.lang AND z.words > q.words AND 100 * z.a >= 100 * q.a AND contains(' ' || z.phrase || ' ', ' ' || q.phrase || ' ')),
k AS (SELECT b.* FROM b ANTI JOIN o ON o.lang = b.lang AND o.phrase = b.phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
