"""Estimators of item response models: ability by likelihood, with a prior or by quadrature; items by marginal likelihood.

Every step is one aggregation of the answers by learner or by item: what is gathered are sums at quadrature points, or
one row of sums for each key. The search of a likelihood's top goes through a learner's answers where they
are, up to HELD different ones; a learner with more is served by aggregations. Items are calibrated by blocks that send
each other parameters and posteriors.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut, few_rows_a_batch, removed, shuffles_freed, work_folder

# The range of abilities and that of a search, and what is added to keep logarithms finite.
LOW, HIGH, BOUND, TINY = -3.0, 3.0, 4.0, 1e-9
POINTS = 21
#: Different answers of a learner that a task holds at most.
HELD = 100_000


def hermite(points: int = POINTS, mean: float = 0.0, sd: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a quadrature under a normal distribution."""
    x, w = np.polynomial.hermite_e.hermegauss(points)
    return mean + sd * x, w / w.sum()


def _p(theta: Column | float, a: Column, b: Column, c: Column) -> Column:
    p = c + (1 - c) / (1 + F.exp(a * (b - theta)))
    return F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), p))


def _log(theta, a: Column, b: Column, c: Column) -> Column:
    p = _p(theta, a, b, c)
    return F.when(F.col("correct"), F.log(p)).otherwise(F.log(1 - p))


def pooled(answers: DataFrame) -> DataFrame:
    """(learner, a, b, c, correct, n): equal answers of a learner counted once; all that the estimators need."""
    return answers.groupBy("learner", "a", "b", "c", "correct").agg(F.count("*").alias("n"))


def ability_likelihood(answers: DataFrame, prior_sd: float | None = None, prior_mean: float = 0.0, rounds: int = 40, tolerance: float = 1e-6, held: int = HELD) -> DataFrame:
    """(learner, theta, se, n) of the most likely ability (with prior_sd: the posterior's mode under a normal prior).

    answers: learner, a, b, c, correct. Every learner takes Fisher-scoring steps until one is below tolerance; a step that
    lowers the likelihood is halved. Abilities lie in [LOW, HIGH]: where all answers are right or wrong they are at an end.
    Learners with at most `held` different answers are searched in the task that has them, the others all at once by rounds.
    """
    inverse = 0.0 if prior_sd is None else 1.0 / max(prior_sd * prior_sd, TINY)
    rows = pooled(answers).where("learner is not null")
    kind = answers.schema["learner"].dataType.simpleString()
    dealt = rows.repartition("learner").sortWithinPartitions("learner", "a", "b", "c", "correct")
    fit = lambda batches: _fit_sorted(batches, inverse, prior_mean, rounds, tolerance, held)
    found = cut(dealt.select("learner", "a", "b", "c", "correct", "n").mapInArrow(fit, f"learner {kind}, theta double, se double, n long"))
    many = found.where("theta is null").select("learner")
    if many.isEmpty():
        return found
    by_rounds = _ability_by_rounds(cut(rows.join(many, "learner", "left_semi")), inverse, prior_mean, rounds, tolerance)
    return found.where("theta is not null").unionByName(by_rounds)


def _starts(key) -> np.ndarray:
    """Where the runs of equal keys begin."""
    if len(key) < 2:
        return np.zeros(len(key), "int64")
    return np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))])


def _whole(batches, key: str):
    """Tables of sorted batches, each with all rows of its keys."""
    rest = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        end = int(_starts(t[key].combine_chunks())[-1])
        if rest and (end or rest[-1][key][-1] != t[key][0]):
            yield pa.concat_tables([*rest, t.slice(0, end)])
            rest = []
        elif end:
            yield t.slice(0, end)
        rest.append(t.slice(end))
    if rest:
        yield pa.concat_tables(rest)


def _fit_sorted(batches, inverse: float, mean: float, rounds: int, tolerance: float, held: int):
    """Abilities of learners whose answers follow one another; those with more than `held` come out without an ability."""
    rest, long = None, None  # answers of the learner whose end isn't seen; the key, if there were too many

    def fitted(t: pa.Table):
        key = t["learner"].combine_chunks()
        starts = _starts(key)
        lengths = np.diff(np.append(starts, len(key)))
        short = lengths <= held
        rows = np.repeat(short, lengths)
        column = lambda c: t[c].cast(pa.float64()).to_numpy()[rows]
        theta, se, n = np.full(len(starts), np.nan), np.full(len(starts), np.nan), np.zeros(len(starts), "int64")
        if short.any():
            at = np.concatenate([[0], np.cumsum(lengths[short])[:-1]])
            theta[short], se[short], n[short] = fit_abilities(*(column(c) for c in ("a", "b", "c", "correct", "n")), at, inverse, mean, rounds, tolerance)
        none = ~short
        return pa.RecordBatch.from_arrays([key.take(pa.array(starts)), pa.array(theta, mask=none), pa.array(se, mask=none), pa.array(n)], names=["learner", "theta", "se", "n"])

    def alone(key):
        return pa.RecordBatch.from_arrays([key, *(pa.nulls(1, x) for x in (pa.float64(), pa.float64(), pa.int64()))], names=["learner", "theta", "se", "n"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if long is not None:
            same = pc.equal(t["learner"], long[0]).to_numpy()
            t = t.slice(int(same.sum()))
            if t.num_rows:
                yield alone(long)
                long = None
        if not t.num_rows:
            continue
        t = t if rest is None else pa.concat_tables([rest, t])
        last = pc.equal(t["learner"], t["learner"][t.num_rows - 1]).to_numpy()
        end = t.num_rows - int(last.sum())
        if end:
            yield fitted(t.slice(0, end))
        rest = t.slice(end)
        if rest.num_rows > held:
            rest, long = None, pa.array([rest["learner"][0].as_py()], rest["learner"].type)
    if long is not None:
        yield alone(long)
    if rest is not None:
        yield fitted(rest)


def fit_abilities(a: np.ndarray, b: np.ndarray, c: np.ndarray, u: np.ndarray, n: np.ndarray, starts: np.ndarray, inverse: float, mean: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(theta, se, n) of the learners whose answers begin at starts; u: 1 where right, 0 where wrong, NaN unknown."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
    add = lambda x: np.add.reduceat(np.where(np.isnan(x), 0.0, x), starts)

    def sums(theta):
        with np.errstate(over="ignore"):
            p = np.clip(c + (1 - c) / (1 + np.exp(a * (b - theta[owner]))), TINY, 1 - TINY)
        away = theta - mean
        l = add(n * np.log(np.where(u == 1, p, 1 - p))) - 0.5 * inverse * away * away  # noqa: E741
        slope = add(n * a * (u - p) * (p - c) / (p * (1 - c))) - inverse * away
        return l, slope, add(n * a * a * ((p - c) / (1 - c)) ** 2 * (1 - p) / p) + inverse

    theta = np.full(len(starts), max(-BOUND, min(BOUND, mean if inverse else 0.0)))
    log, step, open_ = np.full(len(starts), -np.inf), np.zeros(len(starts)), np.ones(len(starts), bool)
    for _ in range(rounds):
        new = theta + step
        l, slope, info = sums(new)  # noqa: E741
        better = l >= log - 1e-12
        ahead = np.clip(new + slope / np.maximum(info, TINY), -BOUND, BOUND) - new
        up, down = open_ & better, open_ & ~better
        theta, log = np.where(up, new, theta), np.where(up, l, log)
        step = np.where(up, ahead, np.where(down, step / 2, step))
        open_ &= np.abs(step) >= tolerance
        if not open_.any():
            break
    theta = np.clip(theta, LOW, HIGH)
    return theta, 1 / np.sqrt(np.maximum(sums(theta)[2], TINY)), np.rint(add(n)).astype("int64")


def _ability_by_rounds(rows: DataFrame, inverse: float, prior_mean: float, rounds: int, tolerance: float) -> DataFrame:
    """The same for learners with any number of answers: a round adds up likelihood, slope and information of each at the
    place that it proposed."""
    at = cut(rows.groupBy("learner").agg(F.sum("n").alias("n")).select("learner", "n", F.lit(max(-BOUND, min(BOUND, prior_mean if inverse else 0.0))).alias("theta"), F.lit(float("-inf")).alias("log"), F.lit(0.0).alias("step")))

    def sums(at: DataFrame, theta: Column) -> DataFrame:
        a, b, c, p = F.col("a"), F.col("b"), F.col("c"), _p(F.col("try"), F.col("a"), F.col("b"), F.col("c"))
        u = F.col("correct").cast("double")
        slope = a * (u - p) * (p - c) / (p * (1 - c))
        information = a * a * F.pow((p - c) / (1 - c), 2) * (1 - p) / p
        s = rows.join(at.select("learner", theta.alias("try")), "learner").groupBy("learner", "try").agg(F.sum(F.col("n") * _log(F.col("try"), a, b, c)).alias("l"), F.sum(F.col("n") * slope).alias("slope"), F.sum(F.col("n") * information).alias("info"))
        away = F.col("try") - prior_mean
        return s.select("learner", "try", (F.col("l") - 0.5 * inverse * away * away).alias("l"), (F.col("slope") - inverse * away).alias("slope"), (F.col("info") + inverse).alias("info"))

    for _ in range(rounds):
        new = at.join(sums(at, F.col("theta") + F.col("step")), "learner")
        open_ = (F.col("log") == float("-inf")) | (F.abs("step") >= tolerance)
        better = open_ & (F.col("l") >= F.col("log") - 1e-12)
        # the next step ends at the bound at the latest
        ahead = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("try") + F.col("slope") / F.greatest(F.col("info"), F.lit(TINY)))) - F.col("try")
        at = cut(new.select("learner", "n", F.when(better, F.col("try")).otherwise(F.col("theta")).alias("theta"), F.when(better, F.col("l")).otherwise(F.col("log")).alias("log"), F.when(better, ahead).when(open_, F.col("step") / 2).otherwise(F.col("step")).alias("step")))
        if at.where(F.abs("step") >= tolerance).limit(1).count() == 0:
            break
    ends = at.select("learner", "n", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("theta"))).alias("theta"))
    info = sums(ends, F.col("theta")).select("learner", "info")
    return ends.join(info, "learner").select("learner", "theta", (1 / F.sqrt(F.greatest(F.col("info"), F.lit(TINY)))).alias("se"), F.col("n").cast("long").alias("n"))


def _at_points(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """(learner, n, logs): likelihood of each learner's answers at every place."""
    sums = [F.sum(F.col("n") * _log(float(x), F.col("a"), F.col("b"), F.col("c"))).alias(f"q{k}") for k, x in enumerate(places)]
    return rows.groupBy("learner").agg(F.sum("n").alias("answers"), *sums).select("learner", "answers", F.array(*(f"q{k}" for k in range(len(places)))).alias("logs"))


def _posterior(at: DataFrame, weights: np.ndarray) -> DataFrame:
    """at with post, the posterior at each place, and log_marginal."""
    joint = F.zip_with("logs", F.array(*(F.lit(float(np.log(w))) for w in weights)), lambda x, w: x + w)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    d = at.withColumn("joint", joint).withColumn("top", F.array_max("joint")).withColumn("all", total("joint", lambda x: F.exp(x - F.col("top"))))
    return d.withColumn("post", F.transform("joint", lambda x: F.exp(x - F.col("top")) / F.col("all"))).withColumn("log_marginal", F.col("top") + F.log("all")).drop("joint", "top", "all", "logs")


def ability_quadrature(answers: DataFrame, points: int = POINTS, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """(learner, theta, se, n): posterior mean and deviation under a normal prior, by Gauss-Hermite quadrature."""
    places, weights = hermite(points, mean, sd)
    x = F.array(*(F.lit(float(v)) for v in places))
    d = _posterior(_at_points(pooled(answers), places), weights)
    moment = lambda f: F.aggregate(F.zip_with("post", x, f), F.lit(0.0), lambda s, v: s + v)
    d = d.withColumn("theta", moment(lambda p, v: p * v))
    return d.select("learner", "theta", F.sqrt(moment(lambda p, v: p * (v - F.col("theta")) * (v - F.col("theta")))).alias("se"), F.col("answers").cast("long").alias("n"))


#: Answers of a block at which learners and items are dealt to more blocks.
EACH = 2_000_000


def calibrate_items(answers: DataFrame, points: int = POINTS, rounds: int = 30, tolerance: float = 1e-4, newton: int = 25, held: int = HELD, each: int = EACH) -> DataFrame:
    """(item, a, b, n): discrimination and difficulty of two-parameter items by marginal maximum likelihood.

    answers: learner, item, correct. A round takes the posterior of each learner at the quadrature points, then the
    answers and right answers that each item is expected to have there, and from those new parameters by Newton steps,
    item by item. It ends when no parameter moves by more than tolerance. a lies in [0.2, 3], b in [-4, 4].

    Learners and items are numbered once and dealt to blocks of about `each` answers; the answers of a block of learners
    to a block of items are a cell, kept twice as pairs of numbers. In a round a block of items sends the parameters of
    the items in a cell, once each, and a block of learners the posteriors of the learners in it, once each, as floats.
    A task takes up `held` answers of a cell at once. The messages of a round and its shuffle files go with the next.
    """
    spark = answers.sparkSession
    places, weights = hermite(points)
    folder = f"{work_folder(spark)}/items-{uuid.uuid4().hex}"
    held = max(held, 1)

    def written(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    with shuffles_freed(spark), few_rows_a_batch(spark) as few:
        rows = written(answers.select("learner", "item", F.coalesce("correct", F.lit(False)).alias("correct")), "answers")
        share = F.avg(F.col("correct").cast("double"))
        first = -F.log(F.greatest(share, F.lit(0.01)) / F.greatest(1 - share, F.lit(0.01)))
        counts = written(rows.where("item is not null").groupBy("item").agg(F.count("*").alias("n"), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), first)).alias("b")), "counts")
        numbers, blocks = _numbers(rows.where("learner is not null and item is not null"), each, lambda df: written(df, "numbers"))
        named = numbers.where("item is not null").select("j", "y", "item")
        dealt = lambda df, block: df.repartitionById(blocks, block)
        cell = numbers.select("i", "j", "x", "y", "correct", (F.col("i").cast("long") * blocks + F.col("j")).alias("cell"))
        of_learners = written(dealt(cell, "i").sortWithinPartitions("cell").mapInArrow(lambda batches: _cells(batches, "i", "j"), _SENT), "of-learners")
        of_items = written(dealt(cell.withColumn("cell", F.col("j").cast("long") * blocks + F.col("i")), "j").sortWithinPartitions("cell").mapInArrow(lambda batches: _cells(batches, "j", "i"), _SENT), "of-items")
        start = dealt(counts.select("item", "b").join(named, "item"), "j").sortWithinPartitions("j", "y").select("j", "b").mapInArrow(_starting, _SENT)
        few()  # from here on a row holds a cell or a message
        met = lambda *frames: dealt(functools.reduce(DataFrame.unionAll, frames), "to").sortWithinPartitions("to", "sender", "kind")
        expect = lambda batches: _posteriors(batches, places, weights, held)
        new_items = lambda steps: lambda batches: _new_items(batches, len(places), places, steps, held)
        sent = [F.col(c) for c in _COLUMNS]
        out = written(met(start, of_items).mapInArrow(new_items(0), f"{_SENT}, moved double"), "items-0", "kind")
        for k in range(1, rounds + 1):
            state = out.where(F.col("kind") == STATE).select(*sent)
            posts = met(of_learners, out.where(F.col("kind") == MESSAGE).select(*sent)).mapInArrow(expect, _SENT)
            out = written(met(state, of_items, posts).mapInArrow(new_items(newton), f"{_SENT}, moved double"), f"items-{k}", "kind")
            removed(spark, f"{folder}/items-{k - 1}")
            if (out.where(F.col("kind") == STATE).agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
                break
        ends = out.where(F.col("kind") == STATE).select(*sent).mapInArrow(_unpacked, "j int, y int, a double, b double")
        found = written(ends.join(named, ["j", "y"]).select("item", "a", "b").join(counts.select("item", F.col("n").cast("long").alias("n")), "item"), "found")
    return found


# What a block gets: its parameters, then by sender the message and the cell that it is for.
STATE, MESSAGE, CELL = -1, 0, 1
_COLUMNS = ("to", "sender", "kind", "u", "v", "w")
_SENT = "`to` int, sender int, kind int, u binary, v binary, w binary"


def _numbers(rows: DataFrame, each: int, written) -> tuple[DataFrame, int]:
    """(i, x, j, y, correct, item), and how many blocks there are: i and j are the blocks of learner and item, x and y their
    numbers in them, and item is given with the first of its rows, else null."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = rows.count()
    blocks = max(min(cores, -(-n // 20_000)), -(-n // each), 1)
    if blocks > cores:
        blocks = -(-blocks // cores) * cores
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    kind = rows.schema["item"].dataType.simpleString()
    people = rows.select("learner", "item", "correct", block("learner").alias("i")).repartitionById(blocks, "i").sortWithinPartitions("learner")
    people = people.mapInArrow(lambda batches: _numbered(batches, "learner", "i", "x"), f"item {kind}, correct boolean, i int, x int")
    items = people.withColumn("j", block("item")).repartitionById(blocks, "j").sortWithinPartitions("item")
    return written(items.mapInArrow(lambda batches: _numbered(batches, "item", "j", "y", True), f"correct boolean, i int, x int, j int, y int, item {kind}")), blocks


def _numbered(batches, key: str, block: str, name: str, keep: bool = False):
    """The rows with the number of their key in its block, for the key; with keep the first row of a key has it too. Rows
    are sorted by key, and a key has one block."""
    counts, last = {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, at = batch[key], batch[block].to_numpy()
        new = np.zeros(len(keys), bool)
        new[_starts(keys)] = True
        new[0] = last is None or not keys[0].equals(last)
        last = keys[len(keys) - 1]
        number = np.empty(len(keys), "int32")
        for x in np.unique(at):
            own = at == x
            number[own] = counts.get(x, -1) + np.cumsum(new[own])
            counts[x] = int(number[own][-1])
        rest = batch.drop_columns([key]).append_column(name, pa.array(number))
        yield rest.append_column(key, pc.if_else(pa.array(new), keys, pa.scalar(None, keys.type))) if keep else rest


def _sent(*rows) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[*_COLUMNS, "moved"][: len(rows[0])])


def _cells(batches, to: str, sender: str):
    """The cells of blocks that get messages: in u the numbers of the sums that answers count for, ascending, in v the places
    in the message of what they add, and in w how often, if that isn't once each.

    A learner's sum takes chances of the message's items, wrong ones before right ones; an item has two sums.
    """
    learners = to == "i"
    for t in _whole(batches, "cell"):
        ends = np.append(_starts(t["cell"].combine_chunks()), t.num_rows)
        i, j, x, y, right = (t[c].to_numpy() for c in (to, sender, "x", "y", "correct"))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            own, other = (x, y) if learners else (y, x)
            distinct, place = np.unique(other[lo:hi], return_inverse=True)
            size, r = len(distinct), right[lo:hi].astype("int64")
            row, col, width = (own[lo:hi].astype("int64"), place + size * r, 2 * size) if learners else (2 * own[lo:hi].astype("int64") + r, place, size)
            code, n = np.unique(row * width + col, return_counts=True)
            bytes_ = lambda v: v.astype("<u4").tobytes()
            yield _sent((int(i[lo]), int(j[lo]), CELL, bytes_(code // width), bytes_(code % width), None if n.max() == 1 else bytes_(n)))


def _starting(batches):
    """The first parameters of blocks of items, from rows (j, b) in the order of the items' numbers."""
    for t in _whole(batches, "j"):
        ends = np.append(_starts(t["j"].combine_chunks()), t.num_rows)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            b = t["b"].slice(lo, hi - lo).to_numpy()
            yield _sent((t["j"][lo].as_py(), -1, STATE, np.ones(len(b)).tobytes(), b.astype("<f8").tobytes(), None))


def _by_block(batches):
    """(block, its rows one after another), for rows that are sorted by block."""
    rows = (tuple(c[k].as_py() for c in batch.columns) for batch in batches for k in range(batch.num_rows))
    return itertools.groupby(rows, lambda r: r[0])


class _Sums:
    """Sums at each quadrature point, by number, that grow with the numbers met."""

    def __init__(self, points: int, held: int):
        self.all, self.size, self.held = np.zeros((points, 0)), 0, held

    def add(self, cell: tuple, terms) -> np.ndarray:
        """Adds what terms(point) has for the answers of a cell; returns the different numbers that they count for."""
        row, col = (np.frombuffer(v, "<u4").astype("int64") for v in cell[3:5])
        n = None if cell[5] is None else np.frombuffer(cell[5], "<u4").astype("float64")
        self.size = max(self.size, int(row[-1]) + 1)
        if self.size > self.all.shape[1]:
            self.all = np.pad(self.all, ((0, 0), (0, max(self.size, 2 * self.all.shape[1]) - self.all.shape[1])))
        parts = []
        for lo in range(0, len(row), self.held):
            new = np.append(True, np.diff(row[lo : lo + self.held]) > 0)
            parts.append((slice(lo, lo + self.held), row[lo : lo + self.held][new], np.cumsum(new) - 1))
        for q in range(len(self.all)):
            values = terms(q)
            for at, numbers, run in parts:
                each = values[col[at]]
                self.all[q, numbers] += np.bincount(run, each if n is None else each * n[at])
        distinct = [numbers for _, numbers, _ in parts]
        return distinct[0] if len(distinct) == 1 else np.unique(np.concatenate(distinct))

    def found(self) -> np.ndarray:
        return self.all[:, : self.size]


def _posteriors(batches, places: np.ndarray, weights: np.ndarray, held: int):
    """The posteriors of blocks of learners, a message for each block of items with those of the learners in the cell."""
    low, high = np.log(TINY), np.log1p(-TINY)
    for to, rows in _by_block(batches):
        sums, met, message = _Sums(len(places), held), {}, None
        for r in rows:
            if r[2] == MESSAGE:
                message = r
                continue
            if message is None or message[1] != r[1]:
                raise ValueError(f"block {to} has no parameters of block {r[1]}")
            a, b = (np.frombuffer(v, "<f8") for v in message[3:5])

            def logs(q, a=a, b=b):
                z = a * (places[q] - b)
                with np.errstate(over="ignore"):
                    right = -np.log1p(np.exp(-z))
                return np.clip(np.concatenate([right - z, right]), low, high)

            met[r[1]] = sums.add(r, logs).astype("uint32")
        logs = sums.found() + np.log(weights)[:, None]
        post = np.exp(logs - logs.max(0))
        post = (post / post.sum(0)).astype("<f4")
        for j, numbers in met.items():
            yield _sent((j, to, MESSAGE, post[:, numbers].tobytes(), None, None))


def _new_items(batches, points: int, places: np.ndarray, newton: int, held: int):
    """The new parameters of blocks of items, and a message for each block of learners with those of the items in the cell.

    Without Newton steps there are no posteriors yet and the parameters go out as they come.
    """
    for to, rows in _by_block(batches):
        sums, met, message, state = _Sums(points, held), {}, None, None
        for r in rows:
            if r[2] == STATE:
                state = r
            elif r[2] == MESSAGE:
                message = r
            elif newton:
                if message is None or message[1] != r[1]:
                    raise ValueError(f"block {to} has no posteriors of block {r[1]}")
                post = np.frombuffer(message[3], "<f4").reshape(points, -1)
                met[r[1]] = np.unique(sums.add(r, lambda q, post=post: post[q].astype("float64")) // 2).astype("uint32")
            else:
                met[r[1]] = np.unique(np.frombuffer(r[3], "<u4") // 2)
        a, b = (np.frombuffer(v, "<f8") for v in state[3:5])
        moved = 0.0
        if newton:
            both = np.zeros((points, 2 * len(a)))
            both[:, : sums.size] = sums.found()
            new_a, new_b = np.empty(len(a)), np.empty(len(b))
            for lo in range(0, len(a), 1000):  # as many as the caches hold
                own = slice(lo, lo + 1000)
                right, wrong = both[:, 1::2][:, own].T, both[:, 0::2][:, own].T
                new_a[own], new_b[own] = fit_item(right, right + wrong, places, a[own], b[own], newton)
            moved = float(max(np.abs(new_a - a).max(), np.abs(new_b - b).max()))
            a, b = new_a, new_b
        yield _sent((to, -1, STATE, a.tobytes(), b.tobytes(), None, moved))
        for i, numbers in met.items():
            yield _sent((i, to, MESSAGE, a[numbers].tobytes(), b[numbers].tobytes(), None, None))


def _unpacked(batches):
    for batch in batches:
        for r in batch.to_pylist():
            a, b = (np.frombuffer(r[c], "<f8") for c in ("u", "v"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), r["to"], "int32")), pa.array(np.arange(len(a), dtype="int32")), pa.array(a), pa.array(b)], names=["j", "y", "a", "b"])


def fit_item(r: np.ndarray, m: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """a and b that make r right of m expected answers at the places most likely; one row for each item.

    Newton steps on slope and intercept of the logit, which is concave in both; slopes stay in [0.2, 3]. It ends before
    the last step where none moves any more.
    """
    slope, cut_ = a.copy(), -a * b
    for _ in range(steps):
        before = slope, cut_
        p = 1 / (1 + np.exp(-(slope[:, None] * places + cut_[:, None])))
        e, w = r - m * p, m * p * (1 - p) + 1e-12
        g0, g1 = e.sum(1), (e * places).sum(1)
        h00, h01, h11 = w.sum(1), (w * places).sum(1), (w * places * places).sum(1)
        det = np.maximum(h00 * h11 - h01 * h01, 1e-9)
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = np.maximum(1.0, np.maximum(np.abs(d0), np.abs(d1)))
        cut_, slope = cut_ + d0 / size, np.clip(slope + d1 / size, 0.2, 3.0)
        if max(np.abs(slope - before[0]).max(), np.abs(cut_ - before[1]).max()) < 1e-12:
            break
    return slope, np.clip(-cut_ / slope, -4.0, 4.0)
