"""Parameters of knowledge tracing fitted for all points at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, fold_segments
from .learner import BKT

NAMES = ["p_l0", "p_t", "p_g", "p_s"]
#: Range of parameters, what guess and slip are scaled to if they add up to 1, and step of differences.
FLOOR, JOINT, STEP = 1e-3, 0.99, 1e-4


def chain_likelihood(answers: list[str], params: np.ndarray) -> np.ndarray:
    """Log-likelihood of each chain of answers ('1' right, '0' wrong) under each of its rows of parameters.

    params is (chains, variants, 4). All chains of a batch go on together, one answer at a time, the longest first, so
    that those which have ended drop off the end.
    """
    order = np.argsort([-len(x) for x in answers], kind="stable")
    known, t, g, s = (params[order, :, i] for i in range(4))
    known, log = known.copy(), np.zeros(known.shape)
    lengths = np.array([len(answers[i]) for i in order])
    flat = np.frombuffer("".join(answers[i] for i in order).encode(), dtype=np.uint8) == ord("1")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for j in range(lengths[0] if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -j, side="left"))  # chains longer than j
        right = flat[starts[:n] + j][:, None]
        p, a, b = known[:n], np.where(right, 1 - s[:n], s[:n]), np.where(right, g[:n], 1 - g[:n])
        chance = p * a + (1 - p) * b
        log[:n] += np.log(np.maximum(chance, 1e-12))
        after = p * a / np.maximum(chance, 1e-12)
        known[:n] = np.clip(after + (1 - after) * t[:n], 1e-12, 1 - 1e-12)
    out = np.empty(log.shape)
    out[order] = log
    return out


def project(params: np.ndarray) -> np.ndarray:
    """Parameters in (0, 1) with guess and slip adding up to less than 1; the last axis holds NAMES."""
    p = np.clip(params, FLOOR, 1 - FLOOR)
    total = p[..., 2] + p[..., 3]
    scale = np.where(total >= 1, JOINT / total, 1.0)
    p[..., 2], p[..., 3] = p[..., 2] * scale, p[..., 3] * scale
    return p


def variants(at: np.ndarray) -> np.ndarray:
    """(n, 9, 4): parameters and, for each of them, a small step up and one down."""
    moves = np.concatenate([np.zeros((1, 4)), np.repeat(np.eye(4), 2, axis=0) * np.tile([STEP, -STEP], 4)[:, None]])
    return at[:, None, :] + moves


def ascend(state: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """One step of each point from `log`, the mean log-likelihood of its variants.

    A place that is no worse is taken, with a longer step ahead; from one that is worse the point goes back and halves
    its step. A point is done when a step gains less than the tolerance or has become too short.
    """
    log = np.stack(state["log"])
    tried, at, grad = np.stack(state["tried"]), np.stack(state["at"]), np.stack(state["grad"])
    best, step = state["best"].to_numpy(float), state["step"].to_numpy(float)
    better = log[:, 0] >= best
    gain = np.where(better, log[:, 0] - best, np.inf)
    at = np.where(better[:, None], tried, at)
    grad = np.where(better[:, None], (log[:, 1::2] - log[:, 2::2]) / (2 * STEP), grad)
    step = np.where(better, np.minimum(step * 1.5, 10.0), step / 2)
    done = (gain < tolerance) | (step < 1e-6)
    out = state[["point", "chains", "answers"]].copy()
    return out.assign(tried=list(project(at + step[:, None] * grad)), at=list(at), grad=list(grad), best=np.where(better, log[:, 0], best), step=step, done=done)


def fit_tracing(answers: DataFrame, rounds: int = 60, tolerance: float = 1e-6, least: int = 1) -> DataFrame:
    """(kp, p_l0, p_t, p_g, p_s, log_likelihood, chains, answers) of each point with at least so many answers.

    answers: learner, kp, ts, event_id, correct. A point's likelihood is that of all its learners, each of which is a
    chain of its own. All points climb together by finite differences: a round takes the likelihood of a point's
    parameters and of eight neighbours in one pass over the chains. Chains are strings of one byte an answer, put
    together from days; chains of a point that are alike are counted, not repeated. log_likelihood is never below that
    of the starting values. Answers without a mark, learner or point take no part; an empty table gives no rows.
    """
    told = answers.where("correct is not null and kp is not null and learner is not null")
    mark = lambda rows: F.array_join(F.transform(rows, lambda x: F.when(x["correct"], "1").otherwise("0")), "")
    days = fold_segments(told, ["kp", "learner"], ["ts", "event_id"], ["correct"], mark)
    chains = days.select(F.col("kp").alias("point"), F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("chain"))
    chains = cut(chains.groupBy("point", "chain").agg(F.count("*").alias("n")))
    kind = chains.schema["point"].dataType.simpleString()
    start = F.array(*(F.lit(float(BKT[k])) for k in NAMES))
    total = chains.groupBy("point").agg(F.sum("n").alias("chains"), F.sum(F.col("n") * F.length("chain")).alias("answers")).where(F.col("answers") >= least)
    state = cut(total.select("point", "chains", "answers", start.alias("tried"), start.alias("at"), F.array(*[F.lit(0.0)] * 4).alias("grad"), F.lit(float("-inf")).alias("best"), F.lit(0.5).alias("step"), F.lit(False).alias("done")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            log = chain_likelihood(pdf["chain"].tolist(), variants(np.stack(pdf["tried"]))) * pdf["n"].to_numpy()[:, None]
            part = pd.DataFrame(log, columns=[f"l{i}" for i in range(9)]).groupby(pdf["point"].to_numpy()).sum()
            yield part.rename_axis("point").reset_index()

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield ascend(pdf, tolerance)

    for _ in range(rounds):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        parts = chains.join(open_.select("point", "tried"), "point").mapInPandas(sums, f"point {kind}, " + ", ".join(f"l{i} double" for i in range(9)))
        logs = parts.groupBy("point").agg(*(F.sum(f"l{i}").alias(f"l{i}") for i in range(9)))
        mean = F.array(*(F.col(f"l{i}") / F.col("answers") for i in range(9)))
        moved = open_.join(logs, "point").withColumn("log", mean).drop(*(f"l{i}" for i in range(9)))
        state = cut(state.where("done").unionByName(moved.mapInPandas(climb, state.schema)))
    return state.select(F.col("point").alias("kp"), *(F.col("at")[i].alias(k) for i, k in enumerate(NAMES)), (F.col("best") * F.col("answers")).alias("log_likelihood"), "chains", "answers")
