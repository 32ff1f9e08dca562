"""What learners choose in a task that has the candidates of their cell: scores of blocks of learners and candidates.

A group's rows come one after another: first the candidates of each search (and turn), by zone and item, then learners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that a block holds at most, if a learner has no more candidates than that.
HELD = 400_000


def scores(search: str, theta: np.ndarray, c: Candidates, values: dict) -> np.ndarray:
    """The score of each candidate for each ability; -inf where it doesn't take part."""
    t = theta[:, None]
    near = lambda: -np.abs(c.b - t)
    if search == "b_match":
        return near()
    with np.errstate(over="ignore"):
        e = np.exp(-c.a * (t - c.b))
        p = c.c + (1 - c.c) / (1 + e)
        if search == "solvable":
            return np.where(p > values["HARD"], near(), -np.inf)
        if search == "kl_info":
            q = c.c + (1 - c.c) / (1 + np.exp(-c.a * (t + values["DELTA"] - c.b)))
            p, q = (np.clip(x, 1e-12, 1 - 1e-12) for x in (p, q))
            return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))
        s = (p - c.c) / (1 - c.c)
        info = c.a * c.a * (s * s) * (1 - p) / p
    if search == "zpd_aware":
        return np.where((p > values["HARD"]) & (p < values["EASY"]), info, -np.inf)
    if search == "progressive":
        return (1 - c.w) * c.r + c.w * info
    return info


class Candidates:
    """Candidates of one search and turn, in the order of zones and items."""

    def __init__(self, t: pa.Table):
        column = lambda name: t[name].to_numpy()
        self.items, self.zones = t["item"].combine_chunks(), t["zone"].to_pylist()
        self.a, self.b, self.c, self.r, self.w, self.k = (column(x) for x in ("a", "b", "c", "r", "w", "k"))
        self.bar = t["bar"].cast(pa.float64()).fill_null(float("-inf")).to_numpy()
        self.starts = np.array([k for k in range(len(self.zones)) if not k or self.zones[k] != self.zones[k - 1]])
        self.zone = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.zones))))
        self.rank = np.empty(len(self.items), "int64")
        self.rank[pc.sort_indices(self.items).to_numpy()] = np.arange(len(self.items))

    def blocks(self, search: str, people: People, values: dict, only: np.ndarray):
        """(which people, scores of all that they haven't taken, how many candidates of a zone they have taken)."""
        # an item that equals another one is none: items are different within a search and turn
        place = pc.index_in(people.taken, value_set=self.items)
        found = place.is_valid().to_numpy(zero_copy_only=False)
        owner, place = people.owner[found], place.filter(pa.array(found)).to_numpy(zero_copy_only=False)
        step = max(1, HELD // max(len(self.items), 1))
        for lo in range(0, len(only), step):
            rows = only[lo : lo + step]
            s = scores(search, people.theta[rows], self, values)
            s = np.trunc(s * values["UNIT"] + np.copysign(0.5, s)) / values["UNIT"]
            at = np.full(len(people.theta), -1)
            at[rows] = np.arange(len(rows))
            own = at[owner] >= 0
            s[at[owner[own]], place[own]] = -np.inf
            gone = np.bincount(at[owner[own]] * len(self.starts) + self.zone[place[own]], minlength=len(rows) * len(self.starts))
            yield rows, s, gone.reshape(len(rows), -1)


class People:
    def __init__(self, batch: pa.RecordBatch):
        self.key, self.theta, self.n, self.draw = batch["learner"], batch["theta"].to_numpy(), batch["n"].to_numpy(), batch["draw"].to_numpy()
        self.taken, self.owner = self._list(batch["taken"])
        self.outside, self.outside_owner = self._list(batch["outside"])

    @staticmethod
    def _list(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        size = pc.list_value_length(lists).fill_null(0).to_numpy()
        return lists.flatten(), np.repeat(np.arange(len(lists)), size)


class Found:
    """Places, scores and certainty of the best of some people; a place of -1 is none."""

    def __init__(self, people: int, n: int):
        self.place, self.score, self.sure = np.full((people, n), -1), np.full((people, n), np.nan), np.ones(people, bool)


def best(search: str, c: Candidates | None, people: People, only: np.ndarray, n: int, values: dict) -> Found:
    """The n best candidates of each of the people in `only`."""
    out = Found(len(people.theta), n)
    if c is None:
        return out
    for rows, s, gone in c.blocks(search, people, values, only):
        sure = (gone <= c.k[c.starts] - n).all(1)  # of items that are alike only the first k are candidates
        i = np.arange(len(rows))
        for k in range(n):
            at = s.argmax(1)
            score = s[i, at]
            some = score > -np.inf
            out.place[rows, k], out.score[rows, k] = np.where(some, at, -1), np.where(some, score, np.nan)
            sure &= score >= c.bar[at] - 1e-9
            s[i, at] = -np.inf
        out.sure[rows] = sure | values["LAST"]
    return out


def best_of_areas(c: Candidates | None, people: People, only: np.ndarray, values: dict) -> Found:
    """The best candidate, first among those of areas that aren't `outside`. The best of every zone must be sure."""
    out = Found(len(people.theta), 1)
    if c is None:
        return out
    names = pa.array([c.zones[k] for k in c.starts])
    zone = pc.index_in(people.outside, value_set=names)
    known = zone.is_valid().to_numpy(zero_copy_only=False)
    middle = np.ones((len(people.theta), len(names)), bool)
    middle[people.outside_owner[known], zone.filter(pa.array(known)).to_numpy(zero_copy_only=False)] = False
    ends = np.append(c.starts[1:], len(c.items))
    for rows, s, gone in c.blocks("by_area", people, values, only):
        i, top = np.arange(len(rows)), np.empty((len(rows), len(names)))
        at = np.empty(top.shape, "int64")
        for z, (lo, hi) in enumerate(zip(c.starts, ends, strict=True)):
            at[:, z] = lo + s[:, lo:hi].argmax(1)
            top[:, z] = s[i, at[:, z]]
        sure = ((top >= c.bar[c.starts] - 1e-9) & (gone < c.k[c.starts])).all(1)
        some = top > -np.inf
        inside = some & middle[rows]
        part = np.where(inside.any(1)[:, None], inside, some)
        score = np.where(part, top, -np.inf).max(1)
        tied = part & (top == score[:, None])
        z = np.where(tied, c.rank[at], len(c.items)).argmin(1)
        any_ = some.any(1)
        out.place[rows, 0] = np.where(any_, at[i, z], -1)
        fused = (1 - values["FUSION"]) * score + values["FUSION"] * inside.any(1)
        out.score[rows, 0] = np.where(any_, np.trunc(fused * values["UNIT"] + np.copysign(0.5, fused)) / values["UNIT"], np.nan)
        out.sure[rows] = sure | values["LAST"]
    return out


def chosen(batches, strategies: tuple[str, ...], searches: tuple[str, ...], drawn: int, values: dict):
    """(learner, strategy, item, score) of what each learner takes next; without a strategy: the learner isn't sure and has
    no other row."""
    group, held, sets = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("cell", "level", "part", "kind")], axis=1)
        ends = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1)), [batch.num_rows]])
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if lo == hi:
                continue
            if group != tuple(keys[lo, :3]):
                group, held, sets = tuple(keys[lo, :3]), [], None
            rows = batch.slice(lo, hi - lo)
            if keys[lo, 3] == 0:
                held.append(rows)
                continue
            if sets is None:
                sets, held = _sets(held, searches), []
            yield from _of(People(rows), sets, strategies, drawn, values)


def _sets(held: list, searches: tuple[str, ...]) -> dict:
    if not held:
        return {}
    t = pa.Table.from_batches(held)
    which = np.stack([t["search"].to_numpy(), t["turn"].to_numpy()], axis=1)
    ends = np.concatenate([[0], 1 + np.flatnonzero((which[1:] != which[:-1]).any(1)), [t.num_rows]])
    return {(searches[which[lo, 0]], int(which[lo, 1])): Candidates(t.slice(lo, hi - lo)) for lo, hi in zip(ends[:-1], ends[1:], strict=True)}


def _of(people: People, sets: dict, strategies: tuple[str, ...], drawn: int, values: dict):
    size = len(people.theta)
    everyone, known, sure, out = np.arange(size), {}, np.ones(size, bool), []

    def find(search: str, turn: int, only: np.ndarray, n: int = 1) -> tuple[pa.Array, Found]:
        """(items, what was found) of the people in `only`; a search of all is done once."""
        if (search, turn) in known:
            return known[search, turn]
        c = sets.get((search, turn))
        f = best_of_areas(c, people, only, values) if search == "by_area" else best(search, c, people, only, n, values)
        got = (None if c is None else c.items), f
        if len(only) == size:
            known[search, turn] = got
        return got

    def take(strategy: str, only: np.ndarray, got: tuple, k: np.ndarray | int = 0) -> np.ndarray:
        """Adds what people in `only` take of what was found; returns those that it had nothing for."""
        items, f = got
        sure[only] &= f.sure[only]
        k = k if isinstance(k, int) else k[only]
        place = f.place[only, k]
        some = place >= 0
        if some.any():
            out.append((strategy, only[some], items.take(pa.array(place[some])), f.score[only, k][some]))
        return only[~some]

    fisher = lambda only: find("fisher_info", 0, only, drawn)
    for strategy in strategies:
        if strategy == "randomesque":
            f = fisher(everyone)
            there = (f[1].place >= 0).sum(1)
            take(strategy, everyone, f, np.minimum(np.floor(people.draw * there).astype("int64"), drawn - 1))
        elif strategy == "fisher_info":
            take(strategy, everyone, fisher(everyone))
        elif strategy == "zpd_aware":
            rest = everyone
            for search in ("zpd_aware", "solvable", "b_match"):
                if len(rest):
                    rest = take(strategy, rest, find(search, 0, rest))
        elif strategy in ("progressive", "a_stratified"):
            turn = np.minimum(people.n, values["INFORMED"]) if strategy == "progressive" else _third(people.n, values["LENGTH"])
            for x in np.unique(turn):
                own = np.flatnonzero(turn == x)
                informed = strategy == "progressive" and x == values["INFORMED"]  # information alone counts
                rest = take(strategy, own, fisher(everyone) if informed else find(strategy, int(x), own))
                if strategy == "a_stratified" and len(rest):
                    take(strategy, rest, fisher(everyone))
        else:
            take(strategy, everyone, find("by_area" if strategy == "bkt_irt_fusion" else strategy, 0, everyone))
    names = ["learner", "strategy", "item", "score"]
    for strategy, who, items, score in out:
        own = sure[who]
        keep = pa.array(own)
        yield pa.RecordBatch.from_arrays([people.key.take(pa.array(who[own])), pa.array([strategy] * int(own.sum()), pa.string()), items.filter(keep), pa.array(score[own])], names=names)
    open_ = np.flatnonzero(~sure)
    if len(open_):
        kind = next(iter(sets.values())).items.type
        yield pa.RecordBatch.from_arrays([people.key.take(pa.array(open_)), pa.nulls(len(open_), pa.string()), pa.nulls(len(open_), kind), pa.nulls(len(open_), pa.float64())], names=names)


def _third(n: np.ndarray, length: int) -> np.ndarray:
    done = np.minimum(n / float(length), 1.0)
    return np.where(done < 0.33, 0, np.where(done < 0.67, 1, 2))
