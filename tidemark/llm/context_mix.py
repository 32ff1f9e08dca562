"""Logistic mixing of hashed-context bit predictors: counts, mixing weights and refinement, learned online.

A token is a path of binary decisions. A word of the dictionary (all words that occur twice or more in training) is
coded by its frequency rank: a Huffman code of the rank's bit length, then the bits below the highest. Every other word
is that code's escape, then its bytes and a space, eight bits each. So all words have a code, whatever the corpus' size.

Each decision is predicted by three contexts: none, the word (byte) before, the two before. A context and a decision
share a slot of a hashed table that counts zeros and ones. The predictions' logits are combined by weights that a gate
picks by kind of decision and by how often both contexts were seen; what comes out is refined by a table of how often
ones followed such a mix. Bits of a rank behind its first SHALLOW ones tell words of like frequency apart; they have no
context, which takes a third of the work off.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Slots of a table: 2**BITS.
BITS = 20
ORDERS = 3
#: Slots of the slices that tables are added up in.
SLICE = 1 << 13
SHALLOW = 6
#: Decisions of a rank's length, of its other bits, of a spelling.
LENGTH, REST, SPELLING, DEEP = range(4)
LEVELS = 4
GATES = LEVELS * LEVELS
SETS = 3 * GATES
STEPS = 33
#: Tokens that are predicted before their counts are added.
TOGETHER = 1 << 16
RATE = 0.1
START = 0.4
DELTA = 0.4
ESCAPE = 63
#: Logits are stored in steps of 1/160, within 2 ** 12 steps, beside two bits of level.
GRAIN = 160
M = np.uint64(0xD6E8FEB86659FD93)
#: Multipliers of 32 bits: numpy does four times as many of those at once.
A, B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def level_of(n: np.ndarray) -> np.ndarray:
    """0: never seen, 1: once or twice, 2: up to fifteen times, 3: more often."""
    return (n > 0).view(np.uint8) + (n > 2).view(np.uint8) + (n > 15).view(np.uint8)


def huffman(mass: dict[int, int]) -> dict[int, tuple[list[int], list[int]]]:
    """(nodes, bits) on the way to each symbol."""
    heap = [(n, s, (s,)) for s, n in sorted(mass.items())]
    heapq.heapify(heap)
    code: dict[int, tuple[list[int], list[int]]] = {s: ([], []) for s in mass}
    node = 0
    while len(heap) > 1:
        (n, _, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        node += 1
        for bit, side in enumerate((left, right)):
            for s in side:
                code[s][0].insert(0, node)
                code[s][1].insert(0, bit)
        heapq.heappush(heap, (n + m, 1000 + node, left + right))
    return code


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * M
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


def slots(nodes: np.ndarray, context: np.ndarray | None) -> np.ndarray:
    h = (nodes if context is None else nodes ^ context[:, None]) * A
    return ((h ^ (h >> np.uint32(15))) * B >> np.uint32(32 - BITS)).ravel().astype(np.intp)


def node(kind: int, where: int, prefix: np.ndarray) -> np.ndarray:
    x = (prefix.astype(np.uint32) + np.uint32((kind * 64 + where) * 0x3C6EF372 & 0xFFFFFFFF)) * B
    return x ^ (x >> np.uint32(13))


class Tokens:
    """Tokens of a chunk with their contexts, ranks and spellings."""

    def __init__(self, ids, ranks, hashes, spelled: bytes, end: int, code: dict):
        self.ranks, self.code = ranks, code
        self.ids, self.hashes, self.end = ids, hashes.astype(np.uint64), end
        self.bits = np.where(ranks < 0, ESCAPE, np.frexp((ranks + 1).astype(np.float64))[1] - 1).astype(np.uint8)
        self.letters = np.frombuffer(spelled, np.uint8)
        stops = np.flatnonzero(self.letters == 32)
        self.starts = np.zeros(len(ranks), np.int64)
        self.lengths = np.zeros(len(ranks), np.int64)
        without = ranks < 0
        self.starts[without] = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else 0
        self.lengths[without] = np.diff(np.concatenate([[-1], stops]))
        first = np.concatenate([[32], self.letters[:-1]]).astype(np.uint64) if len(self.letters) else np.zeros(0, np.uint64)
        second = np.where(first == 32, 32, np.concatenate([first[:1], first[:-1]])).astype(np.uint64)
        self.letter_one, self.letter_two = mixed(first, 5), mixed(first * np.uint64(256) + second, 7)

    def contexts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word before some tokens, and of both before; nothing is before the beginning of a text."""
        before = np.where(some > 0, self.ids[some - 1], self.end)
        second = np.where((some > 1) & (before != self.end), self.ids[np.maximum(some - 2, 0)], self.end)
        return mixed(self.hashes[before], 1), mixed(self.hashes[before] * np.uint64(3) + self.hashes[second], 3)

    def decisions(self, some: np.ndarray):
        """(kind, which of some, nodes, bits, one, two): nodes and bits have a row for each; a token may come often."""
        kinds = self.bits[self.ids[some]]
        all_one, all_two = self.contexts(some)
        order = np.argsort(kinds, kind="stable")
        cuts = np.flatnonzero(np.diff(kinds[order])) + 1
        for own in np.split(order, cuts) if len(some) else []:
            k = int(kinds[own[0]])
            at, one, two = some[own], all_one[own], all_two[own]
            nodes, bits = self.code[k]
            if nodes:
                yield LENGTH, own, np.broadcast_to(node(LENGTH, 0, np.array(nodes)), (len(at), len(nodes))), np.broadcast_to(np.array(bits, bool), (len(at), len(bits))), one, two
            if k == ESCAPE:
                words = self.ids[at]
                n = self.lengths[words]
                place = np.repeat(self.starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
                byte = self.letters[place].astype(np.int64) | 256
                down = np.arange(8, 0, -1)
                yield SPELLING, np.repeat(own, n), node(SPELLING, 0, byte[:, None] >> down), (byte[:, None] >> (down - 1) & 1).astype(bool), self.letter_one[place], self.letter_two[place]
            elif k:
                value = self.ranks[self.ids[at]] + 1
                for kind, down in ((REST, np.arange(k, max(0, k - SHALLOW), -1)), (DEEP, np.arange(k - SHALLOW, 0, -1))):
                    if len(down):
                        yield kind, own, node(REST, k, value[:, None] >> down), (value[:, None] >> (down - 1) & 1).astype(bool), one, two


class Learner:
    """Learns from one batch of tokens after the other: each is predicted by what is known, then counted."""

    def __init__(self):
        self.counts = np.zeros((ORDERS, 1 << BITS, 2), np.int32)
        self.weights = np.full((SETS, ORDERS), START, np.float64)
        self.seen = np.zeros(SETS, np.int64)
        self.refined = np.zeros((2, 3 * LEVELS * STEPS), np.int64)

    def learn(self, tokens: Tokens, at: np.ndarray) -> None:
        for k in range(0, len(at), TOGETHER):
            counted = []
            for kind, _, nodes, bits, one, two in tokens.decisions(at[k : k + TOGETHER]):
                if kind == DEEP:
                    counted.append([slots(nodes, None) * 2 + bits.ravel()])
                else:
                    counted.append(self._mix(kind, nodes, bits.ravel(), one, two))
            for places in counted:
                for order, x in enumerate(places):
                    np.add.at(self.counts[order].reshape(-1), x, np.int32(1))

    def _mix(self, kind, nodes, bit, one, two):
        places = [slots(nodes, c) for c in (None, one, two)]
        # a slot's two counts are taken as one number of 64 bits
        n = [np.take(self.counts[t].view(np.int64).ravel(), x) for t, x in enumerate(places)]
        n = [((x & 0xFFFFFFFF).astype(np.float32), (x >> 32).astype(np.float32)) for x in n]
        logits = [np.log((ones + np.float32(DELTA)) / (zeros + np.float32(DELTA))) for zeros, ones in n]
        level = [level_of(zeros + ones) for zeros, ones in n[1:]]
        gate = level[1] * np.uint8(LEVELS) + level[0]
        at, weights = gate.astype(np.intp), self.weights[kind * GATES : (kind + 1) * GATES].astype(np.float32)
        dot = sum(np.take(weights[:, t], at) * x for t, x in enumerate(logits))
        wrong = bit - 1 / (1 + np.exp(-dot))
        both = np.bincount(cells(level[1], dot) * 2 + bit, minlength=2 * LEVELS * STEPS).reshape(-1, 2)
        own = slice(kind * LEVELS * STEPS, (kind + 1) * LEVELS * STEPS)
        self.refined[0, own] += both.sum(axis=1)
        self.refined[1, own] += both[:, 1]
        # sums by gate: its events are brought together by a radix sort of bytes
        size = np.bincount(at, minlength=GATES)
        met, slope = np.flatnonzero(size), np.zeros((GATES, ORDERS))
        starts, order = (np.cumsum(size) - size)[met], np.argsort(gate, kind="stable")
        wrong = np.take(wrong, order)
        for t, x in enumerate(logits):
            slope[met, t] = np.add.reduceat(wrong * np.take(x, order), starts)
        own = slice(kind * GATES, (kind + 1) * GATES)
        self.weights[own] += RATE * slope / np.maximum(size, 64)[:, None]
        self.seen[own] += size
        return [x * 2 + bit for x in places]

    def slices(self):
        """(order, slice, offsets, counts) of the slots that were met."""
        for order in range(ORDERS):
            for s in range((1 << BITS) // SLICE):
                part = self.counts[order, s * SLICE : (s + 1) * SLICE]
                met = np.flatnonzero(part.any(axis=1))
                if len(met):
                    n = part[met]
                    kind = "u1" if n.max() < 256 else "<u2" if n.max() < 65536 else "<u4"
                    yield order, s, met.astype("<u2").tobytes(), n.astype(kind).tobytes()

    def cells(self) -> np.ndarray:
        """Values that are added over all learners: weights by how often they were used, that number, and refinement."""
        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.refined.ravel()]).astype(np.float64)


CELLS = SETS * ORDERS + SETS + 2 * 3 * LEVELS * STEPS


def cells(level: np.ndarray, dot: np.ndarray) -> np.ndarray:
    step = np.minimum(np.maximum(dot * np.float32(2) + np.float32(STEPS // 2 + 0.5), np.float32(0)), np.float32(STEPS - 1)).astype(np.intp)
    return level * np.intp(STEPS) + step


def packed(zeros_ones: np.ndarray) -> np.ndarray:
    """Logit and level of each slot in two bytes."""
    n = zeros_ones.astype(np.float64)
    logit = np.log((n[:, 1] + DELTA) / (n[:, 0] + DELTA))
    level = level_of(zeros_ones.sum(axis=1))
    return (np.clip(np.rint(logit * GRAIN) + 2048, 0, 4095).astype("<u2") << 2) | level


class Scorer:
    """Bits of tokens under tables, weights and refinement that were added up over all learners."""

    def __init__(self, tables: np.ndarray, values: np.ndarray):
        self.tables = tables
        w, seen, refined = np.split(values, [SETS * ORDERS, SETS * ORDERS + SETS])
        seen = seen[:, None]
        self.weights = np.where(seen > 0, w.reshape(SETS, ORDERS) / np.maximum(seen, 1), START).astype(np.float32)
        n, ones = refined.reshape(2, -1)
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
        self.refined = ((ones + 8 * np.tile(centre, 3 * LEVELS)) / (n + 8)).astype(np.float32)

    def bits(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each token's code up to a spelling, and of its spelling."""
        out, spelling = np.zeros(len(tokens.ids)), np.zeros(len(tokens.ids))
        for k in range(0, len(out), TOGETHER):
            some = np.arange(k, min(k + TOGETHER, len(out)))
            for kind, own, nodes, bits, one, two in tokens.decisions(some):
                each = self._bits(kind, nodes, bits, one, two)
                if kind == SPELLING:
                    spelling[k : k + TOGETHER] += np.bincount(own, each, len(some))
                else:
                    out[k + own] += each
        return out, spelling

    def _bits(self, kind, nodes, bits, one, two) -> np.ndarray:
        if kind == DEEP:
            logit = (self.tables[0][slots(nodes, None)] >> 2).astype(np.float32) * np.float32(1 / GRAIN) - np.float32(2048 / GRAIN)
            return np.logaddexp(np.float32(0), np.where(bits.ravel(), -logit, logit)).reshape(bits.shape).sum(axis=1, dtype=np.float64) / np.log(2)
        found = [self.tables[t][slots(nodes, c)] for t, c in enumerate((None, one, two))]
        logits = [(x >> 2).astype(np.float32) * np.float32(1 / GRAIN) - np.float32(2048 / GRAIN) for x in found]
        level = [x & 3 for x in found[1:]]
        gate = (level[1] * np.uint16(LEVELS) + level[0]).astype(np.intp)
        weights, refined = self.weights[kind * GATES : (kind + 1) * GATES], self.refined[kind * LEVELS * STEPS : (kind + 1) * LEVELS * STEPS]
        dot = sum(np.take(weights[:, t], gate) * x for t, x in enumerate(logits))
        p = (1 / (1 + np.exp(-dot)) + np.take(refined, cells(level[1], dot))) * np.float32(0.5)
        p = np.minimum(np.maximum(p, np.float32(1e-6)), np.float32(1 - 1e-6))
        # p where the bit is one, 1 - p where it is zero
        return -np.log2(np.abs((1 - bits.ravel()) - p)).reshape(bits.shape).sum(axis=1)
