"""DartMinHash signatures of weighted word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle; coordinates of a signature; bands of equal numbers of coordinates.
SHINGLE = 5
COORDINATES = 96
BANDS = 24
#: Darts thrown on a whole text: enough to hit every coordinate with a chance of 98 %, else the region doubles.
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
_MEMO = 400_000
_memo: dict[bytes, bytes] = {}

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_TURNS = mix(np.arange(4096, dtype=np.uint64) * _STEP)


def word_hashes(words: list[bytes]) -> np.ndarray:
    found = list(map(_memo.get, words))
    if None in found:
        if len(_memo) > _MEMO:
            _memo.clear()
        for w in words:
            if w not in _memo:
                _memo[w] = xxhash.xxh3_64_digest(w)
        found = map(_memo.__getitem__, words)
    return np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of shingles of SHINGLE words and how often each occurs, which is its weight.

    Fewer words than a shingle make one shingle.
    """
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint32)
    h = word_hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        key = key * _STEP + h[k : k + n]
    once, counts = np.unique(mix(key), return_counts=True)
    return once, counts.astype(np.uint32)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per coordinate the id of the earliest dart that hits the region under a weight.

    A shingle's weight axis is cut into the regions [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each region has a Poisson
    process of darts along the rank axis, as dense as the region is wide and drawn from hashes of (shingle, region,
    number); a dart has a place on the weight axis and falls on one coordinate. A text's darts are those below its
    weights up to the rank at which about DARTS of them are thrown, so the work follows the number of darts and of
    shingles, not the weights, and texts that share a part of a weight share its darts.
    """
    limit = DARTS / float(weights.sum())
    out, hit = np.zeros(COORDINATES, dtype=np.uint64), np.zeros(COORDINATES, dtype=bool)
    parts = _regions(keys, weights)
    while True:
        ids, ranks = _darts(*parts, limit)
        late_first = np.argsort(-ranks, kind="stable")
        coordinate = (mix(ids ^ _A) % np.uint64(COORDINATES)).astype(np.int64)[late_first]
        out[coordinate] = ids[late_first]  # the earliest is written last
        hit[coordinate] = True
        if hit.all():
            return out
        limit *= 2


def _regions(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, width and the covered part of each region that a weight reaches into."""
    ids, width, inside = [keys], [np.ones(len(keys))], [np.ones(len(keys))]
    start = 1
    while (over := weights > start).any():
        ids.append(mix(keys[over] ^ np.uint64(start * int(_B) & 0xFFFFFFFFFFFFFFFF)))
        width.append(np.full(int(over.sum()), float(start)))
        inside.append(np.minimum(1.0, (weights[over] - start) / start))
        start *= 2
    return np.concatenate(ids), np.concatenate(width), np.concatenate(inside)


def _darts(region: np.ndarray, width: np.ndarray, inside: np.ndarray, limit: float):
    """(id, rank) of the darts of all regions up to limit that fall on the covered parts."""
    ids, ranks = [], []
    number = 0
    partly = bool((inside < 1).any())

    def take(h, rank, covered):
        if partly:
            on = _unit(mix(h ^ _B)) < covered
            h, rank = h[on], rank[on]
        ids.append(h)
        ranks.append(rank)

    if len(region) < 64:  # many darts a region: drawn at once
        most = limit * width.max()
        number = int(most + 6 * np.sqrt(most) + 10)
        h = mix(region[:, None] ^ mix(np.arange(1, number + 1, dtype=np.uint64) * _STEP)[None, :])
        at = np.cumsum(-np.log(_unit(h)) / width[:, None], axis=1)
        near = at <= limit
        take(h[near], at[near], np.broadcast_to(inside[:, None], h.shape)[near])
        more = at[:, -1] <= limit
        region, width, inside, rank = region[more], width[more], inside[more], at[more, -1]
    else:
        rank = np.zeros(len(region))
    even = bool((width == 1).all())
    while len(region):
        number += 1
        h = mix(region ^ (_TURNS[number] if number < len(_TURNS) else mix(np.array([number], dtype=np.uint64) * _STEP)))
        gap = -np.log(_unit(h))
        rank = rank + (gap if even else gap / width)
        near = rank <= limit
        region, rank, h = region[near], rank[near], h[near]
        if partly or not even:
            width, inside = width[near], inside[near]
        take(h, rank, inside)
    return np.concatenate(ids), np.concatenate(ranks)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, its number mixed in."""
    parts = sig.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        key = mix(key * _STEP + parts[:, k])
    return key.view(np.int64)


def short(sig: np.ndarray) -> bytes:
    """A byte of each coordinate, for estimates."""
    return (mix(sig ^ _B) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def packed(keys: np.ndarray, weights: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes() + weights.astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n)


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of one text's (keys, weights) with those of others, none of them empty."""
    keys, weights = one
    theirs, counts = np.concatenate([k for k, _ in others]), np.concatenate([w for _, w in others]).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, theirs), len(keys) - 1)
    both = np.where(keys[at] == theirs, np.minimum(weights[at], counts), 0)
    starts = np.cumsum([0, *(len(k) for k, _ in others[:-1])])
    shared = np.add.reduceat(both, starts)
    return shared / (int(weights.sum()) + np.add.reduceat(counts, starts) - shared)
