"""A context-mixing range coder for ids below 65536, in blocks that are reset and checked one by one.

Order-2 and order-1 contexts predict the next id. Where order 2 has been confirmed before, or both foresee the same and
one has, their confidences are mixed to one binary decision, whose chances begin with their logistic mix and are learned
for each pair of confidences; a confirmed order 1 then has its own. Every other id is coded in one step by order 0: how
often it stands in its block, which the block's head tells. Contexts of which none is confirmed are right too seldom to
pay for a decision. All numbers are integers or quotients below 2**17 of integers below 2**53, so any
machine decodes what another one wrote. Blocks don't depend on each other: numpy codes many at once, one lane a block, in
some 60 KB for a lane of 4,096 ids, which are numbered within their block.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Ids of a block at most, and blocks that are coded together.
BLOCK = 4096
LANES = 2048
_SLOTS = 12  # bits of a context table
_SURE = 1 << 16  # a context's entry is its confidence times this and the number of the id that it foresees
_LEAST = 1 << 32  # ranges stay between this and 2**48

_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], dtype=np.int32)
_SQUASH = np.array([max(1, min(4095, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int32)
_HEAD = struct.Struct("<II")  # different ids of a block, bytes of their compressed list


class _Shares:
    """Order 0 of all lanes: of 2**shift parts of a range, an id has count parts, beginning with first."""

    def __init__(self, counts: list[np.ndarray], sizes: list[int]):
        self.width = max(len(c) for c in counts)
        self.shift = np.array([(n - 1).bit_length() for n in sizes])
        table = np.zeros((len(sizes), self.width), np.int64)
        self.counts = []
        for row, c, n, bits in zip(table, counts, sizes, self.shift.tolist(), strict=True):
            c = (c << bits) // n
            c[np.argmax(c)] += (1 << bits) - c.sum()
            row[: len(c)] = ((np.cumsum(c) - c) << 32) + c
            self.counts.append(c)
        self.table = table.reshape(-1)  # first << 32 | count
        self.base = np.arange(len(sizes)) * self.width


class _Out:
    """Writes digits of 16 bits; a digit may hold a carry for its predecessor until the end."""

    def __init__(self, length: int, shares: _Shares):
        lanes = len(shares.base)
        self.shares, self.low, self.range = shares, np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.digits = np.zeros((lanes, length // 2 + 256), np.uint32)
        self.at = np.arange(lanes) * self.digits.shape[1]  # of each lane's next digit, in the flat array

    def room(self):
        """For 64 steps of at most 3 digits."""
        lanes, width = self.digits.shape
        rows = np.arange(lanes) * width
        if (self.at - rows).max() + 200 > width:
            self.digits = np.concatenate([self.digits, np.zeros((lanes, width // 2 + 200), np.uint32)], axis=1)
            self.at += np.arange(lanes) * (self.digits.shape[1] - width)

    def bit(self, on, p, bit):
        whole, low = self.range.take(on), self.low.take(on)
        split = (whole >> 12) * p
        low += split * ~bit
        whole = np.where(bit, split, whole - split)
        small = (whole < _LEAST).nonzero()[0]
        if len(small):
            lanes = on[small]
            self.digits.reshape(-1)[self.at[lanes]] = low[small] >> 32
            self.at[lanes] += 1
            low[small] = (low[small] & 0xFFFFFFFF) << 16
            whole[small] <<= 16
        self.range[on], self.low[on] = whole, low
        return bit

    def symbols(self, n: int):
        """A function that codes an id in each of the first n lanes, but for those that are given as done."""
        flat, s = self.digits.reshape(-1), self.shares
        low, whole, at, base, shift = self.low[:n], self.range[:n], self.at[:n], s.base[:n], s.shift[:n]
        (place, unit, part, bits), small = np.empty((4, n), np.int64), np.empty(n, bool)

        def code(got, done):
            kept = low[done], whole[done]
            np.add(base, got, out=place)
            np.right_shift(whole, shift, out=unit)
            s.table.take(place, out=part, mode="clip")
            np.bitwise_and(part, 0xFFFFFFFF, out=place)
            np.multiply(unit, place, out=whole)
            np.right_shift(part, 32, out=part)
            np.multiply(unit, part, out=unit)
            np.add(low, unit, out=low)
            low[done], whole[done] = kept
            np.less(whole, _LEAST, out=small)
            np.right_shift(low, 32, out=unit)
            flat[at] = unit
            np.multiply(unit, small, out=unit)
            np.left_shift(unit, 32, out=unit)
            np.subtract(low, unit, out=low)
            np.multiply(small, 16, out=bits)
            np.left_shift(low, bits, out=low)
            np.left_shift(whole, bits, out=whole)
            np.add(at, small, out=at)

        return code

    def finish(self) -> list[bytes]:
        self.room()
        lanes, width = self.digits.shape
        at = self.at - np.arange(lanes) * width
        rows = np.arange(lanes)
        for shift in (32, 16, 0):
            self.digits[rows, at] = (self.low >> shift) & (0x1FFFF if shift == 32 else 0xFFFF)
            at += 1
        by_place = np.ascontiguousarray(self.digits[:, : int(at.max())].T)
        by_place[np.arange(len(by_place))[:, None] >= at] = 0  # written ahead of a digit that never came
        carry = np.zeros(lanes, np.uint32)
        for k in range(len(by_place) - 1, -1, -1):
            d = by_place[k] + carry
            np.right_shift(d, 16, out=carry)
            by_place[k] = d & np.uint32(0xFFFF)
        digits = np.ascontiguousarray(by_place.T).astype(">u2")
        return [digits[i, :n].tobytes() for i, n in enumerate(at.tolist())]


class _In:
    def __init__(self, payloads: list[bytes], sizes: list[int]):
        heads = [_counts(p, n) for p, n in zip(payloads, sizes, strict=True)]
        self.ids = [ids for ids, _, _ in heads]
        self.shares = s = _Shares([c for _, c, _ in heads], sizes)
        self.slots = np.zeros((len(sizes), 1 << int(s.shift.max())), np.uint16)  # the id of each part of a range
        for row, count in zip(self.slots, s.counts, strict=True):
            row[: count.sum()] = np.repeat(np.arange(len(count)), count)
        payloads = [memoryview(p)[end:] for p, (_, _, end) in zip(payloads, heads, strict=True)]
        width = max(len(p) for p in payloads) // 2 + 8
        digits = np.zeros((len(payloads), width), np.uint16)
        for i, p in enumerate(payloads):
            digits[i, : len(p) // 2] = np.frombuffer(p, ">u2", len(p) // 2)
        self.range = np.full(len(payloads), 1 << 48, np.int64)
        self.code = (digits[:, 0].astype(np.int64) << 32) | (digits[:, 1].astype(np.int64) << 16) | digits[:, 2]
        self.digits, self.at = digits.reshape(-1), np.arange(len(payloads)) * width + 3

    def room(self):
        pass

    def bit(self, on, p, _):
        whole, code = self.range.take(on), self.code.take(on)
        split = (whole >> 12) * p
        bit = code < split
        code -= split * ~bit
        whole = np.where(bit, split, whole - split)
        small = (whole < _LEAST).nonzero()[0]
        if len(small):
            lanes = on[small]
            code[small] = (code[small] << 16) | self.digits.take(self.at[lanes], mode="clip")
            self.at[lanes] += 1
            whole[small] <<= 16
        self.range[on], self.code[on] = whole, code
        return bit

    def symbols(self, n: int):
        s, digits, slots = self.shares, self.digits, self.slots.reshape(-1)
        code, whole, at, base, shift = self.code[:n], self.range[:n], self.at[:n], s.base[:n], s.shift[:n]
        rows = np.arange(n) * self.slots.shape[1]
        (place, unit, part, bits), small = np.empty((4, n), np.int64), np.empty(n, bool)
        quotient, found, digit = np.empty(n), np.empty(n, np.uint16), np.empty(n, np.uint16)

        def decode(got, done):
            kept = code[done], whole[done], got[done]
            np.right_shift(whole, shift, out=unit)
            np.divide(code, unit, out=quotient)
            np.copyto(place, quotient, casting="unsafe")
            np.add(place, rows, out=place)
            slots.take(place, out=found, mode="clip")
            np.copyto(got, found)
            np.add(base, got, out=place)
            s.table.take(place, out=part, mode="clip")
            np.bitwise_and(part, 0xFFFFFFFF, out=place)
            np.multiply(unit, place, out=whole)
            np.right_shift(part, 32, out=part)
            np.multiply(unit, part, out=unit)
            np.subtract(code, unit, out=code)
            code[done], whole[done], got[done] = kept
            np.less(whole, _LEAST, out=small)
            np.multiply(small, 16, out=bits)
            np.left_shift(whole, bits, out=whole)
            np.left_shift(code, bits, out=code)
            digits.take(at, out=digit, mode="clip")
            np.multiply(digit, small, out=bits)
            np.add(code, bits, out=code)
            np.add(at, small, out=at)

        return decode


def _head(ids: np.ndarray, count: np.ndarray) -> bytes:
    """The different ids of a block, ascending, and how often each stands in it."""
    both = np.array([np.diff(ids, prepend=0), count], "<u2")
    packed = zlib.compress(np.ascontiguousarray(both.view("u1").reshape(-1, 2).T).tobytes(), 6)
    return _HEAD.pack(len(ids), len(packed)) + packed


def _counts(payload: bytes, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids and counts that a payload of size ids begins with, and where they end."""
    n, width = _HEAD.unpack_from(payload)
    end = _HEAD.size + width
    raw = np.frombuffer(zlib.decompress(payload[_HEAD.size : end]), "u1")
    if len(raw) != 4 * n:
        raise ValueError("a block's head is damaged")
    steps, count = np.ascontiguousarray(raw.reshape(2, -1).T).view("<u2").reshape(2, n).astype(np.int64)
    if count.sum() != size or count.min() < 1:
        raise ValueError("a block's head is damaged")
    return np.cumsum(steps), count, end


def _nearer(p: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Chances of 4096 after one more outcome; they stay between 31 and 4064."""
    return p + ((hit * np.int32(4064) + np.int32(31) - p) >> 5)


def _mixed() -> np.ndarray:
    """Chance that order 2 is right, by both confidences and whether both foresee the same: their logistic mix."""
    x = _STRETCH[200 + 240 * np.arange(16)]
    other = np.stack([-x, x], axis=1)
    return _SQUASH[np.clip((50000 * x[:, None, None] + 20000 * other) >> 16, -2047, 2047) + 2047].reshape(-1)


class _Mix:
    """Chances that each lane goes by, learned from its outcomes: of order 2 by both confidences, of order 1 by its own."""

    def __init__(self, lanes: int):
        self.both, self.one = np.tile(_mixed(), lanes), np.tile((200 + 240 * np.arange(16)).astype(np.int32), lanes)

    def decide(self, coder, sub: np.ndarray, entries: np.ndarray, got: np.ndarray, known: bool) -> np.ndarray:
        """Codes whether the contexts foresee right in the lanes sub, with their entries of orders 2 and 1. Returns the
        lanes where one does; unless the ids are known they are put into got."""
        sure, (id2, id1) = entries >> 16, entries & 0xFFFF
        same = id1 == id2
        first = (same | (sure[0] > 0)).nonzero()[0]
        open_ = ~same & (sure[1] > 0)
        done = []
        if len(first):
            on, foreseen = sub.take(first), id2.take(first)
            at = ((sure[0] << 5) + (sure[1] << 1) + same).take(first) + (on << 9)
            p = self.both.take(at)
            right = coder.bit(on, p, got.take(on) == foreseen if known else None)
            self.both[at] = _nearer(p, right)
            hit = right.nonzero()[0]
            done.append(on.take(hit))
            open_[first.take(hit)] = False
            if not known:
                got[done[0]] = foreseen.take(hit)
        second = open_.nonzero()[0]
        if len(second):
            on, foreseen = sub.take(second), id1.take(second)
            at = sure[1].take(second) + (on << 4)
            p = self.one.take(at)
            right = coder.bit(on, p, got.take(on) == foreseen if known else None)
            self.one[at] = _nearer(p, right)
            hit = right.nonzero()[0]
            done.append(on.take(hit))
            if not known:
                got[done[-1]] = foreseen.take(hit)
        return np.concatenate(done) if done else sub[:0]


#: Confidence after a context was wrong (first 16) or right (last 16) in each confidence, shifted as in an entry.
_NEXT = (np.array([*(c >> 1 for c in range(16)), *(min(c + 1, 15) for c in range(16))], np.int32)) << 16


def _grown(entry: np.ndarray, got: np.ndarray) -> np.ndarray:
    """A context's entries after the ids got: confirmed, doubted or, where nothing is left of them, replaced."""
    sure, id_ = entry >> 16, entry & 0xFFFF
    return _NEXT.take(sure + (id_ == got) * 16) + np.where(sure > 0, id_, got)


def _run(coder, lengths: list[int], ids: np.ndarray | None) -> np.ndarray:
    """Codes or, with ids None, decodes lanes of descending lengths; ids and result are (step, lane), numbers in blocks."""
    lanes, steps = len(lengths), lengths[0]
    known = ids is not None
    out = ids if known else np.zeros((steps, lanes), np.uint16)
    mix = _Mix(lanes)
    seen = np.zeros(2 * lanes << _SLOTS, np.int32)  # of each lane, order 2 and then order 1
    last, far = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # the last id, and a hash of the one before
    mask, n, t = (1 << _SLOTS) - 1, lanes, 0
    while t < steps:
        while lengths[n - 1] <= t:
            n -= 1
        last, far = last[:n], far[:n]
        base = (2 * np.arange(n) + np.array([[0], [1]])) << _SLOTS
        at, got = np.empty((2, n), np.int64), np.empty(n, np.int64)
        entries, new, got32 = np.empty((2, n), np.int32), np.empty((2, n), np.int32), np.empty(n, np.int32)
        sure, hits = np.empty(n, bool), np.empty((2, n), bool)
        until = lengths[n - 1]
        while t < until:
            coder.room()
            symbols = coder.symbols(n)
            for now in range(t, min(t + 64, until)):
                np.add(far, last, out=at[0])
                np.copyto(at[1], last)
                np.bitwise_and(at, mask, out=at)
                np.add(at, base, out=at)
                np.multiply(last, 2477, out=far)
                seen.take(at, out=entries, mode="clip")
                np.bitwise_or(entries[0], entries[1], out=new[0])
                np.greater_equal(new[0], _SURE, out=sure)
                sub = sure.nonzero()[0]
                if known:
                    np.copyto(got, out[now, :n])
                some = entries.take(sub, axis=1)
                symbols(got, mix.decide(coder, sub, some, got, known))
                if not known:
                    out[now, :n] = got
                np.copyto(got32, got, casting="unsafe")
                np.equal(entries, got32, out=hits)  # an entry without confidence is the id alone
                np.multiply(hits, np.int32(_SURE), out=new)
                np.add(new, got32, out=new)
                new[:, sub] = _grown(some, got32.take(sub))
                seen[at] = new
                np.copyto(last, got)
            t = now + 1
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids as little-endian unsigned 32-bit integers, payload) of each block.

    An id that 16 bits don't hold raises.
    """
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65535 can't be coded")
    if block > 0xFFFF:
        raise ValueError("blocks of more than 65535 ids can't be coded")
    out = []
    number = np.zeros(1 << 16, np.uint16)
    for begin in range(0, len(ids), block * LANES):
        part = ids[begin : begin + block * LANES]
        lengths = [min(block, len(part) - k) for k in range(0, len(part), block)]
        grid = np.zeros((len(lengths), lengths[0]), np.uint16)
        heads, counts, crcs = [], [], []
        for i, n in enumerate(lengths):
            own = part[i * block : i * block + n]
            many = np.bincount(own)
            different = many.nonzero()[0]
            number[different] = np.arange(len(different))
            grid[i, :n] = number[own]
            counts.append(many[different])
            heads.append(_head(different, counts[-1]))
            crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
        coder = _Out(lengths[0], _Shares(counts, lengths))
        _run(coder, lengths, np.ascontiguousarray(grid.T))
        for n, crc, head, payload in zip(lengths, crcs, heads, coder.finish(), strict=True):
            out.append((n, crc, head + payload))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of any blocks, in their order; a block that doesn't match its checksum raises."""
    done: dict[int, np.ndarray] = {}
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    for first in range(0, len(order), LANES):
        some = [i for i in order[first : first + LANES] if blocks[i][0]]
        if not some:
            continue
        coder = _In([blocks[i][2] for i in some], [blocks[i][0] for i in some])
        with np.errstate(all="ignore"):  # what a damaged lane computes doesn't count, its checksum does
            grid = np.ascontiguousarray(_run(coder, [blocks[i][0] for i in some], None).T)
        for own, row, i in zip(coder.ids, grid, some, strict=True):
            row = own.astype("<u4").take(row[: blocks[i][0]], mode="clip")
            if zlib.crc32(row.tobytes()) != blocks[i][1]:
                raise ValueError(f"block {i} is damaged")
            done[i] = row
    return np.concatenate([done[i] for i in sorted(done)]) if done else np.empty(0, "<u4")
