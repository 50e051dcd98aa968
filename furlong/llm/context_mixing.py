"""Blocks of token ids to bytes and back: a range coder driven by mixed predictions of the next id.

Every block starts from the same state and is coded by itself. Many blocks are coded side by side,
one per lane: step t codes id t of all lanes, so each operation works on a whole array.

Ids are numbered by frequency in their file (0 is the most frequent). For each id the model looks
up what last followed the two ids before it (order 2) and the one id before it (order 1), with a
count of how often that came true. Then

* one flag says whether the longer of the two predictions is right. Its probability is mixed in the
  logistic domain from three adaptive counters, by the order-2 count, the order-1 count and the
  order-0 size of the predicted number; the weights of the mix follow the coding error;
* where order 1 names another id, a second flag says whether that one is right;
* else the number itself is coded: its length in bits by the mean of an order-0 and an order-1
  distribution, the bits below its highest one as they are (numbers of one length are about as frequent).

All state is integer, so every machine decodes what any other has encoded.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np

BITS1, BITS2 = 11, 12  # slots of the order-1 and order-2 predictions of a lane, as powers of two
SUM_BITS = 14
FULL = 1 << SUM_BITS  # the sum of a distribution
RATE = 5
EMPTY = np.zeros(0, dtype=np.int64)


def _squash_table() -> np.ndarray:
    """4096 / (1 + exp(-x / 256)) for x = -2048 ... 2047; exact decimals, so equal everywhere."""
    step = (Decimal(-1) / 256).exp()
    value, out = Decimal(8).exp(), []
    for _ in range(4096):
        out.append(int(4096 / (1 + value)))
        value *= step
    return np.clip(np.array(out, dtype=np.int32), 1, 4095)


SQUASH = _squash_table()
#: The least x whose squash is at least p, for p = 0 ... 4095.
STRETCH = (np.searchsorted(SQUASH, np.arange(4096)).clip(0, 4095) - 2048).astype(np.int32)


def _targets(n: int) -> np.ndarray:
    """What the cumulated distribution of n symbols moves to when symbol s is seen; none goes to zero."""
    i, s = np.arange(n + 1), np.arange(n)[:, None]
    return np.where(i <= s, 48 * i, FULL - 48 * (n - i)).astype(np.int16)


def _even(n: int) -> np.ndarray:
    return (np.arange(n + 1) * FULL // n).astype(np.int16)


class Encoder:
    """One range coder per lane; digits of 16 bits, carries are settled at the end."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, 1 << 32, dtype=np.int64)
        self.lane: list[np.ndarray] = []
        self.digit: list[np.ndarray] = []
        self.all = np.arange(lanes)

    def step(self, where, start: np.ndarray, size: np.ndarray, bits) -> None:
        """Narrow the lanes to [start, start + size) of 2 ** bits."""
        r = self.range[where] >> bits
        low, r = self.low[where] + r * start, r * size
        full = np.flatnonzero(r < 65536)
        if len(full):
            self.lane.append(self.all[where][full])
            head = low[full]
            self.digit.append(head >> 16)
            low[full] = (head & 65535) << 16
            r[full] <<= 16
        self.low[where], self.range[where] = low, r

    def flag(self, where, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        self.step(where, np.where(known, 0, p), np.where(known, p, 65536 - p), 16)
        return known

    def symbol(self, where, sums: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.arange(len(known))
        start = sums[at, known].astype(np.int64)
        self.step(where, start, sums[at, known + 1] - start, SUM_BITS)
        return known

    def plain(self, where, bits: np.ndarray, known: np.ndarray) -> np.ndarray:
        self.step(where, known, np.ones_like(known), bits)
        return known

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(digits of all lanes one after the other, their number per lane)."""
        self.lane += [self.all, self.all]
        self.digit += [self.low >> 16, self.low & 65535]
        lane, digit = np.concatenate(self.lane), np.concatenate(self.digit)
        digit = digit[np.argsort(lane, kind="stable")]
        over = np.flatnonzero(digit > 65535)
        while len(over):  # a lane's first digit never overflows
            digit[over] -= 65536
            digit[over - 1] += 1
            over = over[digit[over - 1] > 65535] - 1
        return digit.astype("<u2"), np.bincount(lane, minlength=len(self.low))


class Decoder:
    def __init__(self, digits: np.ndarray, counts: np.ndarray):
        self.digits = np.append(digits.astype(np.int64), [0, 0])
        self.at = np.cumsum(counts) - counts
        self.code = self.digits[self.at] << 16 | self.digits[self.at + 1]
        self.at = self.at + 2
        self.range = np.full(len(counts), 1 << 32, dtype=np.int64)
        self.all = np.arange(len(counts))

    def _narrow(self, where, code: np.ndarray, r: np.ndarray) -> None:
        full = np.flatnonzero(r < 65536)
        if len(full):
            lane = self.all[where][full]
            at = np.minimum(self.at[lane], len(self.digits) - 1)
            code[full] = code[full] << 16 | self.digits[at]
            r[full] <<= 16
            self.at[lane] += 1
        self.code[where], self.range[where] = code, r

    def flag(self, where, p: np.ndarray, known) -> np.ndarray:
        code, whole = self.code[where], self.range[where]
        part = whole >> 16
        edge = part * p
        bit = code < edge
        self._narrow(where, np.where(bit, code, code - edge), np.where(bit, edge, part * (65536 - p)))
        return bit

    def symbol(self, where, sums: np.ndarray, known) -> np.ndarray:
        code, part = self.code[where], self.range[where] >> SUM_BITS
        value = np.minimum(code // part, FULL - 1).astype(np.int16)
        out = (sums[:, 1:-1] <= value[:, None]).sum(axis=1)
        at = np.arange(len(out))
        start = sums[at, out].astype(np.int64)
        self._narrow(where, code - part * start, part * (sums[at, out + 1] - start))
        return out

    def plain(self, where, bits: np.ndarray, known) -> np.ndarray:
        code, part = self.code[where], self.range[where] >> bits
        out = np.minimum(code // part, (1 << bits) - 1)
        self._narrow(where, code - part * out, part)
        return out


class Model:
    """The predictions of some lanes over an alphabet of n numbers."""

    def __init__(self, lanes: int, n: int):
        self.sizes = max(1, n.bit_length())  # a number x has the bit length of x + 1, less one
        self.bit_length = np.floor(np.log2(np.arange(1, n + 1))).astype(np.int64) if n < 1 << 20 else None
        self.then1 = np.zeros(lanes << BITS1, dtype=np.int32)  # 8 * number + count of an order-1 prediction
        self.then2 = np.zeros(lanes << BITS2, dtype=np.int32)
        self.views = [np.full(lanes * 32, 1 << 15, dtype=np.int32) for _ in range(3)]
        self.weights = [np.full(lanes, 24_000, dtype=np.int32) for _ in range(3)]
        self.second = np.full(lanes * 8, 1 << 14, dtype=np.int32)
        self.size0 = np.tile(_even(self.sizes), (lanes, 1))
        self.size1 = np.tile(_even(self.sizes), (lanes * self.sizes, 1))
        self.to_size = _targets(self.sizes)
        self.lane = np.arange(lanes, dtype=np.int64)

    def log(self, x: np.ndarray) -> np.ndarray:
        if self.bit_length is not None:
            return self.bit_length[x]
        return np.frexp((x + 1).astype(np.float64))[1].astype(np.int64) - 1

    def code(self, coder, m: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        """Code the next number of the first m lanes; a and b are the two before it."""
        lane = self.lane[:m]
        slot1 = (lane << BITS1) + ((b * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS1))
        slot2 = (lane << BITS2) + (((a * 0x85EBCA6B + b * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BITS2))
        e1, e2 = self.then1[slot1], self.then2[slot2]
        c1, n1, c2, n2 = e1 >> 3, e1 & 7, e2 >> 3, e2 & 7
        guess = np.where(n2 > 0, c2, c1)

        # the first flag: mixed from the three views
        same = (c1 == c2).astype(np.int64)
        base = lane << 5
        places = [base + (n2 << 1) + same, base + (n1 << 1) + same, base + np.minimum(self.log(guess), 31)]
        counts = [v[p] for v, p in zip(self.views, places, strict=True)]
        views = [STRETCH[c >> 4] for c in counts]
        weights = [w[:m] for w in self.weights]
        dot = (weights[0] * views[0] + weights[1] * views[1] + weights[2] * views[2]) >> 16
        p = SQUASH[np.clip(dot, -2048, 2047) + 2048]
        hit = coder.flag(slice(0, m), (p.astype(np.int64) << 4) + 8, None if known is None else known == guess)
        aim = hit.astype(np.int32)
        error = ((aim << 12) - p) * 6
        top = aim * 65535
        for v, place, count, view, w in zip(self.views, places, counts, views, weights, strict=True):
            v[place] = count + ((top - count) >> RATE)
            w += (view * error + 32768) >> 16
            np.clip(w, -(1 << 18), 1 << 18, out=w)
        out = guess.astype(np.int64)

        # the second flag: order 1 where order 2 was wrong
        ask = np.flatnonzero(~hit & (c1 != guess))
        miss = ~hit
        if len(ask):
            place = (ask << 3) + n1[ask]
            count = self.second[place]
            true1 = coder.flag(ask, np.clip(count, 64, 65472).astype(np.int64), None if known is None else known[ask] == c1[ask])
            self.second[place] = count + ((true1 * 65535 - count) >> RATE)
            out[ask[true1]] = c1[ask[true1]]
            miss[ask[true1]] = False

        rest = np.flatnonzero(miss)
        if len(rest):
            out[rest] = self._number(coder, rest, b[rest], None if known is None else known[rest])
        self.then1[slot1] = self._learned(e1, c1, n1, out)
        self.then2[slot2] = self._learned(e2, c2, n2, out)
        return out

    @staticmethod
    def _learned(entry: np.ndarray, guess: np.ndarray, count: np.ndarray, out: np.ndarray) -> np.ndarray:
        right = guess == out
        fewer = count >> 1
        wrong = np.where(fewer > 0, (guess << 3) + fewer, (out << 3) + 1)
        return np.where(right, entry + (count < 7), wrong).astype(np.int32)

    def _number(self, coder, rest: np.ndarray, before: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        wide = rest * self.sizes + self.log(before)
        zero, one = self.size0[rest], self.size1[wide]
        size = None if known is None else self.log(known)
        size = coder.symbol(rest, zero + ((one - zero) >> 1), size)
        aim = self.to_size[size]
        self.size0[rest] = zero + ((aim - zero) >> RATE)
        self.size1[wide] = one + ((aim - one) >> RATE)
        body = None if known is None else known + 1 - (1 << size)
        value = np.zeros_like(rest)
        for shift in (16, 0) if self.sizes > 17 else (0,):  # at most 16 bits at once
            bits = np.clip(size - shift, 0, 16)
            part = None if known is None else (body >> shift) & ((1 << bits) - 1)
            value |= coder.plain(rest, bits, part) << shift
        return value + (1 << size) - 1


def encode(numbers: np.ndarray, block: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit digits, digits per block) of numbers below n, in blocks of so many numbers (the last may be shorter)."""
    lanes = -(-len(numbers) // block)
    if not lanes:
        return np.zeros(0, dtype="<u2"), EMPTY
    rows = np.zeros(lanes * block, dtype=np.int32)
    rows[: len(numbers)] = numbers
    rows = np.ascontiguousarray(rows.reshape(lanes, block).T).astype(np.int64)
    coder, model = Encoder(lanes), Model(lanes, n)
    a = b = np.zeros(lanes, dtype=np.int64)
    last = len(numbers) - (lanes - 1) * block
    for t in range(min(block, len(numbers))):
        m = lanes if t < last else lanes - 1
        model.code(coder, m, a[:m], b[:m], rows[t, :m])
        a, b = b[:m], rows[t, :m]
    return coder.finish()


def decode(digits: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The numbers of blocks with so many digits and numbers each; only the last block may be shorter."""
    lanes = len(counts)
    if not lanes:
        return EMPTY
    if (sizes[:-1] != sizes[0]).any() or sizes[-1] > sizes[0]:
        raise ValueError("only the last block may be shorter")
    rows = np.zeros((int(sizes[0]), lanes), dtype=np.int32)
    coder, model = Decoder(digits, counts), Model(lanes, n)
    a = b = np.zeros(lanes, dtype=np.int64)
    for t in range(len(rows)):
        m = lanes if t < sizes[-1] else lanes - 1
        out = model.code(coder, m, a[:m], b[:m], None)
        # a damaged block may name numbers that do not exist
        np.minimum(out, n - 1, out=out)
        rows[t, :m] = out
        a, b = b[:m], out
    return rows.T.reshape(-1)[: int(sizes.sum())]
