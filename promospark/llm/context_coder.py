"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from nothing and can be read alone. A block's ids
are numbered by its dictionary. Each id is predicted by three orders: order 2 names the
id that last followed the two ids before it, order 1 the one that followed the last id,
order 0 gives each id of the dictionary a frequency, by a tree of digits of four bits.
The prediction is the mixture ``w2 [order 2's id] + w1 [order 1's id] + w0 order 0``; the
weights adapt to what came true, apart for each pair of confidences of orders 1 and 2,
whether both name the same id, and which order was right before. A range coder turns
the chosen interval, then the digits' intervals if order 0 is left, into 16-bit words.

All blocks of a frame are coded in lock step, one id of each at a time, by arrays over
blocks ("lanes"): models and coder never look at another lane.

A block: number of ids, size of the dictionary, its bytes, words, checksum of the ids
(unsigned crc32 as little-endian unsigned 32-bit integers), the dictionary's rising ids
as compressed differences, the words (big-endian), and a checksum of all of it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, and blocks that are coded together.
BLOCK = 8192
LANES = 1024
TOTAL_BITS = 15
TOTAL = 1 << TOTAL_BITS
HEAD = struct.Struct("<IIIII")
#: How fast a row of frequencies follows what it meets, by how often it was met.
RATES = (1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5)
WEIGHT_RATE = 4
#: Slots of the tables of orders 1 and 2.
SLOTS = 8192
#: Rows of weights: confidences of the two orders, whether they agree, and what was right before.
WEIGHTS = 16 * 2 * 3

_DIGITS = np.arange(16)
#: Where the starts of the 16 frequencies move when a digit (row) comes true: all others keep at least 1.
_TARGETS = np.where(_DIGITS[None, :] <= _DIGITS[:, None], _DIGITS[None, :], TOTAL - 16 + _DIGITS[None, :]).astype(np.int16)
_SHIFTS = np.repeat(np.array(RATES, np.int16)[:, None], 16, axis=1)
_START = (_DIGITS * (TOTAL // 16)).astype(np.int16)
#: Where the ends of the weights of orders 2 and 1 move when order 2, order 1 or neither is right.
_WEIGHT_TARGETS = np.array([[TOTAL - 2, TOTAL - 1], [1, TOTAL - 1], [1, 2]], np.int16)
#: An order's confidence (0 to 3) after it was wrong, and after it was right.
_SURER = np.array([1, 1, 1, 1, 1, 2, 3, 3], np.int16)
_BYTE_SUM, _BYTE_SHIFT = np.uint64(0x0101010101010101), np.uint64(56)

LOW32, TOP = np.uint64((1 << 32) - 1), np.uint64(1 << 32)
U16, U32, UTOTAL = np.uint64(16), np.uint64(32), np.uint64(TOTAL_BITS)


class BadBlock(ValueError):
    """A block whose bytes don't have its checksum."""


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.words = np.zeros((steps + 8, lanes), np.uint32)
        self.at = np.zeros(lanes, np.int64)

    def put(self, lanes, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the lanes' ranges to [start, start + size) of ``TOTAL``; ``lanes`` is a slice or indices."""
        part = self.range[lanes] >> UTOTAL
        low = self.low[lanes] + part * start.astype(np.uint64)
        new = part * size.astype(np.uint64)
        full = np.flatnonzero(new < TOP)
        if len(full):
            which = (np.arange(lanes.stop) if isinstance(lanes, slice) else lanes)[full]
            at = self.at[which]
            if int(at.max()) + 4 >= len(self.words):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.words[at, which] = low[full] >> U32  # may hold a carry, which is passed on at the end
            self.at[which] = at + 1
            low[full] = (low[full] & LOW32) << U16
            new[full] <<= U16
        self.low[lanes] = low
        self.range[lanes] = new

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for shift in (32, 16, 0):
            word = self.low >> np.uint64(shift)
            self.words[self.at, lanes] = word if shift == 32 else word & np.uint64(0xFFFF)
            self.at += 1
        for k in range(int(self.at.max()) - 1, 0, -1):
            self.words[k - 1] += self.words[k] >> 16
        words = (self.words[:int(self.at.max())] & 0xFFFF).astype(">u2").T
        return [words[k, :n].tobytes() for k, n in enumerate(self.at.tolist())]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        n = np.array([len(p) // 2 for p in payloads])
        self.words = np.zeros((int(n.max()) + 4, len(n)), np.uint64)
        for k, payload in enumerate(payloads):
            self.words[:n[k], k] = np.frombuffer(payload, ">u2")
        self.offset = self.words[0] << U32 | self.words[1] << U16 | self.words[2]
        self.range = np.full(len(n), 1 << 48, np.uint64)
        self.at = np.full(len(n), 3, np.int64)

    def target(self, lanes) -> np.ndarray:
        """Where in ``TOTAL`` the next interval lies."""
        return np.minimum(self.offset[lanes] // (self.range[lanes] >> UTOTAL), TOTAL - 1).astype(np.int32)

    def take(self, lanes, start: np.ndarray, size: np.ndarray) -> None:
        part = self.range[lanes] >> UTOTAL
        offset = self.offset[lanes] - part * start.astype(np.uint64)
        new = part * size.astype(np.uint64)
        full = np.flatnonzero(new < TOP)
        if len(full):
            which = (np.arange(lanes.stop) if isinstance(lanes, slice) else lanes)[full]
            at = self.at[which]
            offset[full] = offset[full] << U16 | self.words[np.minimum(at, len(self.words) - 1), which]
            new[full] <<= U16
            self.at[which] = at + 1
        self.offset[lanes] = offset
        self.range[lanes] = new


class _Model:
    """Predictions of all lanes; ``levels`` digits number a block's dictionary."""

    def __init__(self, lanes: int, levels: int):
        self.levels = levels
        self.rows = sum(16 ** k for k in range(levels))
        self.first_row = [sum(16 ** k for k in range(level)) for level in range(levels)]
        self.lane = np.arange(lanes)
        self.one, self.two = np.zeros(lanes * SLOTS, np.int16), np.zeros(lanes * SLOTS, np.int16)
        self.weights = np.tile(np.array([TOTAL // 4, TOTAL // 2], np.int16), (lanes * WEIGHTS, 1))
        self.tree = np.tile(_START, (lanes * self.rows, 1))
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.right = np.full(lanes, 2, np.int64)
        self.ends = np.tile(np.array([0, 0, 0, TOTAL], np.int32), (lanes, 1))

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids named by orders 2 and 1, and the ends of the three weights, for the first ``n`` lanes."""
        last, slot = self.last[:n], self.lane[:n] * SLOTS
        self.at_one = slot + last
        self.at_two = slot + (last * 2531 + self.before[:n] * 461 & SLOTS - 1)
        one, two = self.one.take(self.at_one), self.two.take(self.at_two)
        said_one, said_two = one >> 2, two >> 2
        self.sure_one, self.sure_two = one & 3, two & 3
        row = ((self.sure_two * 4 + self.sure_one) * 2 + (said_one == said_two)) * 3 + self.right[:n]
        self.at_weight = self.lane[:n] * WEIGHTS + row
        self.own = self.weights.take(self.at_weight, 0)
        ends = self.ends[:n]
        ends[:, 1:3] = self.own
        return said_two, said_one, ends

    def learn(self, n: int, ids: np.ndarray, right: np.ndarray, is_two: np.ndarray, is_one: np.ndarray) -> None:
        """What came true: the ids, whether orders 2 and 1 named them, and by whose weight they were coded."""
        named = ids.astype(np.int16) << 2
        self.one[self.at_one] = named | _SURER.take(self.sure_one + 4 * is_one)
        self.two[self.at_two] = named | _SURER.take(self.sure_two + 4 * is_two)
        own = self.own + (_WEIGHT_TARGETS.take(right, 0) - self.own >> WEIGHT_RATE)
        self.weights.view(np.int32).ravel()[self.at_weight] = own.view(np.int32).ravel()
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.right[:n] = right

    def digit(self, lanes: np.ndarray, level: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the tree, the starts of their frequencies, and how often they were met."""
        rows = lanes * self.rows + (prefix + self.first_row[level])
        starts = self.tree.take(rows, 0)
        met = starts[:, 0].copy()  # the first start is 0; its place counts
        starts[:, 0] = 0
        return rows, starts, met

    def learn_digit(self, rows: np.ndarray, starts: np.ndarray, met: np.ndarray, digit: np.ndarray) -> None:
        starts += _TARGETS.take(digit, 0) - starts >> _SHIFTS.take(met, 0)
        starts[:, 0] = np.minimum(met + 1, len(RATES) - 1)
        self.tree.view("V32").ravel()[rows] = starts.view("V32").ravel()


def _interval(starts: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the digit's frequency in each row."""
    flat, at = starts.ravel(), np.arange(0, starts.size, 16) + digit
    low = flat.take(at).astype(np.int32)
    return low, np.where(digit < 15, flat.take(at + 1, mode="clip").astype(np.int32), TOTAL) - low


def _active(lengths: np.ndarray):
    """How many lanes have a step, for each step; lanes stand by falling length."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left") if len(lengths) else []


def _encode_lanes(ids: list[np.ndarray], levels: int) -> list[bytes]:
    """Payloads of blocks' dictionary numbers; blocks stand by falling length."""
    lengths = np.array([len(x) for x in ids])
    steps = np.zeros((int(lengths[0]), len(ids)), np.int64)
    for k, own in enumerate(ids):
        steps[:len(own), k] = own
    model, coder = _Model(len(ids), levels), _Encoder(len(ids), int(lengths[0]))
    for step, n in zip(steps, _active(lengths).tolist()):
        own = step[:n]
        two, one, ends = model.predict(n)
        is_two, is_one = two == own, one == own
        right = np.where(is_two, 0, 2 - is_one)
        flat, at = ends.ravel(), np.arange(0, 4 * n, 4) + right
        start = flat.take(at)
        coder.put(slice(0, n), start, flat.take(at + 1) - start)
        left = np.flatnonzero(right == 2)
        if len(left):
            number, prefix = own[left], np.zeros(len(left), np.int64)
            for level in range(levels):
                digit = number >> 4 * (levels - 1 - level) & 15
                rows, starts, met = model.digit(left, level, prefix)
                coder.put(left, *_interval(starts, digit))
                model.learn_digit(rows, starts, met, digit)
                prefix = prefix * 16 + digit
        model.learn(n, own, right, is_two, is_one)
    return coder.finish()


def _decode_lanes(payloads: list[bytes], lengths: np.ndarray, levels: int) -> list[np.ndarray]:
    out = np.zeros((int(lengths[0]), len(payloads)), np.int32)
    model, coder = _Model(len(payloads), levels), _Decoder(payloads)
    for step, n in zip(out, _active(lengths).tolist()):
        lanes = slice(0, n)
        two, one, ends = model.predict(n)
        target = coder.target(lanes)
        right = (target >= ends[:, 1]).astype(np.int64) + (target >= ends[:, 2])
        flat, at = ends.ravel(), np.arange(0, 4 * n, 4) + right
        start = flat.take(at)
        coder.take(lanes, start, flat.take(at + 1) - start)
        own = np.where(right == 0, two, one).astype(np.int64)
        left = np.flatnonzero(right == 2)
        if len(left):
            prefix = np.zeros(len(left), np.int64)
            for level in range(levels):
                rows, starts, met = model.digit(left, level, prefix)
                reached = (starts <= coder.target(left).astype(np.int16)[:, None]).view(np.uint64) * _BYTE_SUM >> _BYTE_SHIFT
                digit = (reached[:, 0] + reached[:, 1]).astype(np.int64) - 1
                coder.take(left, *_interval(starts, digit))
                model.learn_digit(rows, starts, met, digit)
                prefix = prefix * 16 + digit
            own[left] = prefix
        step[:n] = own
        model.learn(n, own, right, two == own, one == own)
    return [out[:n, k] for k, n in enumerate(lengths.tolist())]


def _levels(size: int) -> int:
    """Digits of a dictionary's numbers: few kinds, so that most blocks go in one lock step."""
    return 3 if size <= 16 ** 3 else 4


def _lock_step(lengths: list[int], levels: list[int], code) -> None:
    """``code`` the blocks of each number of levels together, by falling length."""
    for level in sorted(set(levels)):
        some = sorted((k for k in range(len(levels)) if levels[k] == level), key=lambda k: -lengths[k])
        code(some, level)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (uint32, ``BLOCK`` ids at most, not empty) as bytes."""
    known = [np.unique(b, return_inverse=True) for b in blocks]
    payloads: list[bytes] = [b""] * len(blocks)

    def code(some: list[int], level: int) -> None:
        for k, payload in zip(some, _encode_lanes([known[k][1] for k in some], level)):
            payloads[k] = payload

    _lock_step([len(b) for b in blocks], [_levels(len(d)) for d, _ in known], code)
    out = []
    for ids, (words, _), payload in zip(blocks, known, payloads):
        words = zlib.compress(np.diff(words, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)
        block = HEAD.pack(len(ids), len(known[len(out)][0]), len(words), len(payload), zlib.crc32(ids.astype("<u4").tobytes()))
        block += words + payload
        out.append(block + struct.pack("<I", zlib.crc32(block)))
    return out


def block_size(data, at: int) -> int:
    _, _, words, payload, _ = HEAD.unpack_from(data, at)
    return HEAD.size + words + payload + 4


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids (uint32) of each block; ``BadBlock`` where a checksum is wrong."""
    heads, known, payloads = [], [], []
    for block in blocks:
        if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise BadBlock("a block's bytes don't have its checksum")
        head = HEAD.unpack_from(block)
        heads.append(head)
        words = zlib.decompress(block[HEAD.size:HEAD.size + head[2]])
        known.append(np.cumsum(np.frombuffer(words, "<u4"), dtype=np.uint32))
        payloads.append(block[HEAD.size + head[2]:-4])
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)

    def code(some: list[int], level: int) -> None:
        lengths = np.array([heads[k][0] for k in some])
        for k, numbers in zip(some, _decode_lanes([payloads[k] for k in some], lengths, level)):
            out[k] = known[k][numbers]

    _lock_step([h[0] for h in heads], [_levels(h[1]) for h in heads], code)
    for ids, head in zip(out, heads):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[4]:
            raise BadBlock("a block's ids don't have its checksum")
    return out
