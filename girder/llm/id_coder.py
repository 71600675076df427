"""An adaptive range coder for token ids, vectorized over blocks in numpy integer arithmetic.

Each block of up to 1024 ids is coded on its own, from a reset model, and carries a checksum. Two tables predict the next id
from the last two ids and from the last one; a candidate's chance is mixed, in the logistic domain, from three adaptive
estimates: by the order-2 entry's record, by the order-1 entry's record (and whether both agree), and by the order-0 class
of the candidate. A hit takes that chance of the range; the rest is parted by an adaptive order-0 distribution of the id's
magnitude class, and a class's part evenly by the id's lower bits. So an id is one step of a carry-less range coder of 64 bits
that emits 16-bit words.

All blocks of a frame take each step together; nothing is floating point, so frames decode alike on any machine.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1024
SLOTS = 512
CLASSES = 17
NONE = 0xFFFF
MAGIC = b"GIDC2\0\0\0"
FINE = 31  # bits of one step: 16 of decisions, 15 of an id's lower bits
U = np.uint64
_WORD, _TOP, _BOT, _UNIT = U(16), U(1 << 48), U(1 << 32), U(FINE)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Logistic function over -2047..2047 (256 a unit) and its inverse over 12-bit chances, in integers."""
    # fixed values: the logistic function times 4096 at -8..8, interpolated between
    knots = [1, 4, 10, 27, 74, 194, 488, 1102, 2048, 2994, 3608, 3902, 4022, 4069, 4086, 4092, 4095]
    x = np.arange(4096) - 2048
    at, part = (x + 2048) >> 8, (x + 2048) & 255
    wide = np.array([*knots, 4095])
    squash = np.clip((wide[at] * (256 - part) + wide[at + 1] * part + 128) >> 8, 1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048
    return squash.astype(np.int32), stretch.astype(np.int32)


SQUASH, STRETCH = _tables()
MOST = 4032  # the most a candidate's chance may be of 4096
MIXED = np.minimum(SQUASH, MOST)
CLASS_OF = np.array([int(i).bit_length() for i in range(NONE)] + [CLASSES], np.int32)
LOWER = np.maximum(np.arange(CLASSES + 1, dtype=np.int32) - 1, 0)  # an id's lower bits, by class
LEAST = np.where(np.arange(CLASSES + 1) > 0, 1 << LOWER, 0).astype(np.int32)  # a class's least id
SCALE, FLOOR = 14, 40  # bits of a class distribution, and what each class keeps
_FLAT = ((np.arange(CLASSES + 1) << SCALE) // CLASSES).astype(np.int16)
_EDGE = np.arange(1, CLASSES, dtype=np.int16)[:, None]
_SHARE = np.int16((1 << SCALE) - FLOOR * CLASSES)


def _pick(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`a` where the mask is -1, `b` where it is 0 (without branches, which chance would mispredict)."""
    out = a ^ b
    out &= mask
    out ^= b
    return out


class _Model:
    """The state of all blocks of a frame, one column a block: blocks that look at equal entries share cache lines.

    Row 0 of paired tables belongs to order 2, row 1 to order 1, row 2 to order 0. An entry is an id (NONE: none yet) and, in
    its four lowest bits, how often it has come true.
    """

    def __init__(self, lanes: int) -> None:
        row = np.arange(lanes)
        self.lanes, self.row, self.steps = lanes, row, 0
        self.entries = np.full(2 * SLOTS * lanes, NONE << 4, np.int32)
        self.entry_base = np.stack((row, SLOTS * lanes + row))
        self.chances = np.full(3 * 32 * lanes, 1024, np.int32)
        self.chance_base = np.stack((row, 32 * lanes + row, 64 * lanes + row))
        self.weights = np.full((3, lanes), 26_000, np.int32)
        self.cdf = np.repeat(_FLAT[:, None], lanes, 1)
        self.flat = self.cdf.reshape(-1)
        self.step = np.empty((CLASSES - 1, lanes), np.int16)
        self.last, self.older = np.zeros(lanes, np.uint32), np.full(lanes, 0x27D4EB2F, np.uint32)
        self.keys = np.empty((2, lanes), np.uint32)
        self.entry, self.at = np.empty((2, lanes), np.int64), np.empty((3, lanes), np.int64)
        self.now, self.p, self.s = np.empty((2, lanes), np.int32), np.empty((3, lanes), np.int32), np.empty((3, lanes), np.int32)
        self.state = np.empty((3, lanes), np.int32)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate and its 12-bit chance in each block."""
        keys, state = self.keys, self.state
        np.multiply(self.last, np.uint32(0x9E3779B1), out=keys[1])
        np.bitwise_xor(keys[1], self.older, out=keys[0])
        keys[0] *= np.uint32(0xC2B2AE35)
        np.right_shift(keys, np.uint32(33 - SLOTS.bit_length()), out=keys)
        keys *= np.uint32(self.lanes)
        np.add(keys, self.entry_base, out=self.entry)
        self.entries.take(self.entry, out=self.now, mode="clip")
        self.had, self.count = self.now >> 4, self.now & 15
        far, near = self.had
        known = far - NONE >> 31
        guess = _pick(known, far, near)
        np.bitwise_and(~known, 16, out=state[0])
        np.bitwise_and((near ^ guess) - 1 >> 31, 16, out=state[1])
        state[:2] += self.count
        CLASS_OF.take(guess, out=state[2], mode="clip")
        none = CLASSES - 1 - state[2] >> 31
        state *= self.lanes
        np.add(state, self.chance_base, out=self.at)
        self.chances.take(self.at, out=self.p, mode="clip")
        STRETCH.take(self.p, out=self.s, mode="clip")
        parts = self.s * (self.weights >> 4)
        dot = parts[0]
        dot += parts[1]
        dot += parts[2]
        dot >>= 12
        dot += 2048
        self.mixed = _pick(none, np.int32(1), MIXED.take(dot, mode="clip"))
        return guess, self.mixed

    def learn(self, ids: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        goal = hit & np.int32(4080)
        goal += 15
        self.chances[self.at] = self.p + ((goal - self.p) >> 4)
        goal -= self.mixed
        goal *= 3
        change = self.s * goal
        change += 512
        change >>= 10
        self.weights += change
        self.steps += 1
        if not self.steps & 7:  # eight changes cannot take a product of a weight out of 32 bits
            np.clip(self.weights, -(1 << 18), 1 << 18, out=self.weights)
        up = np.minimum(self.now + 1, self.now | 15)
        down = _pick(1 - self.count >> 31, self.now - (self.count + 1 >> 1), ids << 4)
        self.entries[self.entry] = _pick((self.had ^ ids) - 1 >> 31, up, down)
        np.multiply(self.last, np.uint32(0x85EBCA6B), out=self.older)
        self.older += np.uint32(0x27D4EB2F)
        np.copyto(self.last, ids, casting="unsafe")
        # each inner edge moves towards where the class would put it
        step, inner = self.step, self.cdf[1:CLASSES]
        np.subtract(kind.astype(np.int16), _EDGE, out=step)
        step >>= 15
        step &= _SHARE
        step += _EDGE * np.int16(FLOOR)
        step -= inner
        step >>= 4
        inner += step

    def edges(self, kind: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a class's part of `rest` begins and ends."""
        edge = kind * self.lanes + self.row
        a = rest * self.flat.take(edge, mode="clip") >> SCALE
        edge += self.lanes
        return a, rest * self.flat.take(edge, mode="clip") >> SCALE


def _first(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks a word leaves, and the word (of any block)."""
    settled, tight = (low ^ (low + span)) < _TOP, span < _BOT
    odd = tight > settled
    if odd.any():
        some = np.flatnonzero(odd)
        span[some] = (U(0) - low[some]) & (_BOT - U(1))
    go, word = settled | tight, low >> U(48)
    shift = go.astype(U) << U(4)
    low <<= shift
    span <<= shift
    return go, word


def _more(low: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Further words, until all ranges are wide: yields blocks and the word that leaves each."""
    todo = np.flatnonzero(span < _TOP)  # wider ones are neither settled nor tight
    while True:
        a, b = low[todo], span[todo]
        settled = (a ^ (a + b)) < _TOP
        some = np.flatnonzero(settled | (b < _BOT))
        if not len(some):
            return
        a, b = a[some], np.where(settled, b, (U(0) - a) & (_BOT - U(1)))[some]
        todo = todo[some]
        yield todo, a >> U(48)
        low[todo], span[todo] = a << _WORD, b << _WORD


def encode(ids: np.ndarray) -> bytes:
    """A frame of ids below 65535: a header, each block's words and checksum, then the words."""
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError("ids must be below 65535")
    n = len(ids)
    lanes = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<QI", 0, 0)
    steps = min(n, BLOCK)
    grid = np.zeros(lanes * BLOCK, np.uint16)
    grid[:n] = ids
    sums = [zlib.crc32(grid[i * BLOCK : min((i + 1) * BLOCK, n)].tobytes()) for i in range(lanes)]
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    model, room = _Model(lanes), 2 * steps + 16
    low, span = np.zeros(lanes, U), np.full(lanes, ~U(0))
    out, begin = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
    at = begin.copy()
    for step in range(steps):
        now = grid[step].astype(np.int32)
        guess, p = model.predict()
        hit = (guess ^ now) - 1 >> 31
        kind = CLASS_OF.take(now, mode="clip")
        p16 = p << 4
        a, b = model.edges(kind, 65536 - p16)
        bits = LOWER.take(kind, mode="clip")
        part = b - a << 15 - bits
        lower = now & (1 << bits) - 1
        start = ~hit & (p16 + a << 15) + lower * part
        part = _pick(hit, p16 << 15, part)
        unit = span >> _UNIT
        low += unit * start.astype(U)
        np.multiply(unit, part.astype(U), out=span)
        go, word = _first(low, span)
        out[at] = word
        at += go
        for lane, word in _more(low, span):
            out[at[lane]] = word
            at[lane] += 1
        model.learn(now, kind, hit)
    for shift in (48, 32, 16, 0):
        out[at] = (low >> U(shift)).astype(np.uint16)
        at += 1
    used = at - begin
    words = out.reshape(lanes, room)[np.arange(room) < used[:, None]]
    return MAGIC + struct.pack("<QI", n, lanes) + np.stack((used.astype(np.uint32), np.array(sums, np.uint32)), 1).astype("<u4").tobytes() + words.astype("<u2").tobytes()


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; a damaged block raises an error that names it."""
    if frame[:8] != MAGIC:
        raise ValueError("not a frame of ids")
    n, lanes = struct.unpack_from("<QI", frame, 8)
    if not n:
        return np.empty(0, np.uint16)
    table = np.frombuffer(frame, "<u4", 2 * lanes, 20).reshape(lanes, 2)
    used = table[:, 0].astype(np.int64)
    words = np.frombuffer(frame, "<u2", offset=20 + 8 * lanes)
    if len(words) != used.sum():
        raise ValueError("the frame is cut short")
    steps = min(n, BLOCK)
    grid = np.zeros((BLOCK, lanes), np.uint16)
    model = _Model(lanes)
    low, span, code = np.zeros(lanes, U), np.full(lanes, ~U(0)), np.zeros(lanes, U)
    words, at = np.concatenate((words, np.zeros(8, np.uint16))), np.cumsum(used) - used
    for _ in range(4):
        code = code << _WORD | words[at].astype(U)
        at += 1
    end = len(words) - 1
    for step in range(steps):
        guess, p = model.predict()
        p16 = p << 4
        rest = 65536 - p16
        unit = span >> _UNIT
        value = np.minimum((code - low) // unit, U((1 << FINE) - 1)).astype(np.int32)
        fine = (value >> 15) - p16
        hit = fine >> 31
        # an edge's part of `rest` is at most `fine` if the edge is at most this
        most = ((np.maximum(fine, 0) + 1 << SCALE) - 1) // rest
        kind = (model.cdf[1:CLASSES] <= most.astype(np.int16)).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int32)
        a, b = model.edges(kind, rest)
        part = b - a << 15 - LOWER.take(kind, mode="clip")
        base = p16 + a << 15
        lower = (value - base) // part
        now = _pick(hit, guess, LEAST.take(kind, mode="clip") + lower)
        kind = CLASS_OF.take(now, mode="clip")
        start = ~hit & base + lower * part
        part = _pick(hit, p16 << 15, part)
        low += unit * start.astype(U)
        np.multiply(unit, part.astype(U), out=span)
        go, _ = _first(low, span)
        code <<= go.astype(U) << U(4)
        code |= words.take(at, mode="clip") * go
        at += go
        for lane, _ in _more(low, span):
            code[lane] = code[lane] << _WORD | words[np.minimum(at[lane], end)].astype(U)
            at[lane] += 1
        model.learn(now, kind, hit)
        grid[step] = now
    out = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    for i in range(lanes):
        if zlib.crc32(out[i * BLOCK : min((i + 1) * BLOCK, n)].tobytes()) != table[i, 1]:
            raise ValueError(f"block {i} is damaged")
    return out
