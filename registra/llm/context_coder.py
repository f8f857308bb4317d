"""Adaptive context-mixing range coder for token ids, run over many independent blocks side by side.

A block starts from nothing. Each id is coded in up to three steps:
  1. The ids that followed the same last two ids (order 2) and the same last id (order 1) name a candidate. Whether it
     comes is one binary decision. Its log-odds are mixed from what three sources have learned: order 2's confidence,
     order 1's confidence and agreement, and the candidate's own frequency (order 0); each outcome corrects all three.
  2. Otherwise the id is coded by its order-0 frequency in the block so far,
  3. and an id that is new in the block by an escape and its 16 bits.
Intervals go to a range coder with 16-bit digits. Encoder and decoder share `_Model`; all arithmetic that decides
about intervals is exact.

All blocks of a call advance together, one id a step: every NumPy call works on one id of each block, and tables hold
the blocks' entries for one place next to each other. Frequencies are counted at once but enter the cumulative table at
steps that grow apart; an id met again before that is escaped again.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

#: Ids of one block at most: a place in a block's alphabet has 12 bits.
BLOCK = 4095
#: Ids are coded as 16-bit numbers.
IDS = 1 << 16
#: Hash slots of order 2 in a block, and the highest confidence of a candidate.
SLOTS = 1 << 11
SURE = 15

_STEP, _NEW = 4, 3
#: Scale of cumulative frequencies (bits), of chances, and of log-odds (units of 1/256).
_TOTAL, _ONE, _EDGE = 15, 1 << 16, 2047
_LEARN = 9
_ROWS = 32
_SQUASH = np.array([round(_ONE / (1 + math.exp(-x / 256))) for x in range(-_EDGE, _EDGE + 1)], dtype=np.int64)
#: What the same candidate once more adds to its state of a first time, by the difference between its state and that; nothing for another candidate.
_SURER = np.array([min(x + 1, SURE - 1) if x < SURE else 0 for x in range(1 << 16)], dtype=np.uint16)
#: Class of a frequency: its length in bits.
_CLASS = np.array([min(15, x.bit_length()) for x in range(1 << 16)], dtype=np.int64)


class _Model:
    """What the blocks have seen; the same for encoder and decoder. Places in a block's alphabet start with 1, 0 is the escape."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.lanes, self.lane = lanes, np.arange(lanes, dtype=np.int64)
        # One more than a block has ids: places go up to their number.
        self.rows = 1 << steps.bit_length()
        self.count = np.zeros((self.rows, lanes), dtype=np.uint16)
        self.count[0] = _NEW
        self.upto = np.full((self.rows + 1, lanes), (1 << 16) - 1, dtype=np.uint16)
        self.known = np.ones(lanes, dtype=np.int64)
        self.order1 = np.zeros(self.rows * lanes, dtype=np.uint16)
        self.order2 = np.zeros(SLOTS * lanes, dtype=np.uint16)
        # Log-odds by confidence of order 2 (16), confidence and agreement of order 1 (32), frequency class (16), scaled by 64.
        sure = (np.arange(16) - 8) * 3000
        self.odds = np.tile(np.concatenate([sure, sure - 12000, sure + 4000, sure * 0]), lanes).astype(np.int64)
        self.cell = self.lane * 64
        self.cell_one, self.cell_count = self.cell + 16, self.cell + 48
        self.last, self.hashed, self.part = self.lane.copy(), np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.flat_count, self.flat_upto = self.count.ravel(), self.upto.ravel()
        self.next = 0

    def rebuild(self, step: int, active: int) -> None:
        """Bring the cumulative table up to date, if it is time."""
        if step < self.next:
            return
        self.next = step + max(8, step >> 3)
        self.ready = self.known.copy()
        used = int(self.ready[:active].max())
        upto = self.upto[1 : used + 1, :active]
        np.cumsum(self.count[:used, :active], axis=0, dtype=np.uint16, out=upto)
        top = upto[-1].astype(np.float64)
        self.upto[0, :active] = 0
        # A part of the rows at a time, for the sake of the wide numbers in between.
        wide = np.empty((_ROWS, active))
        for low in range(0, used - 1, _ROWS):
            rows = upto[low : min(used - 1, low + _ROWS)]
            part = np.multiply(rows, float(1 << _TOTAL), out=wide[: len(rows)])
            # Divided last: a block's own top is exact, whatever the others have seen.
            rows[:] = np.divide(part, top, out=part)
        self.upto[used, :active] = 1 << _TOTAL
        self.half = 1 << (used.bit_length() - 1)

    def predict(self, active: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidate and its chance (of 65536) in each block."""
        lanes, lane = self.lanes, self.lane[:active]
        self.slot = (self.hashed[:active] & (SLOTS - 1)) * lanes + lane
        self.one, self.two = self.order1.take(self.last[:active]), self.order2.take(self.slot)
        one = self.one.astype(np.int64)
        chosen = np.where(self.two, self.two, self.one).astype(np.int64)
        sure = (self.two & SURE).astype(np.int64)
        candidate = chosen >> 4
        same = (one ^ chosen) < 16
        seen = _CLASS.take(self.flat_count.take(candidate * lanes + lane))
        self.cells = (sure + self.cell[:active], (one & SURE) + same * 16 + self.cell_one[:active], seen + self.cell_count[:active])
        self.values = [self.odds.take(c) for c in self.cells]
        self.mixed = (self.values[0] + self.values[1] + self.values[2]) >> 6
        return candidate, _SQUASH.take(self.mixed + _EDGE, mode="clip")

    def learn(self, active: int, chance: np.ndarray, hit: np.ndarray, place: np.ndarray) -> None:
        """Take in whether the candidates came, and each block's id by its place."""
        change = ((hit * _ONE) - chance) >> 5
        for cells, value in zip(self.cells, self.values, strict=True):
            self.odds[cells] = value + change
        fresh = ((place << 4) + 1).astype(np.uint16)
        for table, at, seen in ((self.order1, self.last[:active], self.one), (self.order2, self.slot, self.two)):
            # Right: surer. Wrong: the new id takes over.
            table[at] = fresh + _SURER.take(seen - fresh)
        at = place * self.lanes + self.lane[:active]
        self.flat_count[at] += _STEP
        self.hashed[:active] = self.part[:active] + place * 643
        self.part[:active] = place * 37
        self.last[:active] = at

    def add(self, lanes: np.ndarray) -> np.ndarray:
        """Places for ids that are new in these blocks."""
        place = self.known[lanes]
        self.known[lanes] = place + 1
        self.count[0, lanes] += _NEW
        return place


def block_lengths(ids: int, block: int = BLOCK) -> np.ndarray:
    """Sizes of the blocks that so many ids are cut into: at most one apart, longer ones first."""
    blocks = -(-ids // block)
    return np.array([ids // blocks + (i < ids % blocks) for i in range(blocks)], dtype=np.int64)


class _Encoder:
    """Range coder of all blocks: what a block emits are 16-bit digits, some with a carry for the one before."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, dtype=np.int64)
        self.lanes: list[np.ndarray] = []
        self.digits: list[np.ndarray] = []

    def emit(self, lanes: np.ndarray) -> None:
        """Bring the ranges of these blocks back to 32 bits and more."""
        while True:
            lanes = lanes[self.range.take(lanes) < 1 << 32]
            if not len(lanes):
                return
            low = self.low.take(lanes)
            self.lanes.append(lanes.astype(np.uint16))
            self.digits.append((low >> 32).astype(np.uint32))
            self.low[lanes] = (low & 0xFFFFFFFF) << 16
            self.range[lanes] <<= 16

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """All digits, block after block, and the number of each block's."""
        every = np.arange(len(self.low), dtype=np.uint16)
        lanes = np.concatenate([*self.lanes, every, every, every])
        tail = [x.astype(np.uint32) for x in (self.low >> 32, self.low >> 16 & 0xFFFF, self.low & 0xFFFF)]
        digits = np.concatenate([*self.digits, *tail])
        self.lanes, self.digits = [], []
        counts = np.bincount(lanes, minlength=len(every))
        digits = digits[np.argsort(lanes, kind="stable")]
        del lanes
        while (over := np.flatnonzero(digits > 0xFFFF)).size:
            carry = digits[over] >> 16
            digits[over] &= 0xFFFF
            digits[over - 1] += carry
        return digits.astype("<u2"), counts


def encode(ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, bytes]]:
    """Check sum and coded bytes of each block; `ids` are those of all blocks (below 65536), one after another."""
    lanes = len(lengths)
    if not lanes:
        return []
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # The distinct ids of all blocks, and the place of each in each block, 0 where it has none.
    there, number = np.zeros(IDS, dtype=bool), np.zeros(IDS, dtype=np.int32)
    there[ids] = True
    distinct = np.flatnonzero(there)
    number[distinct] = np.arange(len(distinct)) * lanes
    numbers = number[ids]
    place_of = np.zeros(len(distinct) * lanes, dtype=np.uint16)
    model, coder = _Model(lanes, int(lengths[0])), _Encoder(lanes)
    for step in range(int(lengths[0])):
        active = lanes if step < int(lengths[-1]) else int(np.count_nonzero(lengths > step))
        model.rebuild(step, active)
        at = starts[:active] + step
        own = numbers.take(at) + model.lane[:active]
        place = place_of.take(own).astype(np.int64)
        candidate, chance = model.predict(active)
        hit = (candidate == place) & (place > 0)
        size = coder.range[:active]
        bound = (size >> 16) * chance
        missed = np.flatnonzero(~hit)
        size = np.where(hit, bound, size - bound)
        if len(missed):
            wanted = place.take(missed)
            wanted[wanted >= model.ready.take(missed)] = 0
            cell = wanted * lanes + missed
            low, high = model.flat_upto.take(cell).astype(np.int64), model.flat_upto.take(cell + lanes).astype(np.int64)
            rest = size.take(missed)
            unit = rest >> _TOTAL
            coder.low[missed] += bound.take(missed) + unit * low
            size[missed] = unit * (high - low)
        coder.range[:active] = size
        coder.emit(model.lane[:active])
        if len(missed) and not wanted.all():
            new = missed[wanted == 0]
            unit = coder.range.take(new) >> 16
            coder.low[new] += unit * ids.take(at.take(new)).astype(np.int64)
            coder.range[new] = unit
            coder.emit(new)
            place[new] = model.add(new)
            place_of[own.take(new)] = place.take(new)
        model.learn(active, chance, hit, place)
    # The tables are the larger part of what is held here.
    del model, place_of, numbers, number, own, place
    digits, counts = coder.finish()
    cuts = np.cumsum(counts)
    narrow = ids.astype("<u2")
    return [(zlib.crc32(narrow[a:b].tobytes()), digits[y - n : y].tobytes()) for a, b, y, n in zip(starts, ends, cuts, counts, strict=True)]


class _Decoder:
    def __init__(self, payloads: list[bytes]) -> None:
        sizes = np.array([len(p) // 2 for p in payloads], dtype=np.int64)
        # A damaged block may be read past its end; its check sum tells.
        self.digits = np.frombuffer(b"".join(payloads), dtype="<u2")
        self.at = np.cumsum(sizes) - sizes
        self.range = np.full(len(sizes), (1 << 48) - 1, dtype=np.int64)
        self.code = np.zeros(len(sizes), dtype=np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self.digits[self.at]
            self.at += 1

    def read(self, lanes: np.ndarray) -> None:
        while True:
            lanes = lanes[self.range.take(lanes) < 1 << 32]
            if not len(lanes):
                return
            at = self.at.take(lanes)
            self.code[lanes] = self.code.take(lanes) << 16 | self.digits.take(at, mode="clip")
            self.at[lanes] = at + 1
            self.range[lanes] <<= 16


def _find(model: _Model, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place whose order-0 interval holds a value, by halving; rows not in use are above all values."""
    cell, step = lanes.copy(), model.half * model.lanes
    value = value.astype(np.uint16)
    while step >= model.lanes:
        above = cell + step
        np.putmask(cell, model.flat_upto.take(above) <= value, above)
        step >>= 1
    return cell // model.lanes


def decode(payloads: list[bytes], lengths: np.ndarray, checks: list[int]) -> np.ndarray:
    """The ids of blocks; raises ValueError where a block is not what its check sum says."""
    lanes = len(lengths)
    if not lanes:
        return np.zeros(0, dtype=np.int64)
    if any(len(p) % 2 or len(p) < 6 for p in payloads):
        raise ValueError("a block is cut short")
    ends = np.cumsum(lengths)
    starts = ends - lengths
    ids = np.zeros(int(ends[-1]), dtype=np.uint16)
    model, coder = _Model(lanes, int(lengths[0])), _Decoder(payloads)
    alphabet = np.zeros(model.rows * lanes, dtype=np.uint16)
    for step in range(int(lengths[0])):
        active = lanes if step < int(lengths[-1]) else int(np.count_nonzero(lengths > step))
        model.rebuild(step, active)
        place, chance = model.predict(active)
        size, code = coder.range[:active], coder.code[:active]
        bound = (size >> 16) * chance
        hit = code < bound
        missed = np.flatnonzero(~hit)
        size = np.where(hit, bound, size - bound)
        if len(missed):
            rest = code.take(missed) - bound.take(missed)
            unit = size.take(missed) >> _TOTAL
            found = _find(model, missed, np.minimum(rest // unit, (1 << _TOTAL) - 1))
            cell = found * lanes + missed
            low, high = model.flat_upto.take(cell).astype(np.int64), model.flat_upto.take(cell + lanes).astype(np.int64)
            code[missed] = rest - unit * low
            size[missed] = unit * (high - low)
            place[missed] = found
        coder.range[:active] = size
        coder.read(model.lane[:active])
        if len(missed) and not found.all():
            new = missed[found == 0]
            unit = coder.range.take(new) >> 16
            value = np.minimum(coder.code.take(new) // unit, IDS - 1)
            coder.code[new] -= unit * value
            coder.range[new] = unit
            coder.read(new)
            place[new] = model.add(new)
            alphabet[place.take(new) * lanes + new] = value
        model.learn(active, chance, hit, place)
        ids[starts[:active] + step] = alphabet.take(model.last[:active])
    for a, b, check in zip(starts, ends, checks, strict=True):
        if zlib.crc32(ids[a:b].astype("<u2").tobytes()) != check:
            raise ValueError("a block does not match its check sum")
    return ids
