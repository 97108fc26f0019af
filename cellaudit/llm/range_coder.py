"""Blocks of token ids as bytes: a range coder driven by mixed predictions of orders 0 to 2.

A block holds at most ``BLOCK`` ids and is coded by itself: its model starts from nothing,
so that any block can be read, checked or lost without the others.  Its head lists the
different ids that it holds; an id is its place in that list from there on.

Three predictions are mixed before each id.  The ids that last followed the id before
(order 1) and the two ids before (order 2) are looked up, each with a confidence that
grows with every hit and is halved by every miss; counts of the block so far are the
order-0 distribution.  The weight of orders 1 and 2 is the share of hits that guesses of
the same confidence had so far in this block:

    P(id) = w2 [id = guess 2] + (1 - w2) (w1 [id = guess 1] + (1 - w1) P0(id))

An id takes the first of these shares that holds it.  Guesses and confidences follow every
id; weights and the shares of order 0, made of counts, are renewed as the block grows by
half.  All numbers that shares are made of are integers or come from single additions,
products and quotients of doubles, which are the same on every machine.

Blocks are coded side by side: step k handles the k-th id of thousands of blocks in array
operations.  The range has up to 50 bits and is moved on by 16; carries are left in the
digits and settled at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 4096
LANES = 4096
#: Fixed values of the format: head of a block, order-2 contexts, parts that order 0 shares out.
MAGIC, VERSION = b"IDRC", 1
CONTEXTS, PARTS = 4096, 4096
#: Where weights start, and their bounds.
START, LOWEST, HIGHEST = 0.25, 0.02, 0.97
#: The range's lower end.
LEAST = float(1 << 34)
_WINDOW, _DIGIT = float(1 << 50), 65536.0
#: What a confidence is changed by: two numbers for each from 0 to 7, after a miss and after a hit.
_CHANGE = np.array([0, 1, -1, 1, -1, 1, -2, 1, -2, 1, -3, 1, -3, 1, -4, 0], np.int16).view(np.uint16)
#: Constants as arrays, which take less time in each operation than Python's numbers.
_THREE, _SEVEN, _FIFTEEN = np.array(3, np.uint16), np.array(7, np.uint16), np.array(15)
#: Steps that are prepared and counted together.
_COUNTED = 64
#: Blocks of which all numbers of a kind stay in the processor's cache.
_NEAR = 32
_HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("listed", "<u2"), ("ids", "<u4"), ("kinds", "<u4"), ("digits", "<u4"), ("crc", "<u4"), ("body", "<u4")])


class BlockError(ValueError):
    """A block that is no block, or whose ids don't fit its checksum."""


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


class _Lanes:
    """The models of blocks side by side.  Lanes are in falling order of their length."""

    def __init__(self, lengths: np.ndarray, kinds: np.ndarray, slots: bool) -> None:
        n = len(lengths)
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.kinds, self.most = kinds, int(kinds.max())
        # a guess and its confidence: 12 and 3 bits; first those of order 1, then those of order 2
        self.table = np.zeros(n * (self.most + CONTEXTS), np.uint16)
        lane = np.arange(n)
        self.at_one, self.at_slot = lane * self.most, lane * PARTS
        self.at_guess = np.stack([self.at_one, n * self.most + lane * CONTEXTS])
        self.at_weight = np.stack([lane * 24 + 16, lane * 24])
        # a place for each order, confidence and agreement, and two for what missed and what hit
        self.weight, self.found = np.full(n * 24, START), np.zeros(n * 48)
        self.last, self.older = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts = np.zeros((n, self.most), np.int32)
        self.shares = np.empty(n * self.most, np.int32)
        self.slots = np.empty((n, PARTS), np.uint16) if slots else None
        self.every = np.tile(np.arange(self.most, dtype=np.uint16), min(n, _NEAR))
        self.renewed, self.next, self.counted = 0, 0, 0
        self.tried = np.empty((_COUNTED, 2, n), np.int64)
        self.moved, self.kept = np.full(n, _DIGIT), np.ones(n)

    def count(self, t: int, a: int) -> None:
        """Counts what the guesses before the t-th id were worth."""
        self.found += np.bincount(self.tried[: t - self.counted, :, :a].reshape(-1), minlength=len(self.found))
        self.counted = t

    def renew(self, t: int, a: int, rows: np.ndarray) -> None:
        """Weighs orders 1 and 2 and shares out order 0 anew by the ids before the t-th; a row is a block."""
        if t < self.next:
            if t - self.counted == _COUNTED:
                self.count(t, a)
            return
        if t:
            self.count(t, a)
            hits = self.found[1::2]
            share = (hits + START) / (self.found[0::2] + hits + 1.0)
            self.weight = np.clip(share, LOWEST, HIGHEST)
        for low in range(0, a, _NEAR):
            self._share(t, low, min(low + _NEAR, a), rows)
        self.renewed, self.next = t, t + max(32, t // 2)

    def _share(self, t: int, low: int, high: int, rows: np.ndarray) -> None:
        """Shares out order 0 of some lanes anew."""
        most, kinds, counts = self.most, self.kinds[low:high].astype(np.int32)[:, None], self.counts[low:high]
        if t:
            places = (rows[low:high, self.renewed : t] + self.at_one[: high - low, None]).reshape(-1)
            counts += np.bincount(places, minlength=counts.size).reshape(-1, most).astype(np.int32)
        # one part for each id, the others by count; what rounding leaves goes to the first id
        own = counts * (PARTS - kinds)
        own //= np.int32(max(t, 1))
        own += np.arange(most, dtype=np.int32)[None, :] < kinds
        own[:, 0] += PARTS - own.sum(axis=1, dtype=np.int32)
        if self.slots is not None:
            self.slots[low:high] = np.repeat(self.every[: own.size], own.reshape(-1)).reshape(-1, PARTS)
        # cumulated parts and an id's own in one number
        shares = np.cumsum(own, axis=1, dtype=np.int32)
        shares -= own
        shares <<= 13
        shares |= own
        self.shares[low * most : high * most] = shares.reshape(-1)

    def shared(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of order 0 of known ids start, and their widths, by step; a row is a block."""
        shares = np.empty(places.shape[::-1], np.int32)
        for i in range(0, len(places), _NEAR):
            some = places[i : i + _NEAR].astype(np.int64)
            some += self.at_one[i : i + len(some), None]
            shares[:, i : i + _NEAR] = self.shares.take(some).T
        return (shares >> 13).astype(float), (shares & 0x1FFF).astype(float)

    def predict(self, t: int, a: int, span: np.ndarray) -> None:
        """Guesses, and the widths that they and each part of order 0 have within the range."""
        at = self.at = np.empty((2, a), np.int64)
        at[0] = self.last[:a]
        context = self.older[:a] * 2741
        context += at[0]
        np.bitwise_and(context, CONTEXTS - 1, at[1])
        at += self.at_guess[:, :a]
        self.guess = self.table.take(at.reshape(-1)).reshape(2, a)
        self.ids = self.guess >> _THREE
        self.other = self.ids[0] != self.ids[1]
        # numbers are widened by copies, since operations on mixed kinds of numbers are slow
        k = self.k = self.tried[t - self.counted, :, :a]
        place = self.guess & _SEVEN
        place[1] |= self.other.astype(np.uint16) << _THREE
        np.copyto(k, place)
        k += self.at_weight[:, :a]
        weight = self.weight.take(k.reshape(-1))
        s1, s2 = self.s1, self.s2 = weight[:a], weight[a:]
        s2 *= span
        np.floor(s2, s2)
        rest = span - s2
        s1 *= rest
        np.floor(s1, s1)
        s1 *= self.other
        rest -= s1
        rest *= 1 / PARTS
        self.part = np.floor(rest, rest)

    def learn(self, ids: np.ndarray, wide: np.ndarray, hit: np.ndarray) -> None:
        """``ids``: the places as 16-bit numbers; ``wide``: the same as 64-bit ones; ``hit``: which guesses fit."""
        self.k += self.k
        self.k += hit
        state = self.k & _FIFTEEN
        guess = self.guess
        guess += _CHANGE.take(state)
        # a guess without confidence that misses is replaced
        change = (ids << _THREE) - guess
        change *= (state == 0).astype(np.uint16)
        guess += change
        self.table[self.at.reshape(-1)] = guess.reshape(-1)
        self.older, self.last = self.last, wide


def encode(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """The bytes of each block of at most ``BLOCK`` ids."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    for i in set(range(len(blocks))) - set(order):
        out[i] = _framed(np.empty(0, np.uint32), 0, b"", b"")
    for start in range(0, len(order), LANES):
        lanes = order[start : start + LANES]
        for i, coded in zip(lanes, _encode([np.ascontiguousarray(blocks[i], np.uint32) for i in lanes]), strict=True):
            out[i] = coded
    return out


def _kinds(ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, ascending, and each id's place among them; ``rank`` is room for the places of small ids."""
    ordered = np.sort(ids)
    new = np.ones(len(ids), bool)
    np.not_equal(ordered[1:], ordered[:-1], new[1:])
    kinds = ordered[new].astype(np.int64)
    if kinds[-1] >= len(rank):
        return kinds, np.searchsorted(kinds, ids).astype(np.uint16)
    rank[kinds] = np.arange(len(kinds), dtype=np.uint16)
    return kinds, rank.take(ids)


def _turned(rows: np.ndarray) -> np.ndarray:
    """Columns as rows, some rows at a time, which stay in the processor's cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for i in range(0, len(rows), _NEAR):
        out[:, i : i + _NEAR] = rows[i : i + _NEAR].T
    return out


def _written(digits: np.ndarray, at: np.ndarray, due: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Puts the digits of some steps that are due behind those written; how many each block got."""
    due, digit = _turned(due), _turned(digit)
    counts = np.count_nonzero(due, axis=1)
    stops = np.cumsum(counts)
    places = np.repeat(at - (stops - counts), counts)
    places += np.arange(len(places))
    digits[places] = digit[due]
    return counts


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    n, lengths = len(blocks), np.array([len(b) for b in blocks])
    rank = np.empty(min(max(int(b.max()) for b in blocks) + 1, 1 << 20), np.uint16)
    listed = [_kinds(b, rank) for b in blocks]
    model = _Lanes(lengths, np.array([len(kinds) for kinds, _ in listed]), slots=False)
    rows = np.zeros((n, int(lengths[0])), np.uint16)
    for lane, (_, places) in enumerate(listed):
        rows[lane, : len(places)] = places
    steps = _turned(rows)
    low, span = np.zeros(n), np.full(n, _WINDOW)
    # an id takes two digits at most, as shares are no smaller than (1 - HIGHEST) ** 2 / PARTS
    width = 2 * int(lengths[0]) + 8
    digits, first = np.zeros(n * width, np.uint32), np.arange(n) * width
    at = first.copy()
    begun = ended = row = 0
    for t, a in enumerate(model.active):
        model.renew(t, a, rows)
        if t == ended:
            if t:
                at += _written(digits, at, due[:row], digit[:row])
            begun, ended, row = t, min(t + _COUNTED, model.next, len(steps)), 0
            starts, widths = model.shared(rows[:a, begun:ended])
            due, digit = np.zeros((2 * _COUNTED, n), bool), np.empty((2 * _COUNTED, n), np.uint32)
        model.predict(t, a, span[:a])
        ids = steps[t, :a]
        hit = model.ids == ids
        s1, s2, hit1, hit2 = model.s1, model.s2, hit[0] & model.other, hit[1]
        below, wide = starts[t - begun, :a] * model.part, widths[t - begun, :a] * model.part
        below += s1
        below += s2
        below = np.where(hit1, s2, below)
        wide = np.where(hit1, s1, wide)
        below *= ~hit2
        wide = np.where(hit2, s2, wide)
        below += low[:a]
        # every block has a digit here, but only those that are due are written
        small = wide < LEAST
        due[row, :a] = small
        x = below * (_DIGIT / _WINDOW)
        np.floor(x, x)
        x *= small
        digit[row, :a] = x
        x *= _WINDOW / _DIGIT
        below -= x
        scale = np.where(small, model.moved[:a], model.kept[:a])
        below *= scale
        wide *= scale
        row += 1
        if wide.min() < LEAST:
            again = np.flatnonzero(wide < LEAST)
            x = np.floor(below[again] * (_DIGIT / _WINDOW))
            due[row, again], digit[row, again] = True, x
            below[again] = (below[again] - x * (_WINDOW / _DIGIT)) * _DIGIT
            wide[again] *= _DIGIT
            row += 1
        low[:a], span[:a] = below, wide
        model.learn(ids, ids.astype(np.int64), hit)
    at += _written(digits, at, due[:row], digit[:row])
    # the last digits: any number in the range names it
    low += span - 1
    for _ in range(4):
        digit = np.floor(low / (_WINDOW / _DIGIT))
        digits[at] = digit
        at += 1
        low = (low - digit * (_WINDOW / _DIGIT)) * _DIGIT
    at -= first
    settled = _turned(digits.reshape(n, width)[:, : int(at.max())])
    for k in range(len(settled) - 1, 0, -1):
        settled[k - 1] += settled[k] >> 16
    settled = _turned(settled.astype(">u2"))
    spelt = [x for i in range(0, n, 64) for x in _spelt([kinds for kinds, _ in listed[i : i + 64]])]
    return [_framed(blocks[i], len(listed[i][0]), spelt[i], settled[i, : at[i]].tobytes()) for i in range(n)]


def _spelt(listed: list[np.ndarray]) -> list[bytes]:
    """Each list of ids as the gaps between them: seven bits a byte, the lowest first; the highest bit says that more follow."""
    lengths = [len(kinds) for kinds in listed]
    first = np.cumsum([0, *lengths])
    every = np.concatenate(listed)
    gaps = np.diff(every, prepend=-1) - 1
    gaps[first[:-1]] = every[first[:-1]]
    bytes_ = np.empty((len(gaps), max(1, -(-int(gaps.max()).bit_length() // 7))), np.uint8)
    used = np.ones(bytes_.shape, bool)
    for k in range(bytes_.shape[1]):
        follows = gaps >= 128
        bytes_[:, k] = gaps & 127
        bytes_[:, k] |= follows.view(np.uint8) << 7
        used[:, k + 1 :] = follows[:, None]
        gaps >>= 7
    data = bytes_[used].tobytes()
    ends = np.append(0, np.cumsum(np.count_nonzero(used, axis=1)))[first]
    return [data[low:high] for low, high in zip(ends[:-1], ends[1:], strict=True)]


def _framed(ids: np.ndarray, kinds: int, spelt: bytes, digits: bytes) -> bytes:
    if len(spelt) > 0xFFFF:
        raise ValueError("a block may hold at most some ten thousand different ids")
    body = spelt + digits
    head = np.array([(MAGIC, VERSION, len(spelt), len(ids), kinds, len(digits) // 2, checksum(ids), 0)], _HEAD)
    head["body"] = _whole(head[0], body)
    return head.tobytes() + body


def _whole(head: np.void, body: bytes) -> int:
    """Checksum of all bytes of a block but this number, so that broken ones are never decoded."""
    return zlib.crc32(body, zlib.crc32(head.tobytes()[:-4]))


def _unframed(data: bytes) -> tuple[np.void, np.ndarray, np.ndarray]:
    if len(data) < _HEAD.itemsize:
        raise BlockError("too short for a block")
    head = np.frombuffer(data, _HEAD, 1)[0]
    listed, count = int(head["listed"]), int(head["digits"])
    if head["magic"] != MAGIC or head["version"] != VERSION or len(data) != _HEAD.itemsize + listed + 2 * count:
        raise BlockError("not a block of this format")
    if head["body"] != _whole(head, data[_HEAD.itemsize :]):
        raise BlockError("bytes don't fit the checksum")
    spelt = np.frombuffer(data, np.uint8, listed, _HEAD.itemsize)
    ends = np.flatnonzero(spelt < 128)
    if len(ends) != head["kinds"] or listed and (not len(ends) or ends[-1] != listed - 1) or not 0 < len(ends) <= max(int(head["ids"]), 0) and head["ids"]:
        raise BlockError("the list of ids is broken")
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    gaps, some, k = (spelt[first] & 127).astype(np.int64), np.flatnonzero(ends > first), 1
    while len(some):
        gaps[some] += (spelt[first[some] + k] & 127).astype(np.int64) << 7 * k
        k += 1
        some = some[ends[some] - first[some] >= k]
    return head, np.cumsum(gaps + 1) - 1, np.frombuffer(data, ">u2", count, _HEAD.itemsize + listed)


def decode(blocks: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block; ``BlockError`` where a block doesn't fit its checksum."""
    opened = [_unframed(data) for data in blocks]
    out = [np.empty(0, np.uint32)] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if opened[i][0]["ids"]), key=lambda i: -int(opened[i][0]["ids"]))
    for start in range(0, len(order), LANES):
        lanes = order[start : start + LANES]
        for i, ids in zip(lanes, _decode([opened[i] for i in lanes]), strict=True):
            out[i] = ids
    for (head, _, _), ids in zip(opened, out, strict=True):
        if len(ids) != head["ids"] or checksum(ids) != head["crc"]:
            raise BlockError("ids don't fit the checksum")
    return out


def _decode(opened: list[tuple]) -> list[np.ndarray]:
    n, lengths = len(opened), np.array([int(head["ids"]) for head, _, _ in opened])
    model = _Lanes(lengths, np.array([len(kinds) for _, kinds, _ in opened]), slots=True)
    # digits are read four bits late: 50 bits are three digits and two bits of the fourth
    digits = np.zeros((n, max(len(d) for _, _, d in opened) + 8), np.uint16)
    for lane, (_, _, given) in enumerate(opened):
        digits[lane, : len(given)] = given
    shifted = (digits[:, :-1] << 2) | (digits[:, 1:] >> 14)
    value = (digits[:, 0] >> 14).astype(float)
    for k in range(3):
        value = value * _DIGIT + shifted[:, k]
    # an id takes two digits at most, so that nothing is read beyond these
    left = np.arange(n) * shifted.shape[1] + 3
    shifted = np.append(shifted, np.zeros(2 * int(lengths[0]) + 8, np.uint16))
    span = np.full(n, _WINDOW)
    steps = np.zeros((int(lengths[0]), n), np.uint16)
    slots = model.slots.reshape(-1)
    for t, a in enumerate(model.active):
        model.renew(t, a, steps.T)
        model.predict(t, a, span[:a])
        s1, s2 = model.s1, model.s2
        hit2 = value[:a] < s2
        past = value[:a] - s2
        hit1 = past < s1
        hit1 &= ~hit2
        rest = past - s1
        slot = rest / model.part
        np.maximum(slot, 0, slot)
        np.minimum(slot, PARTS - 1, slot)
        ids = slots.take(model.at_slot[:a] + slot.astype(np.int64))
        shares = model.shares.take(model.at_one[:a] + ids)
        wide, below = (shares & 0x1FFF).astype(float), (shares >> 13).astype(float)
        wide *= model.part
        below *= model.part
        rest -= below
        ids = np.where(hit1, model.ids[0], ids)
        wide = np.where(hit1, s1, wide)
        rest = np.where(hit1, past, rest)
        ids = np.where(hit2, model.ids[1], ids)
        wide = np.where(hit2, s2, wide)
        rest = np.where(hit2, value[:a], rest)
        small = wide < LEAST
        scale = np.where(small, model.moved[:a], model.kept[:a])
        rest *= scale
        wide *= scale
        rest += shifted.take(left[:a]) * small
        left[:a] += small
        while wide.min() < LEAST:
            again = np.flatnonzero(wide < LEAST)
            wide[again] *= _DIGIT
            rest[again] = rest[again] * _DIGIT + shifted.take(left[again])
            left[again] += 1
        value[:a], span[:a] = rest, wide
        steps[t, :a] = ids
        model.learn(ids, ids.astype(np.int64), model.ids == ids)
    rows = _turned(steps)
    return [kinds[np.minimum(rows[i, : lengths[i]], len(kinds) - 1)].astype(np.uint32) for i, (_, kinds, _) in enumerate(opened)]
