"""An adaptive context-mixing range coder for token ids, run over many blocks side by side.

Each block is coded on its own: its models start empty and its checksum is its own, so any block can be read without the
others. An id's probability is a sum over all models that foresee it:

- order 0: counts of every id of the block so far. A new symbol takes one of the 2 t + 1 shares that t ids have given out,
  a repeated one two; an id that is new leaves one to the escape, after which it is named by a fixed distribution.
- order 1: the id that followed the previous one; order 2: the id that followed the previous two. Each has a count of how
  often it was right lately.

The weights of the three depend on these counts and on whether both orders agree, and move in each block towards the models
that were right. Cumulative shares add up in the same way, so that each id has one part of the coder's range.

The blocks are the lanes of numpy arrays: step t codes the t-th id of all blocks. Inside a block an id is known by its place,
a number given when it first comes. Places lie in GROUPS groups of SIDE; the first holds the escape, and the last of each
group stays empty, for the sum of its group. A block that has used up its places codes further new ids as escapes.

Format of a segment (little-endian): magic 'TFMX', version u8, u8 zero, u16 block length / 256, u32 number of ids, then for
each block u32 length of its code in bytes and u32 crc32 of its ids; then the blocks' codes, one after another.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

MAGIC, VERSION, BLOCK = b"TFMX", 2, 4096
#: Blocks that are coded side by side, at most.
LANES = 4096
GROUPS, SIDE, SIDE_BITS = 32, 32, 5
PLACES = GROUPS * SIDE
PLACE_BITS, PLACE = 10, PLACES - 1
#: All shares of a step add up to 2 ** TOTAL_BITS; weights have WEIGHT_BITS.
TOTAL_BITS, WEIGHT_BITS, RATE = 24, 14, 5
TOTAL, WEIGHTS = 1 << TOTAL_BITS, 1 << WEIGHT_BITS
#: What the weights of orders 1 and 2 add up to at most: order 0 keeps the rest, so that each of its shares counts.
HIGH = WEIGHTS - WEIGHTS // 64
UNIT_BITS = 20
SLOT_BITS = 10  # of the tables of what followed
SLOT = (1 << SLOT_BITS) - 1
MOST = 7  # of the counts of right predictions
#: The coder's range is between 2 ** LEAST_BITS and 2 ** 52, below what a double holds exactly, and gives out 16 bits at a time.
LEAST_BITS, DIGIT = 36, 16
LEAST, MASK = 1 << LEAST_BITS, (1 << LEAST_BITS) - 1


@cache
def base_table(n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fixed distribution, 2 ** UNIT_BITS shares in all: where each id's begin, how many it has, and the id at each place.

    They fall with the id, as vocabularies list merges by frequency; every id has one at least.
    """
    weight = 1 / (np.arange(n_ids) + 1000.0)
    share = 1 + np.floor(weight / weight.sum() * ((1 << UNIT_BITS) - n_ids)).astype(np.int64)
    share[0] += (1 << UNIT_BITS) - share.sum()
    start = np.cumsum(share) - share
    return start, share, np.repeat(np.arange(n_ids, dtype=np.int32), share)


@cache
def first_weights() -> np.ndarray:
    """Weights of orders 2 and 1 in a new block, by the count of order 2, that of order 1 and whether both foresee the same id; each row packed in a long."""
    k2, k1, same = np.meshgrid(np.arange(MOST + 1), np.arange(MOST + 1), np.arange(2), indexing="ij")
    two = k2 / (k2 + 0.8)
    one = np.where(same, 0, (1 - two) * k1 / (k1 + 1.5))
    rows = np.stack([two * 0.95, one * 0.95, 0 * two, 0 * two], -1) * WEIGHTS
    return np.ascontiguousarray(rows.astype(np.int16)).reshape(-1, 4).view(np.int64)[:, 0]


@cache
def steps_up() -> np.ndarray:
    """Row k of these: one for each entry after k."""
    width = max(GROUPS, SIDE)
    return (np.arange(width) > np.arange(width)[:, None]).astype(np.int16)


def _aligned(rows: int, width: int) -> np.ndarray:
    """Zeros of 16 bits, beginning where a line of the cache does."""
    size = 2 * rows * width
    raw = np.zeros(size + 64, np.uint8)
    skip = -raw.ctypes.data % 64
    return raw[skip : skip + size].view(np.int16).reshape(rows, width)


def place_of(k):
    """The place of the k-th distinct id of a block, from 1; the last of a group is left out."""
    return k + k // (SIDE - 1)


MOST_PLACED = GROUPS * (SIDE - 1) - 1


class _Models:
    """The state of all lanes: what both directions do alike."""

    def __init__(self, lanes: int):
        at = np.arange(lanes, dtype=np.int64)
        self.lanes, self.t = lanes, 0
        self.group_rows, self.place_rows, self.slot_rows, self.side_rows = at * GROUPS, at * PLACES, at << SLOT_BITS, at * SIDE
        self.one, self.two = np.zeros(lanes << SLOT_BITS, np.int16), np.zeros(lanes << SLOT_BITS, np.int16)
        # by which orders are right: the weights move towards the higher of them or, with none right, towards order 0
        hits = np.zeros((4, 4), np.int16)
        hits[1, 0] = hits[3, 0] = hits[2, 1] = HIGH
        self.hits = hits.reshape(-1).view(np.int64)
        first = first_weights()
        self.state_rows, self.weights = at * len(first), np.tile(first, lanes)
        # shares before each group, and before each place in its group
        self.groups, self.places = np.zeros((lanes, GROUPS), np.int16), _aligned(lanes * GROUPS, SIDE)
        self.flat_groups, self.flat_places = self.groups.reshape(-1), self.places.reshape(-1)
        self.groups[:, 1:] = 1
        self.places[:: GROUPS, 1:] = 1
        up = steps_up()[:GROUPS, :GROUPS]
        self.up_groups = np.ascontiguousarray((up[:, None] + up[None]).reshape(-1, GROUPS))  # two of each pair together
        own = steps_up()[:SIDE, :SIDE]
        self.up_places = np.ascontiguousarray(np.concatenate([2 * own, own]))
        self.rows = np.empty((lanes, SIDE), np.int16), np.empty((lanes, SIDE), np.int16), np.empty((lanes, GROUPS), np.int16)
        self.prev, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def look(self) -> None:
        """Sets the places foreseen (c), their masses (m) and the order-0 mass of a share (unit)."""
        self.slot1 = self.slot_rows + (self.prev & SLOT)
        self.slot2 = self.slot_rows + ((self.prev * 1031 + self.prev2 * 7) & SLOT)
        e1, e2 = self.one.take(self.slot1, mode="clip"), self.two.take(self.slot2, mode="clip")
        a, k1, c, k2 = e1 & PLACE, e1 >> PLACE_BITS, e2 & PLACE, e2 >> PLACE_BITS
        self.c, self.k1, self.k2, self.e1, self.e2 = (c, a), k1, k2, e1, e2
        self.state = self.state_rows + ((k2 << 4 | k1 << 1) + (a == c))
        self.w = self.weights.take(self.state, mode="clip")
        w = self.w.view(np.int16)
        two, one = w[::4].astype(np.int32) << (TOTAL_BITS - WEIGHT_BITS), w[1::4].astype(np.int32) << (TOTAL_BITS - WEIGHT_BITS)
        self.m = two, one
        self.unit = ((TOTAL - two - one) * (1 / (2 * self.t + 1))).astype(np.int32)

    def parts(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of places c begins, and its size, both in all models together."""
        at = self.place_rows + c
        before = self.flat_places.take(at, mode="clip")
        return self._sums(c, self.flat_groups.take(self.group_rows + (c >> SIDE_BITS), mode="clip") + before, self.flat_places.take(at + 1, mode="clip") - before)

    def _sums(self, c: np.ndarray, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = before * self.unit, own * self.unit
        for d, m in zip(self.c, self.m):
            start += m * (d < c)
            size += m * (d == c)
        return start, size

    def fetch(self, group: np.ndarray) -> np.ndarray:
        """The shares before each place of one group of each lane; kept for learn."""
        return self.places.take(self.group_rows + group, axis=0, out=self.rows[0], mode="clip")

    def fetched_parts(self, x: np.ndarray, group: np.ndarray, side: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Like parts, for places of the groups fetched, and in lanes `fresh` for the escape."""
        at = self.side_rows + side
        row = self.rows[0].reshape(-1)
        before = row.take(at, mode="clip")
        own = row.take(at + 1, mode="clip") - before
        before += self.flat_groups.take(self.group_rows + group, mode="clip")
        if fresh is not None:
            before[fresh], own[fresh] = 0, self.flat_places[self.place_rows[fresh] + 1]
        return self._sums(x, before, own)

    def learn(self, x: np.ndarray, own: np.ndarray, new: np.ndarray) -> None:
        """x: the places coded (0 for an escape); own: those of the ids (of new ones too; 0 for none); new: the lanes whose x is 0."""
        y, o = x.astype(np.int16, copy=False), own.astype(np.int16)
        c, a = self.c
        right = (c == y).view(np.int8) + ((a == y).view(np.int8) << 1)
        w = self.w.view(np.int16)
        w += (self.hits.take(right, mode="clip").view(np.int16) - w) >> RATE
        self.weights[self.state] = self.w
        for table, slot, e, k, c in ((self.one, self.slot1, self.e1, self.k1, a), (self.two, self.slot2, self.e2, self.k2, c)):
            # a right prediction gains trust, a wrong one loses half of it, and its place once little is left
            table[slot] = np.where(c == o, e + ((k < MOST).view(np.int8) * np.int16(1 << PLACE_BITS)), np.where(k <= 1, o | np.int16(1 << PLACE_BITS), c | (k >> 1) << PLACE_BITS))
        self.prev2, self.prev = self.prev, own
        # order 0: two shares to a place, or one to it and one to the escape
        group, side = own >> SIDE_BITS, own & (SIDE - 1)
        other = group.copy()
        other[new] = 0
        side[new] += SIDE
        rows, up, wide = self.rows
        self.up_groups.take(other * GROUPS + group, axis=0, out=wide, mode="clip")
        np.add(self.groups, wide, out=self.groups)
        self.up_places.take(side, axis=0, out=up, mode="clip")
        np.add(rows, up, out=rows)
        self.places[self.group_rows + group] = rows
        if len(new):
            self.places[self.group_rows[new]] += self.up_places[SIDE]
        self.t += 1


def _places(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one block: the place of each id, 0 where it has none, and whether it is to be coded as an escape."""
    n = np.arange(len(ids), dtype=np.int32)
    table[ids[::-1]] = n[::-1]
    first = table[ids]
    new = first == n
    k = np.cumsum(new, dtype=np.int32)[first]
    return np.where(k <= MOST_PLACED, place_of(k), 0).astype(np.int16), new | (k > MOST_PLACED)


class _Out:
    """The range coder's end of each lane."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 52, np.int64)
        self.width = steps + 8
        self.digits, self.at = np.zeros((lanes, self.width), np.int32), np.zeros(lanes, np.int64)

    def _shift(self, out: np.ndarray) -> None:
        if int(self.at[out].max()) + 1 >= self.width:
            self.digits = np.pad(self.digits, ((0, 0), (0, self.width)))
            self.width *= 2
        own = self.low[out]
        self.digits[out, self.at[out]] = own >> LEAST_BITS
        self.at[out] += 1
        self.low[out] = (own & MASK) << DIGIT
        self.range[out] <<= DIGIT

    def settle(self, out: np.ndarray) -> None:
        """Gives out digits of lanes `out`, whose ranges are too small."""
        while len(out):
            self._shift(out)
            out = out[self.range[out] < LEAST]

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        r = self.range >> TOTAL_BITS
        self.low += r * start
        np.multiply(r, size, out=self.range)
        self.settle(np.flatnonzero(self.range < LEAST))

    def put_base(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        r = self.range[lanes] >> UNIT_BITS
        self.low[lanes] += r * start
        self.range[lanes] = r * size
        self.settle(lanes[self.range[lanes] < LEAST])

    def codes(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self._shift(every)
        digits = self.digits
        for c in range(int(self.at.max()) - 1, 0, -1):  # carries
            over = digits[:, c] >> DIGIT
            if over.any():
                digits[:, c] &= (1 << DIGIT) - 1
                digits[:, c - 1] += over
        packed = digits.astype("<u2")
        return [packed[i, : self.at[i]].tobytes() for i in every]


def _encode_lanes(ids: np.ndarray, n_ids: int) -> list[bytes]:
    """ids: lanes x steps, int32."""
    lanes, steps = ids.shape
    begin, share, _ = base_table(n_ids)
    table = np.zeros(n_ids, np.int32)
    own, new = np.empty((steps, lanes), np.int16), np.empty((steps, lanes), bool)
    for i in range(0, lanes, 64):
        some = [_places(x, table) for x in ids[i : i + 64]]
        own[:, i : i + 64], new[:, i : i + 64] = np.stack([a for a, _ in some], 1), np.stack([b for _, b in some], 1)
    models, out = _Models(lanes), _Out(lanes, steps)
    for t in range(steps):
        place, fresh = own[t].astype(np.int64), np.flatnonzero(new[t])
        group, side = place >> SIDE_BITS, place & (SIDE - 1)
        models.look()
        models.fetch(group)
        x = own[t].copy()
        x[fresh] = 0
        out.put(*models.fetched_parts(x, group, side, fresh))
        if len(fresh):
            named = ids[fresh, t]
            out.put_base(fresh, begin[named], share[named])
        models.learn(x, place, fresh)
    return out.codes()


class _In:
    """The other end: diff is how far the code lies above the range's start.

    Damaged codes lead anywhere, so ranges and aims are kept in bounds here; the checksum tells such a block.
    """

    def __init__(self, codes: list[bytes]):
        most = max(map(len, codes)) // 2 + 8
        self.digits = np.zeros((len(codes), most), np.int64)
        for i, c in enumerate(codes):
            self.digits[i, : len(c) // 2] = np.frombuffer(c, "<u2")
        d = self.digits
        self.range = np.full(len(codes), 1 << 52, np.int64)
        # 52 bits are a digit of 16 after LEAST_BITS = 2 * 16 + 4 more: the last 12 bits of a digit wait for the next shift
        self.diff = d[:, 0] << 36 | d[:, 1] << 20 | d[:, 2] << 4 | d[:, 3] >> 12
        self.rest, self.at = d[:, 3] & 0xFFF, np.full(len(codes), 4, np.int64)

    def settle(self, more: np.ndarray) -> None:
        while len(more):
            digit = self.digits[more, np.minimum(self.at[more], self.digits.shape[1] - 1)]
            self.diff[more] = self.diff[more] << DIGIT | self.rest[more] << 4 | digit >> 12
            self.rest[more] = digit & 0xFFF
            self.at[more] += 1
            self.range[more] <<= DIGIT
            more = more[self.range[more] < LEAST]

    def aim(self) -> np.ndarray:
        self.r = self.range >> TOTAL_BITS
        return np.clip(self.diff / self.r, 0, TOTAL - 1).astype(np.int32)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.diff -= self.r * start
        np.maximum(self.r * size, 1, out=self.range)
        self.settle(np.flatnonzero(self.range < LEAST))

    def take_base(self, lanes: np.ndarray, tables: tuple) -> np.ndarray:
        begin, share, place = tables
        r = self.range[lanes] >> UNIT_BITS
        ids = place[np.clip(self.diff[lanes] // r, 0, (1 << UNIT_BITS) - 1)]
        self.diff[lanes] -= r * begin[ids]
        self.range[lanes] = r * share[ids]
        self.settle(lanes[self.range[lanes] < LEAST])
        return ids


def _ones(mask: np.ndarray) -> np.ndarray:
    """How many of each row of mask (lanes x a multiple of 8) are set, fewer than 256."""
    w = mask.view(np.uint64)
    s = w[:, 0].copy()
    for k in range(1, w.shape[1]):
        s += w[:, k]
    s *= np.uint64(0x0101010101010101)
    return (s >> np.uint64(56)).astype(np.int64)


def _found(models: _Models, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose parts hold target, where these begin, and their sizes; their groups are fetched."""
    below, x = target, None
    for c, m in zip(models.c, models.m):
        start, size = models.parts(c)
        end = start + size
        inside = (start <= target) & (target < end)
        below = below - m * (target >= end)
        x, known = (c, inside) if x is None else (np.where(inside, c, x), known | inside)
    left = np.minimum(below // np.maximum(models.unit, 1), 2 * models.t).astype(np.int16)
    group = np.where(known, x >> SIDE_BITS, np.maximum(_ones(models.groups <= left[:, None]) - 1, 0))
    left -= models.flat_groups.take(models.group_rows + group, mode="clip")
    side = np.where(known, x & (SIDE - 1), np.maximum(_ones(models.fetch(group) <= left[:, None]) - 1, 0))
    x = (group << SIDE_BITS) + side
    return x, *models.fetched_parts(x, group, side)


def _decode_lanes(codes: list[bytes], steps: int, n_ids: int) -> np.ndarray:
    """lanes x steps ids."""
    lanes, tables = len(codes), base_table(n_ids)
    models, data = _Models(lanes), _In(codes)
    named, seen = np.zeros((lanes, PLACES), np.int32), np.zeros(lanes, np.int64)
    found = np.zeros((steps, lanes), np.int32)
    rows = np.arange(lanes) * PLACES
    for t in range(steps):
        models.look()
        x, start, size = _found(models, data.aim())
        data.take(start, size)
        own = x.copy()
        fresh = np.flatnonzero(x == 0)
        if len(fresh):
            ids = data.take_base(fresh, tables)
            seen[fresh] += 1
            k = seen[fresh]
            own[fresh] = np.where(k <= MOST_PLACED, place_of(k), 0)
            named[fresh, own[fresh]] = ids  # place 0 holds the last id without a place, just now
            models.rows[0][fresh] = models.places[models.group_rows[fresh] + (own[fresh] >> SIDE_BITS)]
        found[t] = named.reshape(-1).take(rows + own, mode="clip")
        models.learn(x, own, fresh)
    return np.ascontiguousarray(found.T)


def encode(ids: np.ndarray, n_ids: int) -> bytes:
    """A segment that holds ids, each below n_ids (at most 2 ** 16)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >= n_ids:
        raise ValueError("an id is not below n_ids")
    n = -(-len(ids) // BLOCK)
    heads, codes = [], []
    for first in range(0, n, LANES):
        lanes = min(LANES, n - first)
        steps = min(BLOCK, len(ids))  # the last block is filled up with zeros
        part = np.zeros(lanes * steps, np.int32)
        own = ids[first * BLOCK : (first + lanes) * BLOCK]
        part[: len(own)] = own
        for k, code in enumerate(_encode_lanes(part.reshape(lanes, steps), n_ids)):
            raw = own[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()
            heads.append(struct.pack("<II", len(code), zlib.crc32(raw)))
            codes.append(code)
    return MAGIC + struct.pack("<BBHI", VERSION, 0, BLOCK // 256, len(ids)) + b"".join(heads) + b"".join(codes)


def decode(data: bytes, n_ids: int) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block does not match its checksum."""
    version, _, width, total = struct.unpack_from("<BBHI", data, 4)
    if data[:4] != MAGIC or version != VERSION or width * 256 != BLOCK:
        raise ValueError("not a segment of this format")
    n, at = -(-total // BLOCK), 12
    heads = [struct.unpack_from("<II", data, at + 8 * k) for k in range(n)]
    at += 8 * n
    out = np.zeros(total, np.uint32)
    for first in range(0, n, LANES):
        codes = []
        for size, _ in heads[first : first + LANES]:
            codes.append(data[at : at + size])
            at += size
        got = _decode_lanes(codes, min(BLOCK, total), n_ids).astype("<u4")
        for k in range(len(codes)):
            m = min(BLOCK, total - (first + k) * BLOCK)
            ids = got[k, :m]
            if zlib.crc32(ids.tobytes()) != heads[first + k][1]:
                raise ValueError(f"block {first + k} doesn't match its checksum")
            out[(first + k) * BLOCK : (first + k) * BLOCK + m] = ids
    return out
