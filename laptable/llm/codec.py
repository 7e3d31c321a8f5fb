"""A range coder for blocks of token ids, driven by predictions of order 0 to 2.

A block of up to ``BLOCK`` ids is split into ``LANES`` runs that advance together and share one model, which starts empty for
every block. For each next id the model looks up one predicted id after the last two ids (order 2) and one after the last
id (order 1), each with a confidence. The chance that the order-2 id comes is a logistic mix of what orders 2, 1 and 0 (the
block's own hit rate) say, with weights that learn from the coding errors; the chance of the order-1 id comes from adaptive
counters of both confidences. One coding step tells which of the two came, or neither; in the latter case the id is coded by
order-0 frequencies of the block so far, with an escape to plain sixteen bits for ids not yet seen. Everything is integer
arithmetic, so a block reads the same on any machine. Many blocks are coded at once, lane by lane, in numpy.

A coded block is: magic, number of ids, CRC-32 of its ids as little-endian unsigned 32-bit integers, lanes, then the
length of each lane's code and the codes (16-bit digits). Reading checks the CRC and raises on a mismatch.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK, LANES = 1 << 16, 64
#: Blocks that are coded together.
TOGETHER = 96
MAGIC = b"TKB1"
HEAD = struct.Struct("<4sIIH")
U = np.uint64
SLOTS1, SLOTS2 = 12, 15
#: Order-0 frequencies are made anew after these steps.
RENEWALS = frozenset({2, 8, 24, 64, 128, 256, 512, 768})
ESCAPE = -1

STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64)
SQUASH = np.array([round(65536 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int64).clip(48, 65536 - 96)


class _Model:
    """The shared model of each block; ``rows`` are lanes, block by block."""

    def __init__(self, blocks: int, lanes: int):
        n = blocks * lanes
        self.blocks, self.lanes = blocks, lanes
        self.block = np.repeat(np.arange(blocks), lanes)
        self.one, self.two = np.zeros(blocks << SLOTS1, np.int32), np.zeros(blocks << SLOTS2, np.int32)
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        #: Hit rates of the order-2 id by its confidence, by order 1's confidence and agreement, and in all.
        self.rates = [np.full(blocks * k, 1 << 15, np.int64) for k in (8, 16, 2)]
        self.rate_b = np.full(blocks * 64, 1 << 13, np.int64)
        self.weights = np.full((blocks, 3), 26000, np.int64)
        self.seen: list[np.ndarray] = []
        self.counts: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.renew()

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The two predicted ids (-1: none) and their shares of 65536."""
        self.slot1 = (self.block << SLOTS1) + ((self.last1 * 40503 >> 4) & ((1 << SLOTS1) - 1))
        self.slot2 = (self.block << SLOTS2) + (((self.last1 * 2654435761 + self.last2 * 40503 * 977) >> 9) & ((1 << SLOTS2) - 1))
        self.v1, self.v2 = self.one[self.slot1].astype(np.int64), self.two[self.slot2].astype(np.int64)
        c1, c2 = self.v1 & 7, self.v2 & 7
        id1, id2 = self.v1 >> 3, self.v2 >> 3
        agree = id1 == id2
        self.at = [self.block * 8 + c2, self.block * 16 + c1 * 2 + agree, self.block * 2 + (c2 > 2)]
        self.has_a, self.has_b = c2 > 0, (c1 > 0) & ~((c2 > 0) & agree)
        self.inputs = np.stack([STRETCH[r[i] >> 4] for r, i in zip(self.rates, self.at, strict=True)], axis=1)
        mixed = (self.inputs * self.weights[self.block]).sum(axis=1) >> 16
        self.pa = np.where(self.has_a, SQUASH[mixed.clip(-2047, 2047) + 2047], 0)
        self.at_b = self.block * 64 + c1 * 8 + c2
        pb = (self.rate_b[self.at_b] * (65536 - 64 - self.pa) >> 16).clip(16)
        return np.where(self.has_a, id2, -1), np.where(self.has_b, id1, -1), self.pa, np.where(self.has_b, pb, 0)

    def _learn(self, rates: np.ndarray, at: np.ndarray, hit: np.ndarray) -> None:
        n = np.bincount(at, minlength=len(rates))
        h = np.bincount(at[hit], minlength=len(rates))
        rates += ((h << 16) - n * rates) // (n + 24)
        rates.clip(32, 65503, out=rates)

    def update(self, ids: np.ndarray, hit_a: np.ndarray, hit_b: np.ndarray) -> None:
        has_a = self.has_a
        for rates, at in zip(self.rates, self.at, strict=True):
            self._learn(rates, at[has_a], hit_a[has_a])
        for_b = self.has_b & ~hit_a
        self._learn(self.rate_b, self.at_b[for_b], hit_b[for_b])
        error = np.where(has_a, (hit_a.astype(np.int64) << 16) - self.pa, 0)
        change = (self.inputs * error[:, None]).reshape(self.blocks, self.lanes, 3).sum(axis=1)
        self.weights = (self.weights + (change >> 14)).clip(-(1 << 18), 1 << 18)
        for table, slot, v in ((self.one, self.slot1, self.v1), (self.two, self.slot2, self.v2)):
            c = v & 7
            table[slot] = np.where(v >> 3 == ids, v + (c < 7), np.where(c > 1, v - c + (c >> 1), ids * 8 + 1))
        self.last2, self.last1 = self.last1, ids

    def renew(self) -> None:
        """Order-0 frequencies of the ids coded without a prediction so far; the last share of each block is the escape."""
        keys, counts = self.counts
        if self.seen:
            fresh, n = np.unique(np.concatenate(self.seen), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            self.seen, self.counts = [], (keys, counts)
        block = keys >> 16
        kinds = np.bincount(block, minlength=self.blocks)
        total = np.bincount(block, counts, minlength=self.blocks).astype(np.int64) + kinds // 2 + 1
        share = np.maximum(1, counts * (65536 - kinds - 1)[block] // total[block])
        end = np.cumsum(share)
        first = np.searchsorted(block, np.arange(self.blocks))
        before = np.concatenate([[0], end])[first]
        self.keys, self.share = keys, share
        self.start = end - share - before[block]
        self.escape = np.concatenate([[0], end])[np.searchsorted(block, np.arange(self.blocks), "right")] - before
        #: Starts of all shares in one row of numbers, to look up codes; the escape ends each block.
        places = np.concatenate([(block << 16) + self.start, (np.arange(self.blocks) << 16) + self.escape])
        order = np.argsort(places, kind="stable")
        self.places, self.place_row = places[order], np.where(order < len(keys), order, ESCAPE)

    def order0(self, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, share, and whether it is an escape, of ids in the blocks of some lanes."""
        block = self.block[rows]
        if not len(self.keys):
            return np.zeros(len(rows), np.int64), np.full(len(rows), 65536), np.ones(len(rows), bool)
        key = (block << 16) + ids
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        known = self.keys[at] == key
        start = np.where(known, self.start[at], self.escape[block])
        return start, np.where(known, self.share[at], 65536 - self.escape[block]), ~known

    def find0(self, rows: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: escape), start and share for codes in the blocks of some lanes."""
        block = self.block[rows]
        row = self.place_row[np.searchsorted(self.places, (block << 16) + code, "right") - 1]
        escaped = row == ESCAPE
        at = np.where(escaped, 0, row)
        if not len(self.keys):
            return np.full(len(rows), -1), self.escape[block], 65536 - self.escape[block], escaped
        start = np.where(escaped, self.escape[block], self.start[at])
        share = np.where(escaped, 65536 - self.escape[block], self.share[at])
        return np.where(escaped, -1, self.keys[at] & 65535), start, share, escaped


class _Writer:
    """A range coder per lane: 48-bit window, digits of 16 bits; carries are added into the digits at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 1 << 48, U)
        self.digits, self.n = np.zeros((3 * steps + 4, lanes), np.uint32), np.zeros(lanes, np.int64)

    def put(self, rows: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        part = self.range[rows] >> U(16)
        self.low[rows] += part * start.astype(U)
        self.range[rows] = part * share.astype(U)
        out = rows[self.range[rows] < U(1 << 32)]
        self._shift(out)
        self.range[out] <<= U(16)

    def _shift(self, out: np.ndarray) -> None:
        low = self.low[out]
        self.digits[self.n[out], out] = low >> U(32)
        self.n[out] += 1
        self.low[out] = (low & U(0xFFFFFFFF)) << U(16)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """The digits (a column per lane) and how many each lane has."""
        every = np.arange(len(self.low))
        for _ in range(3):
            self._shift(every)
        digits = self.digits
        for i in range(int(self.n.max()) - 1, 0, -1):
            digits[i - 1] += digits[i] >> 16
            digits[i] &= 0xFFFF
        return digits, self.n


class _Reader:
    def __init__(self, digits: np.ndarray):
        self.digits, lanes = digits, digits.shape[1]
        top = digits[:3].astype(U)
        self.code, self.range = (top[0] << U(32)) | (top[1] << U(16)) | top[2], np.full(lanes, 1 << 48, U)
        self.n = np.full(lanes, 3)

    def peek(self, rows: np.ndarray) -> np.ndarray:
        self.part = self.range[rows] >> U(16)
        return np.minimum(self.code[rows] // self.part, U(65535)).astype(np.int64)

    def take(self, rows: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        """Must follow ``peek`` of the same lanes."""
        self.code[rows] -= self.part * start.astype(U)
        self.range[rows] = self.part * share.astype(U)
        more = rows[self.range[rows] < U(1 << 32)]
        self.code[more] = (self.code[more] << U(16)) | self.digits[self.n[more], more].astype(U)
        self.range[more] <<= U(16)
        self.n[more] += 1


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits and lengths of lanes for ids of shape (blocks, lanes, steps)."""
    blocks, lanes, steps = ids.shape
    model, out = _Model(blocks, lanes), _Writer(blocks * lanes, steps)
    columns = np.ascontiguousarray(ids.reshape(blocks * lanes, steps).T).astype(np.int64)
    every = np.arange(blocks * lanes)
    for step, now in enumerate(columns):
        if step in RENEWALS:
            model.renew()
        a, b, pa, pb = model.predict()
        hit_a, hit_b = a == now, b == now
        miss = ~(hit_a | hit_b)
        out.put(every, np.where(hit_a, 0, np.where(hit_b, pa, pa + pb)), np.where(hit_a, pa, np.where(hit_b, pb, 65536 - pa - pb)))
        rows = np.flatnonzero(miss)
        own = now[rows]
        start, share, escaped = model.order0(rows, own)
        out.put(rows, start, share)
        plain = rows[escaped]
        out.put(plain, now[plain], np.ones(len(plain), np.int64))
        model.seen.append((model.block[rows] << 16) + own)
        model.update(now, hit_a, hit_b)
    return out.close()


def _decode(digits: np.ndarray, blocks: int, lanes: int, steps: int) -> np.ndarray:
    model, source = _Model(blocks, lanes), _Reader(digits)
    columns = np.zeros((steps, blocks * lanes), np.int64)
    every = np.arange(blocks * lanes)
    for step, now in enumerate(columns):
        if step in RENEWALS:
            model.renew()
        a, b, pa, pb = model.predict()
        code = source.peek(every)
        hit_a = code < pa
        hit_b = ~hit_a & (code < pa + pb)
        source.take(every, np.where(hit_a, 0, np.where(hit_b, pa, pa + pb)), np.where(hit_a, pa, np.where(hit_b, pb, 65536 - pa - pb)))
        now[:] = np.where(hit_a, a, b)
        rows = np.flatnonzero(~(hit_a | hit_b))
        own, start, share, escaped = model.find0(rows, source.peek(rows))
        source.take(rows, start, share)
        plain = rows[escaped]
        code = source.peek(plain)
        source.take(plain, code, np.ones(len(plain), np.int64))
        own[escaped] = code
        now[rows] = own
        model.seen.append((model.block[rows] << 16) + own)
        model.update(now, hit_a, hit_b)
    return np.ascontiguousarray(columns.T).reshape(blocks, lanes, steps)


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block: short blocks have fewer lanes, as each costs ten bytes."""
    lanes = min(LANES, max(1, n // 64))
    return lanes, -(-n // lanes)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (at most ``BLOCK`` ids below 65536, at least one) on its own; blocks of one shape are coded together."""
    out: list[bytes] = [b""] * len(blocks)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(blocks):
        by_shape.setdefault(_shape(len(x)), []).append(i)
    for (lanes, steps), members in by_shape.items():
        for k in range(0, len(members), TOGETHER):
            some = members[k : k + TOGETHER]
            ids = np.zeros((len(some), lanes * steps), np.int64)
            for row, i in zip(ids, some, strict=True):
                row[: len(blocks[i])] = blocks[i]
            digits, lengths = _encode(ids.reshape(len(some), lanes, steps))
            for j, i in enumerate(some):
                own, n = digits[:, j * lanes : (j + 1) * lanes], lengths[j * lanes : (j + 1) * lanes]
                head = HEAD.pack(MAGIC, len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()), lanes)
                code = own.T[np.arange(len(own)) < n[:, None]].astype("<u2").tobytes()
                out[i] = head + n.astype("<u4").tobytes() + code
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    heads = [HEAD.unpack_from(x) for x in coded]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a block of token ids")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, _, lanes) in enumerate(heads):
        by_shape.setdefault((lanes, -(-n // lanes)), []).append(i)
    for (lanes, steps), members in by_shape.items():
        for k in range(0, len(members), TOGETHER):
            some = members[k : k + TOGETHER]
            lengths = [np.frombuffer(coded[i], "<u4", lanes, HEAD.size).astype(np.int64) for i in some]
            digits = np.zeros((max(int(n.max()) for n in lengths) + 1, len(some) * lanes), np.uint16)
            for j, (i, n) in enumerate(zip(some, lengths, strict=True)):
                code = np.frombuffer(coded[i], "<u2", int(n.sum()), HEAD.size + 4 * lanes)
                own = np.zeros((lanes, len(digits)), np.uint16)
                own[np.arange(len(digits)) < n[:, None]] = code
                digits[:, j * lanes : (j + 1) * lanes] = own.T
            ids = _decode(digits, len(some), lanes, steps).reshape(len(some), lanes * steps)
            for row, i in zip(ids, some, strict=True):
                out[i] = row[: heads[i][1]]
                if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][2]:
                    raise ValueError("a block of token ids fails its checksum")
    return out
