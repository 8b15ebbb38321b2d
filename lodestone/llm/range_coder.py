"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from the same state, so any block can be
decoded alone; each has a checksum. Three predictors speak for each id. Orders
2 and 1 name the id that last followed the same two ids, or the same id, in
the block (small hashed tables). Order 0 is a distribution over all ids: in
classes of equal shares of the segment, whose frequencies adapt to the block,
and by the segment's frequencies within a class. The coder's distribution is
the mixture ``p * [order 2's id] + q * [order 1's id] + (1 - p - q) * order 0``;
its weights p and q are learned as the block goes, apart for each state: which
predictors speak, whether they agree, and whether the last three ids were
foretold. Arithmetic is in integers throughout, so decoding repeats it exactly.

Blocks of a segment advance together, one id each at a time, as numpy lanes;
weights and class frequencies are learned anew every ``REFRESH`` steps.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LRC2"
BLOCK = 1024
#: Blocks that advance together.
LANES = 4096
REFRESH = 128
_S1, _S2 = 8, 9  # binary logarithms of the tables' sizes
_CLASSES = 16
_STATES = 32  # three outcomes before, four cases of what the predictors say
_FULL = 1 << 16  # what the frequencies of a class add up to
_SPAN = 256  # and those of all classes
_MOST = 32768 - 64  # of 32768: the most that orders 2 and 1 together get

_U = np.uint64
_RANGE_BITS = _U(48)
_LEAST = _U(1 << 48)


class Order0:
    """The segment's distribution of ids: class and frequencies in it, from the ids' counts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts = np.asarray(counts, "i8")
        by = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        mass = np.cumsum(counts[by]) - counts[by]
        of = mass * _CLASSES // max(int(counts.sum()), 1)
        _, of = np.unique(of, return_inverse=True)  # a class that a frequent id jumps over does not exist
        self.classes = max(int(of.max(initial=0)) + 1, 1)
        self.class_of = np.zeros(len(counts) + 1, np.intp)
        self.class_of[by + 1] = of
        self.start = np.zeros(self.classes, "i8")  # classes' counts that every block starts from
        #: For each id, cumulative frequency and frequency in its class; for each class and target, the id after.
        self.packed = np.zeros(len(counts) + 1, "u8")
        self.places = np.ones(self.classes * _FULL, "u2" if len(counts) < _FULL else "u4")
        for k in range(self.classes):
            ids = by[of == k]
            if not len(ids):
                continue
            total = int(counts[ids].sum())
            freq = np.maximum(counts[ids] * (_FULL - len(ids)) // total, 1)
            freq[0] += _FULL - int(freq.sum())
            self.start[k] = total * 256 // max(int(counts.sum()), 1)
            self.packed[ids + 1] = (np.cumsum(freq) - freq) << 32 | freq
            self.places[k * _FULL : (k + 1) * _FULL] = np.repeat(ids + 1, freq)
        self.start += 1

    def to_bytes(self) -> bytes:
        return zlib.compress(self.counts.astype("<u4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Order0:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


class Mixer:
    """What the lanes' blocks have learned: weights by state and frequencies of classes."""

    def __init__(self, prior: Order0, lanes: int):
        self.prior, self.lanes = prior, lanes
        self.seen = np.zeros((lanes, 3, _STATES), "i4")  # outcomes: order 0, first candidate, second
        self.of_class = np.tile(prior.start.astype("i4"), (lanes, 1))
        self.base_state = np.arange(lanes) * (_STATES * 3)
        self.base_class = np.arange(lanes) * prior.classes
        # Before anything is seen: how often candidates hold after each number of foretold ids, in 64ths.
        foretold = np.array([bin(k).count("1") for k in range(8)])
        first = np.array([2, 8, 32, 58])[foretold][:, None] * np.array([0, 1, 1, 1])
        second = np.minimum(np.array([1, 2, 4, 2])[foretold], 64 - first.max(axis=1) - 1)[:, None] * np.array([0, 0, 0, 1])
        self.start = np.stack([64 - first - second, first, second]).reshape(3, _STATES).astype("i4")
        self.refresh()

    def learn(self, outcomes: np.ndarray, classes: np.ndarray, missed: np.ndarray) -> None:
        """outcomes: 32 * outcome + state of each step and lane; classes of ids that order 0 coded."""
        found = np.bincount((outcomes + self.base_state).reshape(-1), minlength=self.lanes * _STATES * 3)
        self.seen += found.reshape(self.seen.shape).astype("i4")
        found = np.bincount((classes + self.base_class)[missed], minlength=self.lanes * self.prior.classes)
        self.of_class += 24 * found.reshape(self.lanes, -1).astype("i4")
        self.refresh()

    def refresh(self) -> None:
        n = 16 * self.seen + self.start  # what holds before counts as four ids of each state
        one, both = n[:, 1], n[:, 1] + n[:, 2]
        total = both + n[:, 0]
        first, both = one * _MOST // total, both * _MOST // total
        first[:, ::4] = both[:, ::4] = 0  # nothing speaks
        self.weights = (both << 16 | first).astype("u4").reshape(-1)
        cum = np.cumsum(self.of_class, axis=1)
        k = self.prior.classes
        ends = cum * (_SPAN - k) // cum[:, -1:] + np.arange(1, k + 1)
        self.sizes = np.diff(ends, axis=1, prepend=0)
        self.spans = ((ends - self.sizes).astype("u8") << _U(16) | self.sizes.astype("u8")).reshape(-1)

    def class_at(self) -> np.ndarray:
        """For each lane and target of 8 bits, the class."""
        return np.repeat(np.tile(np.arange(self.prior.classes, dtype="u1"), self.lanes), self.sizes.reshape(-1))


class Contexts:
    """Order 1 and 2 tables of the lanes, of ids plus one; 0 is none."""

    def __init__(self, lanes: int, kind: str):
        self.one, self.two = np.zeros(lanes << _S1, kind), np.zeros(lanes << _S2, kind)
        self.base1, self.base2 = np.arange(lanes) << _S1, np.arange(lanes) << _S2
        self.i1, self.i2 = np.zeros(lanes, np.intp), np.zeros(lanes, np.intp)
        self.hash, self.before = np.zeros(lanes, "i8"), np.zeros(lanes, "i8")
        self.c1, self.c2 = np.zeros(lanes, kind), np.zeros(lanes, kind)  # candidates; c2 is the first to be tried
        self.has1, self.has2, self.differ = (np.zeros(lanes, bool) for _ in range(3))
        self.history, self.state = np.zeros(lanes, "u1"), np.zeros(lanes, "u1")

    def look_up(self, last: np.ndarray) -> None:
        """The candidates after ``last`` and the state that they make."""
        self.hash, self.before = self.before, self.hash
        np.multiply(last, 40503, out=self.hash, dtype="i8", casting="unsafe")
        np.right_shift(self.hash, 5, out=self.i1)
        self.i1 &= (1 << _S1) - 1
        self.i1 += self.base1
        np.right_shift(self.before, 3, out=self.i2)
        self.i2 ^= self.hash
        self.i2 >>= 4
        self.i2 &= (1 << _S2) - 1
        self.i2 += self.base2
        self.one.take(self.i1, out=self.c1, mode="clip")
        self.two.take(self.i2, out=self.c2, mode="clip")
        np.greater(self.c1, 0, out=self.has1)
        np.greater(self.c2, 0, out=self.has2)
        np.not_equal(self.c1, self.c2, out=self.differ)
        self.differ &= self.has2
        np.left_shift(self.history, 2, out=self.state)
        self.state += self.has1.view("u1")
        self.state += self.has2.view("u1")
        self.state += self.differ.view("u1")
        np.logical_not(self.has2, out=self.has2)
        np.copyto(self.c2, self.c1, where=self.has2)

    def update(self, now: np.ndarray, known: np.ndarray) -> None:
        self.one[self.i1] = now
        self.two[self.i2] = now
        self.history <<= 1
        self.history |= known.view("u1")
        self.history &= 7


def _encode_lanes(prior: Order0, ids: np.ndarray) -> list[bytes]:
    """Blocks of ids (step, lane)."""
    steps, n = ids.shape
    after = ids.astype(prior.places.dtype) + prior.places.dtype.type(1)
    mixer, contexts = Mixer(prior, n), Contexts(n, prior.places.dtype.str)
    low, rng = np.zeros(n, "u8"), np.full(n, ~_U(0))
    room = steps // 2 + 4 * REFRESH
    words = np.zeros((n, room), "u4")  # of 16 bits, and carries not yet passed on
    flat, at = words.reshape(-1), np.arange(n) * room
    sums = lambda: np.zeros(n, "u8")
    p, pq, b, add, shift = (sums() for _ in range(5))
    w = np.zeros(n, "u4")
    state, need, over = np.zeros(n, np.intp), np.zeros(n, bool), np.zeros(n, bool)
    state_base = np.arange(n) * _STATES
    last = np.zeros(n, after.dtype)
    for t0 in range(0, steps, REFRESH):
        some = after[t0 : t0 + REFRESH]
        m = len(some)
        if t0:
            mixer.learn(outcomes, classes, missed)
        if int((at - np.arange(n) * room).max()) + 4 * REFRESH > room:
            words = np.pad(words, ((0, 0), (0, room)))
            at += np.arange(n) * room
            room *= 2
            flat = words.reshape(-1)
        classes = prior.class_of[some]
        spans, inside = mixer.spans[classes + mixer.base_class], prior.packed[some]
        size = spans & _U(0xFFFF)
        starts = (spans >> _U(16) << _U(16)) + size * (inside >> _U(32))
        size *= inside & _U(0xFFFFFFFF)
        outcomes, missed = np.zeros((m, n), "u1"), np.zeros((m, n), bool)
        hits, knowns = np.zeros((m, n), bool), np.zeros((m, n), bool)
        for k in range(m):
            now, hit, known = some[k], hits[k], knowns[k]
            contexts.look_up(last)
            np.equal(now, contexts.c2, out=hit)
            np.equal(now, contexts.c1, out=known)
            known |= hit
            np.add(state_base, contexts.state, out=state)
            mixer.weights.take(state, out=w, mode="clip")
            np.bitwise_and(w, 0xFFFF, out=p)
            np.right_shift(w, 16, out=pq)
            np.right_shift(rng, _U(15), out=b)
            p *= b
            pq *= b
            rng -= pq  # what order 0 gets, unless a candidate holds
            rng >>= _U(24)
            np.multiply(rng, starts[k], out=add)
            add += pq
            rng *= size[k]
            pq -= p
            np.copyto(add, p, where=known)
            np.copyto(rng, pq, where=known)
            np.copyto(add, _U(0), where=hit)
            np.copyto(rng, p, where=hit)
            low += add
            np.less(low, add, out=over)
            np.less(rng, _LEAST, out=need)
            carried = np.flatnonzero(over)
            if len(carried):
                flat[at[carried] - 1] += 1
            # Every lane writes its highest word; it stays only where the range has shrunk.
            np.right_shift(low, _RANGE_BITS, out=add)
            flat[at] = add
            at += need
            np.multiply(need, _U(16), out=shift, dtype="u8", casting="unsafe")
            low <<= shift
            rng <<= shift
            np.less(rng, _LEAST, out=need)
            left = np.flatnonzero(need)
            while len(left):
                flat[at[left]] = low[left] >> _RANGE_BITS
                at[left] += 1
                low[left] <<= _U(16)
                rng[left] <<= _U(16)
                left = left[rng[left] < _LEAST]
            contexts.update(now, known)
            outcomes[k] = contexts.state
            last = now
        # 1 for the first candidate, 2 for the second
        outcomes += (64 * knowns.view("u1")) - (32 * hits.view("u1"))
        np.logical_not(knowns, out=missed)
    for _ in range(4):
        flat[at] = low >> _RANGE_BITS
        low <<= _U(16)
        at += 1
    used = at - np.arange(n) * room
    while len(over := np.flatnonzero(flat > 0xFFFF)):
        flat[over] -= 1 << 16
        flat[over - 1] += 1
    short = words.astype("<u2")
    return [row[:k].tobytes() for row, k in zip(short, used.tolist(), strict=True)]


def _decode_lanes(prior: Order0, blocks: list[bytes], steps: int) -> np.ndarray:
    """Ids (step, lane) of blocks."""
    n = len(blocks)
    mixer, contexts = Mixer(prior, n), Contexts(n, prior.places.dtype.str)
    room = max(map(len, blocks)) // 2 + 8
    words = np.zeros((n, room), "u2")
    for row, data in zip(words, blocks, strict=True):
        row[: len(data) // 2] = np.frombuffer(data, "<u2")
    flat, at = words.reshape(-1), np.arange(n) * room + 4
    code, rng = np.zeros(n, "u8"), np.full(n, ~_U(0))
    for k in range(4):
        code = (code << _U(16)) | words[:, k]
    sums = lambda: np.zeros(n, "u8")
    p, pq, b, other, u, span, size, shift, word64 = (sums() for _ in range(9))
    w = np.zeros(n, "u4")
    place, inside, word = np.zeros(n, np.intp), sums(), np.zeros(n, "u2")
    cls, need, left_over = np.zeros(n, "u1"), np.zeros(n, bool), np.zeros(n, bool)
    state, state_base, at256 = np.zeros(n, np.intp), np.arange(n) * _STATES, np.arange(n) * _SPAN
    out = np.zeros((steps, n), prior.places.dtype)
    last = np.zeros(n, out.dtype)
    for t0 in range(0, steps, REFRESH):
        if t0:
            mixer.learn(outcomes, classes, missed)
        class_at = mixer.class_at()
        m = min(REFRESH, steps - t0)
        outcomes, classes = np.zeros((m, n), "u1"), np.zeros((m, n), "u1")
        hits, knowns = np.zeros((m, n), bool), np.zeros((m, n), bool)
        for k in range(m):
            now, hit, known = out[t0 + k], hits[k], knowns[k]
            contexts.look_up(last)
            np.add(state_base, contexts.state, out=state)
            mixer.weights.take(state, out=w, mode="clip")
            np.bitwise_and(w, 0xFFFF, out=p)
            np.right_shift(w, 16, out=pq)
            np.right_shift(rng, _U(15), out=b)
            p *= b
            pq *= b
            np.less(code, p, out=hit)
            np.less(code, pq, out=known)
            # Order 0, for all lanes; those that a candidate holds for are set right below.
            np.subtract(code, pq, out=other)
            rng -= pq
            rng >>= _U(24)
            np.floor_divide(other, rng, out=u)
            np.minimum(u, _U((1 << 24) - 1), out=u)
            np.right_shift(u, _U(16), out=span)
            np.add(at256, span.view("i8"), out=place)
            cls = classes[k]
            class_at.take(place, out=cls, mode="clip")
            np.add(mixer.base_class, cls, out=place)
            mixer.spans.take(place, out=span, mode="clip")
            np.bitwise_and(span, _U(0xFFFF), out=size)
            span ^= size  # the class's start, times 65536
            u -= span
            np.floor_divide(u, size, out=u)
            np.left_shift(cls, 16, out=place, dtype=np.intp, casting="unsafe")
            place += u.view("i8")
            prior.places.take(place, out=now, mode="clip")
            prior.packed.take(now, out=inside, mode="clip")
            np.right_shift(inside, _U(32), out=u)
            inside &= _U(0xFFFFFFFF)
            u *= size
            u += span
            u *= rng
            other -= u
            rng *= size
            rng *= inside
            pq -= p
            np.copyto(now, contexts.c1, where=known)
            np.copyto(now, contexts.c2, where=hit)
            np.copyto(rng, pq, where=known)
            np.copyto(rng, p, where=hit)
            np.subtract(code, p, out=p)
            np.copyto(other, p, where=known)
            np.copyto(other, code, where=hit)
            code, other = other, code
            np.less(rng, _LEAST, out=need)
            np.multiply(need, _U(16), out=shift, dtype="u8", casting="unsafe")
            flat.take(at, out=word, mode="clip")
            np.multiply(word, need, out=word64, dtype="u8", casting="unsafe")
            at += need
            rng <<= shift
            code <<= shift
            code |= word64
            np.less(rng, _LEAST, out=need)
            left = np.flatnonzero(need)
            while len(left):
                code[left] = code[left] << _U(16) | flat.take(at[left], mode="clip")
                at[left] += 1
                rng[left] <<= _U(16)
                left = left[rng[left] < _LEAST]
            contexts.update(now, known)
            outcomes[k] = contexts.state
            last = now
        outcomes += (64 * knowns.view("u1")) - (32 * hits.view("u1"))
        missed = np.logical_not(knowns)
    return out - out.dtype.type(1)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: header, counts of ids, block index, blocks. The last block is filled up with id 0."""
    ids = np.asarray(ids)
    lanes = -(-len(ids) // block)
    steps = block if lanes > 1 else len(ids)
    prior = Order0(np.bincount(ids, minlength=1) + (np.arange(max(int(ids.max(initial=0)) + 1, 1)) == 0))
    padded = np.zeros(lanes * steps, ids.dtype)
    padded[: len(ids)] = ids
    padded = padded.reshape(lanes, -1) if lanes else padded
    parts, sums = [], []
    for at in range(0, lanes, LANES):
        some = padded[at : at + LANES]
        parts += _encode_lanes(prior, np.ascontiguousarray(some.T))
        sums += [zlib.crc32(x) for x in some.astype("<u4")]
    table = prior.to_bytes()
    index = np.array([[len(p) for p in parts], sums], "<u4").T.tobytes() if parts else b""
    head = struct.pack("<4sQIII", MAGIC, len(ids), steps, lanes, len(table))
    return head + table + index + b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block's checksum differs."""
    magic, total, steps, lanes, size = struct.unpack_from("<4sQIII", data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize("<4sQIII")
    prior = Order0.from_bytes(data[at : at + size])
    at += size
    index = np.frombuffer(data, "<u4", 2 * lanes, at).reshape(-1, 2)
    ends = at + 8 * lanes + np.cumsum(index[:, 0], dtype="i8")
    out = np.zeros((lanes, steps), "<u4")
    for first in range(0, lanes, LANES):
        blocks = [data[e - int(k) : e] for e, (k, _) in zip(ends[first : first + LANES].tolist(), index[first:], strict=False)]
        part = out[first : first + LANES]
        part[:] = _decode_lanes(prior, blocks, steps).T
        for k, (x, crc) in enumerate(zip(part, index[first:, 1].tolist(), strict=False)):
            if zlib.crc32(x) != crc:
                raise ValueError(f"block {first + k} is damaged")
    return out.reshape(-1)[:total]
