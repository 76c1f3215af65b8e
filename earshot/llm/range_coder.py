"""A context-mixing range coder for token ids below 2^16.

Three models predict each id, and their predictions are mixed: order 0 has the counts of the block's ids; orders 1 and 2 have the id
that last followed the previous one and the previous two, and how often in a row it did.  The mix gives each of the two
followers a weight that says how often, at such runs, it comes true in the block, and order 0 the rest; it drives a range coder.  The
counts and the weights precede a block's code.

Blocks are reset independently.  Many blocks are coded in step as the lanes of numpy arrays, which changes nothing in any block's
bytes.  Registers are whole numbers below 2^53 in doubles, and quotients are floored, so that every machine decodes what another
encoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 8192  # ids a block at most
LANES = 1024  # blocks in step; bounds the memory of a task

_PAIRS, _PAIR = 2048, 61  # places of order 2; an id times _PAIR plus the next one, modulo _PAIRS
_RUN = 3  # a follower's run counts up to this
_STATES = 16  # runs of both followers
_COUNT = 14  # bits that a count takes
_STEPS = 256  # that are turned from lanes to steps, or back, together
_TOTAL = 1 << 20  # what the mix's frequencies sum to
_WEIGHT = _TOTAL // 256 * 63 // 64  # of them, for a weight of 1; weights are at most 255 together, which leaves order 0 more than 2 * BLOCK
_FULL, _SHORT, _WORD = float(1 << 48), float(1 << 32), 65536.0
_HEAD, _HEAD_SIZE = "<HH", 4


class _Model:
    """What precedes a block's code: the distinct ids, how often each occurs, and the weights of both followers by state.

    Within a block an id is its place among the distinct ones.
    """

    def __init__(self, distinct: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.distinct, self.counts, self.weights = distinct, counts, weights
        self.length = int(counts.sum())
        self.below = np.cumsum(counts) - counts

    def shares(self) -> np.ndarray:
        """By state: what the follower of order 1 and that of order 2 have of the total, and what order 0 has for each time an id occurs."""
        one, two = (self.weights.reshape(2, _STATES) * _WEIGHT).astype(np.float64)
        scale = (_TOTAL - one - two) // max(self.length, 1)
        return np.stack([one, _TOTAL - one - scale * self.length, scale])

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.distinct, prepend=0)
        planes = np.concatenate([gaps & 255, gaps >> 8, self.counts & 255, self.counts >> 8, self.weights])
        packed = zlib.compress(planes.astype(np.uint8).tobytes())
        return struct.pack(_HEAD, len(gaps), len(packed)) + packed

    @classmethod
    def read(cls, code: bytes, length: int) -> tuple[_Model, bytes]:
        """The model and the coder's words after it."""
        try:
            size, packed = struct.unpack_from(_HEAD, code)
            planes = np.frombuffer(zlib.decompress(code[_HEAD_SIZE : _HEAD_SIZE + packed]), np.uint8).astype(np.int64)
            low, high, few, many = planes[: -2 * _STATES].reshape(4, size)
        except (struct.error, zlib.error) as error:
            raise ValueError("a block is damaged") from error
        model = cls(np.cumsum(low + (high << 8)), few + (many << 8), planes[-2 * _STATES :])
        if model.length != length or size and model.distinct[-1] >= 1 << 16 or model.weights.reshape(2, _STATES).sum(axis=0).max() > 255:
            raise ValueError("a block is damaged")
        return model, code[_HEAD_SIZE + packed :]


def _followers(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each id, what came last after its context (0 at first) and how often in a row it did."""
    order = np.argsort(context, kind="stable")
    context, ids = context.take(order), ids.take(order)
    last = np.concatenate([ids[:1], ids[:-1]])
    new = np.ones(len(ids), bool)
    np.not_equal(context[1:], context[:-1], out=new[1:])
    last *= ~new
    since = np.arange(len(ids), dtype=np.int16)
    new[1:] |= (ids != last)[:-1]
    since -= np.maximum.accumulate(since * new)
    follower, run = np.empty_like(last), np.empty_like(since)
    follower[order], run[order] = last, np.minimum(since, _RUN)
    return follower, run


def _part(ids, below, count, followers, true, weights, scale) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each id's part of the total: its share of order 0, and a follower's weight where that follower came true."""
    before, own = weights * (followers < ids), weights * true
    return scale * below + before[0] + before[1], scale * count + own[0] + own[1]


def _modelled(block: np.ndarray) -> tuple[_Model, np.ndarray, np.ndarray]:
    """A block's model, and the start and the size of each id's part."""
    ordered = np.sort(block.astype(np.uint16))
    begun = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    distinct = ordered[begun].astype(np.int64)
    place = np.empty(1 << 16, np.uint16)
    place[distinct] = np.arange(len(distinct))
    ids = place.take(block)
    before = np.concatenate([np.zeros(2, np.uint16), ids])
    # 16 bits may overflow: the last twelve are what counts.
    made = _followers(before[1:-1], ids), _followers(before[:-2] * np.uint16(_PAIR) + before[1:-1] & np.uint16(_PAIRS - 1), ids)
    followers = np.stack([made[0][0], made[1][0]])
    state = made[0][1] * (_RUN + 1) + made[1][1]
    true = followers == ids
    # Where both followers are one, it is order 2 that comes true.
    seen = np.bincount(state * 4 + true[0] * 2 + true[1], minlength=4 * _STATES).reshape(_STATES, 4)
    weights = np.concatenate([seen[:, 2], seen[:, 1] + seen[:, 3]]) * 255 // np.tile(np.maximum(seen.sum(axis=1), 1), 2)
    model = _Model(distinct, np.diff(begun, append=len(block)), weights)
    shares = np.stack([share.take(state) for share in model.shares()])
    return model, *_part(ids, model.below.take(ids), model.counts.take(ids), followers, true, shares[:2], shares[2])


def _longest_first(lengths: list[int]) -> np.ndarray:
    return np.argsort(-np.array(lengths, np.int64), kind="stable")


def _stretches(lengths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(from, to, lanes): which steps have how many of the lanes, whose lengths descend; some steps at a time."""
    for m in range(len(lengths), 0, -1):
        end = lengths[m - 1]
        for begin in range(lengths[m] if m < len(lengths) else 0, end, _STEPS):
            yield begin, min(begin + _STEPS, end), m


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's bytes; at most LANES blocks at once, of at most BLOCK ids."""
    if any(len(b) > BLOCK or len(b) and int(b.max()) >= 1 << 16 for b in blocks):
        raise ValueError(f"blocks have at most {BLOCK} ids, which must be below 65536")
    order = _longest_first([len(b) for b in blocks])
    lengths = [len(blocks[i]) for i in order]
    longest, lanes = max(lengths, default=0), len(blocks)
    starts, sizes, models = np.zeros((lanes, longest), np.uint32), np.zeros((lanes, longest), np.uint32), []
    for lane, i in enumerate(order):
        model, starts[lane, : lengths[lane]], sizes[lane, : lengths[lane]] = _modelled(blocks[i])
        models.append(model)
    first = np.arange(lanes) * (longest + 3)
    out = np.zeros(lanes * (longest + 3), np.uint32)
    all_at, all_low, all_span = first.copy(), np.zeros(lanes), np.full(lanes, _FULL)
    for begin, end, m in _stretches(lengths):
        at, low, span = all_at[:m], all_low[:m], all_span[:m]
        turned = (some[:m, begin:end].T.astype(np.float64, order="C") for some in (starts, sizes))
        for start, size in zip(*turned, strict=True):
            unit = np.floor(span * (1 / _TOTAL))
            base, part = low + unit * start, unit * size
            # A word above 16 bits carries into those before it, which is made up for at the end.
            word, settled = np.floor(base * (1 / _SHORT)), part < _SHORT
            out[at] = word
            at += settled
            shift = settled * (_WORD - 1) + 1
            np.multiply(base - word * settled * _SHORT, shift, out=low)
            np.multiply(part, shift, out=span)
    for _ in range(3):
        word = np.floor(all_low / _SHORT)
        out[all_at] = word
        all_low = (all_low - word * _SHORT) * _WORD
        all_at += 1
    words = out.reshape(lanes, longest + 3)
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    used, words = all_at - first, words.astype("<u2")
    made: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        made[i] = models[lane].to_bytes() + words[lane, : used[lane]].tobytes()
    return made


def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids (unsigned 32-bit) of each block; at most LANES blocks at once."""
    order = _longest_first(lengths)
    read = [_Model.read(coded[i], lengths[i]) for i in order]
    lengths = [lengths[i] for i in order]
    longest, lanes = max(lengths, default=0), len(coded)
    width = max((len(words) for _, words in read), default=0) // 2 + 3
    data = np.zeros((lanes, width), np.uint16)
    # Here an id is its place among those of all blocks; a block's begin at its base, and one without ids has a place too.
    sizes = np.array([max(len(model.counts), 1) for model, _ in read], np.int64)
    bases = np.cumsum(sizes) - sizes
    order_0, place_of = np.zeros(sizes.sum(), np.int32), np.zeros((lanes, longest), np.uint16)
    shares = np.zeros((lanes, _STATES), np.complex128)  # of order 1 and, as the other part, order 0, so that one look finds both
    for lane, (model, words) in enumerate(read):
        n, base = len(model.counts), bases[lane]
        data[lane, : len(words) // 2] = np.frombuffer(words, "<u2", len(words) // 2)
        order_0[base : base + n] = (model.below << _COUNT) + model.counts
        place_of[lane, : lengths[lane]] = np.repeat(np.arange(n), model.counts)
        one, _, scale = model.shares()
        shares[lane] = one + 1j * scale
    all_code = (data[:, 0] * _WORD + data[:, 1]) * _WORD + data[:, 2]
    all_at, all_span = np.arange(lanes) * width + 3, np.full(lanes, _FULL)
    all_previous, all_older, all_lengths = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.array(lengths, np.float64)
    data, place_of, shares = data.reshape(-1), place_of.reshape(-1), shares.reshape(-1)
    # A follower is held as (_RUN + 1) * the number of lower ids in its block + run; those of order 2 come after those of order 1.
    last = np.zeros(len(order_0) + lanes * _PAIRS, np.uint16)
    ids = np.zeros((lanes, longest), np.uint16)
    for begin, end, m in _stretches(lengths):
        code, span, at, previous, older, length = (x[:m] for x in (all_code, all_span, all_at, all_previous, all_older, all_lengths))
        lane = np.arange(m)
        base, pairs, rows, states = bases[:m], lane * _PAIRS + len(order_0), lane * longest, lane * _STATES
        context, weights, found = np.empty((2, m), np.int64), np.empty((2, m)), np.empty((end - begin, m), np.uint16)
        for t in range(end - begin):
            np.add(previous, base, out=context[0])
            np.add(older + previous & _PAIRS - 1, pairs, out=context[1])
            entry = last.take(context)
            followers, runs = entry >> 2, entry & _RUN
            share = shares.take((runs[0] << 2) + runs[1] + states)
            scale = share.imag.copy()
            weights[0] = share.real
            np.subtract(_TOTAL - weights[0], scale * length, out=weights[1])
            unit = np.floor(span * (1 / _TOTAL))
            target = np.minimum(np.floor(code / unit), _TOTAL - 1)
            # Without what lies in a follower's own weight, the rest is order 0's.
            starts = scale * followers
            later = followers[1] < followers[0]
            starts[0] += weights[1] * later
            starts[1] += weights[0] * ~later
            inside = np.minimum(np.maximum(target - starts, 0), weights)
            target -= inside[0] + inside[1]
            current = place_of.take(rows + (target / scale).astype(np.int64))
            own = order_0.take(base + current)
            below = (own >> _COUNT).astype(np.uint16)
            true = followers == below
            start, size = _part(below, below, own & (1 << _COUNT) - 1, followers, true, weights, scale)
            part = unit * size
            settled = part < _SHORT
            shift = settled * (_WORD - 1) + 1
            np.add((code - unit * start) * shift, data.take(at, mode="clip") * settled, out=code)
            np.multiply(part, shift, out=span)
            at += settled
            last[context] = (below << 2) + true * np.minimum(runs + 1, _RUN)
            np.multiply(previous, _PAIR, out=older)
            previous[:] = current
            found[t] = current
        ids[:m, begin:end] = found.T
    made: list[np.ndarray] = [np.empty(0, "<u4")] * lanes
    for lane, i in enumerate(order):
        made[i] = read[lane][0].distinct[ids[lane, : lengths[lane]]].astype("<u4") if lengths[lane] else made[i]
    return made
