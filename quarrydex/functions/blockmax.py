"""Compressed blocks of postings with greatest impacts, and the best documents over them (Block-Max WAND).

A shard is a bounded number of documents, whose places are 0, 1, ... in the order of their ids.  The postings of a term in a
shard are cut into blocks; each block has its last place and greatest impact beside it, so that whole blocks are passed by
without being decompressed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Postings in a block.
BLOCK = 128
#: Postings whose bytes are put in place at once, about.
RUN = 1 << 16
#: Stretches that are looked at first; each further look takes twice as many.
FIRST_LOOK = 8


def byte_code(most: np.ndarray) -> np.ndarray:
    """0, 1, 2 for values that need 1, 2 or 4 bytes."""
    return np.where(most < 1 << 8, 0, np.where(most < 1 << 16, 1, 2)).astype(np.int64)


def pack(term: np.ndarray, place: np.ndarray, planes: list[np.ndarray], impact: np.ndarray, block: int = BLOCK) -> dict[str, pa.Array]:
    """Postings, sorted by term and place, as a row for each term: n, last, most, width, payload.

    Places are stored as steps from the posting before, less one; steps and each of ``planes`` (whole numbers of the posting,
    as its count) take 1, 2 or 4 bytes a value, as the block needs.  ``last`` and ``most`` have a value for each block,
    ``width`` a byte with two bits for each plane, steps lowest.
    """
    n = len(term)
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    blocks = -(-count // block)
    start = np.repeat(first - block * (np.cumsum(blocks) - blocks), blocks) + block * np.arange(int(blocks.sum()))
    size = np.diff(np.concatenate((start, [n])))
    step = np.diff(place, prepend=-1) - 1
    step[first] = place[first]
    planes = [step, *planes]
    codes = [byte_code(np.maximum.reduceat(v, start)) for v in planes]
    bytes_ = size * sum(1 << c for c in codes)
    base = np.cumsum(bytes_) - bytes_
    payload = np.zeros(int(bytes_.sum()), np.uint8)
    runs = np.unique(np.append(np.searchsorted(start, np.arange(0, n, RUN)), len(start)))
    for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()):
        at, sizes, begins = slice(int(start[lo]), int(start[hi - 1] + size[hi - 1])), size[lo:hi], base[lo:hi]
        inside = np.arange(at.start, at.stop) - np.repeat(start[lo:hi], sizes)
        for values, c in zip(planes, codes):
            width = np.repeat(1 << c[lo:hi], sizes)
            where = np.repeat(begins, sizes) + inside * width
            for j in range(4):
                own = width > j
                payload[where[own] + j] = (values[at][own] >> (8 * j)) & 255
            begins = begins + sizes * (1 << c[lo:hi])
    cuts = np.concatenate(([0], np.cumsum(blocks)))
    of_term = np.concatenate(([0], np.cumsum(np.add.reduceat(bytes_, cuts[:-1]))))
    offsets = pa.array(cuts.astype(np.int32))
    codes = sum(c << (2 * k) for k, c in enumerate(codes)).astype(np.uint8)
    return {
        "n": pa.array(count),
        "last": pa.ListArray.from_arrays(offsets, pa.array(place[start + size - 1].astype(np.int32))),
        "most": pa.ListArray.from_arrays(offsets, pa.array(np.maximum.reduceat(impact, start))),
        "width": pa.Array.from_buffers(pa.binary(), len(count), [None, offsets.buffers()[1], pa.py_buffer(codes.tobytes())]),
        "payload": pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(of_term.astype(np.int32).tobytes()), pa.py_buffer(payload.tobytes())]),
    }


@dataclass
class Postings:
    """The postings of a term in a shard; ``impact`` (places, then each plane) is what a posting adds, but for the term's weight."""

    n: int
    last: np.ndarray
    most: np.ndarray
    width: bytes
    payload: bytes
    impact: Callable[..., np.ndarray]
    planes: int = 1
    block: int = BLOCK
    read: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        codes = np.frombuffer(self.width, np.uint8).astype(np.int64)
        self.widths = [1 << ((codes >> (2 * k)) & 3) for k in range(self.planes + 1)]
        self.size = np.full(len(codes), self.block, np.int64)
        self.size[-1] = self.n - self.block * (len(codes) - 1)
        self.end = np.cumsum(self.size * sum(self.widths))

    def decompressed(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of a block, decompressed once."""
        if b not in self.read:
            n, widths = int(self.size[b]), [int(w[b]) for w in self.widths]
            at = int(self.end[b]) - n * sum(widths)
            values = []
            for w in widths:
                values.append(np.frombuffer(self.payload, f"<u{w}", n, at).astype(np.int64))
                at += n * w
            place = np.cumsum(values[0] + 1) + (int(self.last[b - 1]) if b else -1)
            self.read[b] = place, self.impact(place, *values[1:])
        return self.read[b]

    def places(self) -> np.ndarray:
        return np.concatenate([self.decompressed(b)[0] for b in range(len(self.last))])


def best(lists: list[tuple[Postings, float]], documents: int, k: int, floor: float = 0, among: np.ndarray | None = None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best of a shard with a score above 0 and not below ``floor``; equal scores by place.

    Stretches lie between the borders of blocks, so within one no list changes its block.  A shallow move of all pointers to a
    stretch looks at last places and greatest impacts alone; the blocks' impacts add up to the most that any document in the
    stretch can have.  Stretches below the threshold are left, their blocks stay compressed; the threshold is the k-th best
    score so far, or ``floor``.  The most promising come first, as the threshold rises sooner.  ``among`` (a flag for each
    place) leaves some documents alone; scores are rounded to ``digits`` before they are compared.
    """
    slack = 0 if digits is None else 10.0**-digits
    places, scores = np.zeros(0, np.int64), np.zeros(0)
    if not lists:
        return places, scores
    borders = np.unique(np.concatenate([p.last for p, _ in lists])).astype(np.int64)
    start = np.concatenate(([0], borders[:-1] + 1))
    block, bound = [], 0
    for p, weight in lists:
        b = np.searchsorted(p.last, start)
        block.append(b)
        bound = bound + weight * np.concatenate((p.most, [0]))[b]
    order = np.argsort(-bound, kind="stable")
    at, look = 0, FIRST_LOOK
    while at < len(order):
        chosen = order[at : at + look]
        chosen = np.sort(chosen[(bound[chosen] >= floor - slack) & (bound[chosen] > 0)])
        if not len(chosen):
            break
        inside = np.zeros(documents + 1, np.int8)
        np.add.at(inside, start[chosen], 1)
        np.add.at(inside, borders[chosen] + 1, -1)
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        total = np.zeros(documents, bound.dtype)
        for (p, weight), b in zip(lists, block):
            for x in np.unique(b[chosen]).tolist():
                if x < len(p.last):
                    place, impact = p.decompressed(x)
                    own = inside[place]
                    total[place[own]] += weight * impact[own]
        if digits is not None:
            total = np.round(total, digits)
        found = np.flatnonzero((total > 0) & (total >= floor) & (True if among is None else among))
        places, scores = np.concatenate((places, found)), np.concatenate((scores.astype(total.dtype), total[found]))
        first = np.lexsort((places, -scores))[:k]
        places, scores = places[first], scores[first]
        if len(scores) == k:
            floor = max(floor, scores[-1])
        at += look
        look *= 2
    return places, scores


@dataclass
class Floors:
    """The k best scores of each query in the shards seen so far; the k-th is the floor of further shards."""

    k: int
    scores: dict[int, np.ndarray] = field(default_factory=dict)

    def of(self, query: int):
        held = self.scores.get(query)
        return 0 if held is None or len(held) < self.k else held[0]

    def add(self, query: int, new: np.ndarray) -> None:
        held = self.scores.get(query)
        self.scores[query] = np.sort(new if held is None else np.concatenate((held, new)))[-self.k :]
