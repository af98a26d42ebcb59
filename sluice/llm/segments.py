"""Values of texts put together from the values of their segments.

A byte-level pre-tokenizer never joins what stands on both sides of some
places, so ids and counts of a text are those of its segments in a row. Texts
of natural language repeat their segments, so a worker computes a segment's
values once and looks it up afterwards. All steps are array operations on a
piece of text at a time; Python objects are made for new segments only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

PIECE = 1 << 18
#: Segments longer than this are worked out each time; they hardly recur.
LONG = 1 << 12
MAX_SEGMENTS = 1_500_000
MAX_BYTES = 32 << 20
_FACTOR, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _marked(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


BLANK = _marked((9, 13), (32, 32))
#: ASCII that is neither white space nor a control character.
SHOWN = _marked((33, 126))
ALNUM = _marked((48, 57), (65, 90), (97, 122))
STOP = np.zeros(256, dtype=bool)
STOP[list(b".,;:!?")] = True
#: Lead bytes whose two-byte characters (from U+00C0) are never white space, and three-byte ones (from U+4000).
LEAD2, LEAD3 = _marked((0xC3, 0xDF)), _marked((0xE4, 0xEF))


def starts_of(data: np.ndarray, heads: np.ndarray | int = 0) -> np.ndarray:
    """Where segments begin: at ``heads``, at white space after anything else, and at a stop after an ASCII letter or digit.

    The latter are places that every pre-token ends at. Where the byte before may
    belong to white space beyond ASCII there is no cut.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(data), dtype=bool)
    solid = SHOWN[data[:-1]]
    solid[1:] |= LEAD2[data[:-2]]
    solid[2:] |= LEAD3[data[:-3]]
    cut[1:] = BLANK[data[1:]] & solid | STOP[data[1:]] & ALNUM[data[:-1]]
    cut[heads] = True
    return np.flatnonzero(cut)


def joinable(segment: bytes) -> bool:
    """Whether a cut is certain at both ends among segments like this one."""
    return bool(BLANK[segment[0]]) and (bool(SHOWN[segment[-1]]) or len(segment) > 2 and bool(LEAD2[segment[-2]]))


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The text in parts of about ``PIECE`` bytes that begin where segments begin."""
    data, at, size = np.frombuffer(text, dtype=np.uint8), 0, PIECE
    while len(data) - at > size:
        cuts = starts_of(data[at:at + size])
        if len(cuts) < 2:
            size *= 2
            continue
        yield data[at:at + int(cuts[-1])]
        at, size = at + int(cuts[-1]), PIECE
    if at < len(data):
        yield data[at:]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of ragged spans, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype) -> None:
        self.array, self.size = np.zeros(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.array):
            wider = np.zeros(max(need, 2 * len(self.array)), dtype=self.array.dtype)
            wider[:self.size] = self.array[:self.size]
            self.array = wider
        self.array[self.size:need] = values
        self.size = need


class SegmentTable:
    """Values of known segments, found by hash and proven by their bytes.

    ``learn`` takes distinct segments and gives their values, one after the
    other, and how many each has. What it has given is kept for up to
    ``max_segments`` segments and then forgotten all at once.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, max_segments: int = MAX_SEGMENTS) -> None:
        self.learn, self.dtype, self.max_segments = learn, dtype, max_segments
        self.slots_bits = max(12, (4 * max_segments).bit_length() - 1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << self.slots_bits, -1, dtype=np.int32)
        self.keys, self.at, self.length = _Grown(np.uint64), _Grown(np.int64), _Grown(np.int64)
        self.value_at, self.value_count = _Grown(np.int64), _Grown(np.int64)
        self.bytes, self.values = _Grown(np.uint8), _Grown(self.dtype)

    def text(self, text: bytes) -> np.ndarray:
        """Values of one text."""
        return np.concatenate([self.piece(p, starts_of(p))[0] for p in pieces(text)] or [np.zeros(0, dtype=self.dtype)])

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts, one after the other, and how many each has."""
        found, counts, block, size = [], np.zeros(len(texts), dtype=np.int64), [], 0
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                found.append(self._block(texts, block, counts))
                found.append(self.text(text))
                counts[i], block, size = len(found[-1]), [], 0
            elif text:
                block.append(i)
                size += len(text)
                if size > PIECE:
                    found.append(self._block(texts, block, counts))
                    block, size = [], 0
        found.append(self._block(texts, block, counts))
        return np.concatenate(found), counts

    def _block(self, texts: list[bytes], block: list[int], counts: np.ndarray) -> np.ndarray:
        if not block:
            return np.zeros(0, dtype=self.dtype)
        data = np.frombuffer(b"".join([texts[i] for i in block]), dtype=np.uint8)
        heads = np.concatenate([[0], np.cumsum([len(texts[i]) for i in block])[:-1]])
        starts = starts_of(data, heads)
        values, per_segment = self.piece(data, starts)
        before = np.concatenate([[0], np.cumsum(per_segment)])[np.searchsorted(starts, heads)]
        counts[block] = np.diff(np.append(before, len(values)))
        return values

    def piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the segments that begin at ``starts``, and how many each has."""
        if self.keys.size > self.max_segments or self.bytes.size > MAX_BYTES:
            self._clear()
        lengths = np.diff(np.append(starts, len(data)))
        keys = self._hash(data, starts, lengths)
        entry = self._find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            short = new[lengths[new] <= LONG]
            _, first, where = np.unique(keys[short], return_index=True, return_inverse=True)
            entry[short] = self._enter(data, starts[short[first]], lengths[short[first]], keys[short[first]])[where]
            for i in new[lengths[new] > LONG]:
                entry[i] = self._append(data, starts[i:i + 1], lengths[i:i + 1], keys[i:i + 1])[0]
        # Equal hashes of different segments: these few are worked out on their own.
        held = self.bytes.array[spans(self.at.array[entry], np.minimum(lengths, self.length.array[entry]))]
        if len(held) != len(data) or not np.array_equal(held, data):
            for i in range(len(starts)):
                e = entry[i]
                known = self.bytes.array[self.at.array[e]:self.at.array[e] + self.length.array[e]]
                if not np.array_equal(known, data[starts[i]:starts[i] + lengths[i]]):
                    entry[i] = self._append(data, starts[i:i + 1], lengths[i:i + 1], keys[i:i + 1])[0]
        counts = self.value_count.array[entry]
        return self.values.array[spans(self.value_at.array[entry], counts)], counts

    def _hash(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            n = max(len(data), PIECE + LONG) + 1
            self.powers, self.inverses = (np.cumprod(np.full(n, f, dtype=np.uint64)) * np.uint64(pow(f, -1, 1 << 64)) for f in (_FACTOR, _INVERSE))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        found = (sums[starts + lengths] - sums[starts]) * self.inverses[starts] + lengths.astype(np.uint64)
        return (found ^ found >> np.uint64(29)) * _MIX

    def _find(self, keys: np.ndarray) -> np.ndarray:
        mask, entry = len(self.slots) - 1, np.full(len(keys), -1, dtype=np.int64)
        rest, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.slots_bits)).astype(np.int64)
        while len(rest):
            held = self.slots[slot]
            same = (held >= 0) & (self.keys.array[held] == keys[rest])
            entry[rest[same]] = held[same]
            on = (held >= 0) & ~same
            rest, slot = rest[on], (slot[on] + 1) & mask
        return entry

    def _enter(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        entry = self._append(data, starts, lengths, keys)
        mask, rest, slot = len(self.slots) - 1, entry, (keys >> np.uint64(64 - self.slots_bits)).astype(np.int64)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            on = self.slots[slot] != rest
            rest, slot = rest[on], (slot[on] + 1) & mask
        return entry

    def _append(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        values, counts = self.learn([raw[a:a + n] for a, n in zip(starts.tolist(), lengths.tolist())])
        entry = self.keys.size + np.arange(len(keys))
        self.keys.add(keys)
        self.at.add(self.bytes.size + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.bytes.add(data[spans(starts, lengths)])
        self.value_at.add(self.values.size + np.cumsum(counts) - counts)
        self.value_count.add(counts)
        self.values.add(values)
        return entry
