"""Minimal acyclic transducers from sorted words to their ordinals."""

from __future__ import annotations

import io
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Transducer:
    """States with an arc for each byte that goes on; the outputs along a word add up to its ordinal.

    A state's bytes are four 64-bit maps; ``first`` is the arc of the lowest byte of each map, and the arc of another
    byte lies as many further as there are lower bytes in the map.
    """

    start: int
    final: np.ndarray
    maps: np.ndarray
    first: np.ndarray
    target: np.ndarray
    output: np.ndarray

    def __len__(self) -> int:
        return len(self.final)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, start=self.start, final=self.final, maps=self.maps, first=self.first, target=self.target, output=self.output)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        with np.load(io.BytesIO(raw)) as kept:
            return cls(int(kept["start"]), *(kept[k] for k in ("final", "maps", "first", "target", "output")))

    def ordinals(self, words: pa.Array) -> np.ndarray:
        """The ordinal of each word (binary), -1 for those that are not in it. All words take a step at a time."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw = words.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        out = np.full(len(words), -1, np.int64)
        alive, at, ends = np.arange(len(words)), offsets[:-1].astype(np.int64), offsets[1:]
        state, ordinal = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        one = np.uint64(1)
        while len(alive):
            done = at == ends[alive]
            if done.any():
                here = np.flatnonzero(done & self.final[state])
                out[alive[here]] = ordinal[here]
                alive, at, state, ordinal = (x[~done] for x in (alive, at, state, ordinal))
            byte = data[at]
            spot = 4 * state + (byte >> 6)
            have, bit = self.maps[spot], one << (byte & 63).astype(np.uint64)
            goes = np.flatnonzero(have & bit)
            arc = self.first[spot[goes]] + np.bitwise_count(have[goes] & (bit[goes] - one))
            alive, at = alive[goes], at[goes] + 1
            ordinal = ordinal[goes] + self.output[arc]
            state = self.target[arc].astype(np.int64)
        return out

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal."""
        state, out = self.start, bytearray()
        while not (self.final[state] and ordinal == 0):
            best = None
            for m in range(4):
                have, arc = int(self.maps[4 * state + m]), int(self.first[4 * state + m])
                for byte in range(64):
                    if have >> byte & 1:
                        if self.output[arc] <= ordinal:
                            best = 64 * m + byte, arc
                        arc += 1
            if best is None:
                raise IndexError("no word has this ordinal")
            out.append(best[0])
            ordinal -= int(self.output[best[1]])
            state = int(self.target[best[1]])
        return bytes(out)


def minimal(words: Iterable[bytes]) -> Transducer:
    """The transducer with the fewest states for different words in ascending byte order.

    A state is closed when the words have passed it: an equal one that is closed already, with the same finality and
    the same arcs, stands for it.
    """
    closed: dict[tuple, int] = {}
    counts: list[int] = []
    path: list[list] = [[False]]
    before = b""

    def close_beyond(depth: int) -> None:
        while len(path) > depth + 1:
            parts = tuple(path.pop())
            state = closed.get(parts)
            if state is None:
                state = closed[parts] = len(counts)
                counts.append(parts[0] + sum(counts[child] for _, child in parts[1:]))
            path[-1].append((before[len(path) - 1], state))

    for i, word in enumerate(words):
        if i and word <= before:
            raise ValueError("words must differ and ascend")
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        close_beyond(shared)
        path.extend([False] for _ in range(len(word) - shared))
        path[-1][0] = True
        before = word
    close_beyond(0)
    start = closed.setdefault(tuple(path[0]), len(counts))

    final = np.zeros(len(closed), bool)
    maps = np.zeros((len(closed), 256), bool)
    target, output, sizes = [], [], np.zeros((len(closed), 4), np.int64)
    for parts, state in closed.items():
        final[state] = parts[0]
        seen = int(parts[0])
        for byte, child in parts[1:]:
            maps[state, byte] = True
            sizes[state, byte >> 6] += 1
            target.append(child)
            output.append(seen)
            seen += counts[child]
    packed = np.packbits(maps, axis=1, bitorder="little").view(np.uint64).ravel()
    first = np.cumsum(sizes.ravel()) - sizes.ravel()
    return Transducer(start, final, packed, first.astype(np.int32), np.array(target, np.int32), np.array(output, np.int64))
