"""64-bit hashes of the words of a text, for many words at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BYTES = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of text worked on at once; it bounds memory for texts of any length.  Words of more than LONG bytes are hashed one by one.
CHUNK, LONG = 1 << 20, 1 << 16
BLANKS = b" \t\n\x0b\x0c\r"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(CHUNK, BASE)
    down = np.full(CHUNK, np.uint64(pow(int(BASE), -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _of_chunk(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(BYTES[a] * up[: len(a)], out=prefix[1:])
    out = mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of anything but ASCII white space) of lower-cased bytes."""
    if len(raw) <= CHUNK:
        return _of_chunk(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            cut = max(raw.rfind(b, at, end) for b in (BLANKS[i : i + 1] for i in range(len(BLANKS))))
            if cut < at:  # one word fills the chunk
                stops = [x for x in (raw.find(BLANKS[i : i + 1], end) for i in range(len(BLANKS))) if x >= 0]
                end = min(stops, default=len(raw))
                parts.append(np.array([xxhash.xxh64_intdigest(raw[at:end])], np.uint64))
                at = end
                continue
            end = cut + 1
        parts.append(_of_chunk(raw[at:end]))
        at = end
    return np.concatenate(parts)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # powers of two are doubled; the set bits of width are put together from them
    out, have, part, size = np.zeros(len(words), np.uint64), 0, words, 1
    while size <= width:
        if width & size:
            out = out[: len(words) - have - size + 1] * np.uint64(pow(int(BASE), size, 2**64)) + part[have : len(words) - size + 1]
            have += size
        if size * 2 <= width:
            part = part[:-size] * np.uint64(pow(int(BASE), size, 2**64)) + part[size:]
        size *= 2
    return mixed(out[:n])
