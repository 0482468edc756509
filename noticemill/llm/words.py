"""Words of whole texts as numpy arrays, found in the bytes of an Arrow column.

A word is a run of bytes other than space and the controls 9 to 13, as ``[^\\x20\\x09-\\x0D]+``. Its
fingerprint has 64 bits; with ``fold`` the letters A to Z count as a to z. For a word of up to
``SHORT`` bytes it is a multilinear hash: every byte's random number times a random number of its place,
summed modulo 2**64, and its length. Two such words share a fingerprint only if the random numbers, drawn
once for all, happen to satisfy the equation that sets their sums equal; there are no patterns, as
repetitions or complements, that make them do so. A longer word's fingerprint is the first 64 bits of its
BLAKE2b digest. So a vocabulary of 10**8 words has a pair with one fingerprint with a chance below one
in a thousand.

A long text is read in segments that end between words, so beside its bytes only arrays by word are
held: with words of six bytes about three bytes for each byte of text, eight if all words have one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone and whole, read in such segments.
CHUNK_BYTES = 1 << 20
#: The longest word, in bytes, with a multilinear fingerprint.
SHORT = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Signs between which and a letter words may be cut.
CUTS = b".,;:!?*$%&#()"
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(CUTS)] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_RANDOM = np.random.Generator(np.random.PCG64(20))
_EXACT = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _EXACT[_LOWER]
_PLACES = _RANDOM.integers(1, 2**63, SHORT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of the texts ``first`` to ``last`` (exclusive) of a column. ``of[i]:of[i + 1]`` are the
    words of the i-th of these texts; word k is ``data[starts[k]:ends[k]]``."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    prints: np.ndarray

    def bytes(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def text(self, k: int) -> str:
        return self.bytes(k).decode()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    held = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return ends.astype(np.int64), held


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts with at most ``most`` bytes together, or a single longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _segments(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK_BYTES`` of a text's bytes, each but the last ending with a space."""
    begin = 0
    while begin < len(part):
        end = at = begin + CHUNK_BYTES
        while end < len(part):
            spaces = np.flatnonzero(_SPACE[part[at : at + (1 << 16)]])
            if len(spaces):
                end = at + int(spaces[0]) + 1
                break
            at += 1 << 16
            end = at
        end = min(end, len(part))
        yield begin, end
        begin = end


def _found(part: np.ndarray, cuts: np.ndarray, fold: bool, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of the words of some bytes, which are also cut at ``cuts``."""
    solid = ~_SPACE[part]
    begins = solid.copy()
    ends_here = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends_here[:-1] &= ~solid[1:]
    begins[cuts] = solid[cuts]
    ends_here[cuts - 1] = solid[cuts - 1]
    if cut:
        letter, sign = _LETTER[part], _SIGN[part]
        between = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:]))
        begins[between + 1] = True
        ends_here[between] = True
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(ends_here) + 1
    lengths = ends - starts
    # bytes of longer words take no part in the sums
    long = np.flatnonzero(lengths > SHORT)
    for k in long:
        solid[starts[k] + SHORT : ends[k]] = False
    summed = np.minimum(lengths, SHORT)
    first = np.cumsum(summed) - summed
    place = np.arange(int(summed.sum()), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), summed)
    values = (_FOLDED if fold else _EXACT)[part[solid]] * _PLACES[place]
    sums = np.add.reduceat(values, first) if len(first) else np.zeros(0, dtype=np.uint64)
    prints = mix(sums + lengths.astype(np.uint64) * _LENGTH)
    for k in long:
        word = part[starts[k] : ends[k]]
        digest = hashlib.blake2b((_LOWER[word] if fold else word).tobytes(), digest_size=8).digest()
        prints[k] = np.frombuffer(digest, dtype="<u8")[0]
    return starts, ends, prints


def find_words(column: pa.Array, fold: bool, cut: bool = False) -> Iterator[Words]:
    """The words of every text of a column, chunk by chunk and in order. With ``cut``, a word also
    ends between an ASCII letter and one of the signs ``CUTS``."""
    offsets, data = text_bytes(column)
    for first, last in chunks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        if len(part) <= CHUNK_BYTES:
            inner = at[(at > 0) & (at < len(part))]
            starts, ends, prints = _found(part, inner, fold, cut)
        else:
            none = np.zeros(0, dtype=np.int64)
            kind = np.int32 if len(part) < 1 << 31 else np.int64
            found = []
            for a, e in _segments(part):
                starts, ends, prints = _found(part[a:e], none, fold, cut)
                found.append(((starts + a).astype(kind), (ends + a).astype(kind), prints))
            starts, ends, prints = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
        yield Words(first, last, part, starts, ends, np.searchsorted(starts, at), prints)


def per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's words."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[of[1:]] - sums[of[:-1]]
