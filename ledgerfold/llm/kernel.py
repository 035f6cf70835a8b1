"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

Words, their 64-bit hashes and word shingles are found for all texts of a block at
once, without a Python loop over words. A block holds some texts or a single long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_M1, _M2, _GOLD, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def lookup(kept: str, lower: bool = True) -> np.ndarray:
    """256 bytes: 0 for separators, else the byte itself or its ASCII lower case.

    ``kept``: ``space`` splits at ASCII white space, ``alnum`` keeps ASCII letters, digits and all bytes from 0x80,
    ``letter`` the same without digits.
    """
    table = np.arange(256, dtype=np.uint8)
    if kept == "space":
        table[0] = 0xFF  # no byte of UTF-8, so that NUL stays part of a word
        table[[0x20, *range(0x09, 0x0E)]] = 0
    else:
        for b in range(128):
            if not (chr(b).isalpha() or kept == "alnum" and chr(b).isdigit()):
                table[b] = 0
    if lower:
        table[ord("A") : ord("Z") + 1] = np.where(table[ord("A") : ord("Z") + 1] > 0, np.arange(ord("a"), ord("z") + 1), 0)
    return table


SPACE, ALNUM, LETTER = lookup("space"), lookup("alnum"), lookup("letter")


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


class Block(NamedTuple):
    """Texts ``first`` to ``last`` (exclusive) of a batch: their bytes and where each begins (one more than texts)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch's texts (null: empty) in blocks of about ``limit`` bytes; no text is divided."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def whole(texts: pa.ChunkedArray) -> pa.Array:
    """All chunks as one array."""
    return pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in texts.chunks)])


class Words(NamedTuple):
    """``norm``: bytes after the table, 0 between words. ``of``: index of each text's first word (one more than texts)."""

    norm: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray


def words(block: Block, table: np.ndarray) -> Words:
    return spans(table[block.data], block.offsets)


def spans(norm: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of bytes that are 0 between words; none runs from one text into the next."""
    inside = norm != 0
    n = len(norm)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(norm, starts, ends, np.searchsorted(starts, offsets))


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, so that they sort as text does."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    return (lanes[starts] & _MASK[np.minimum(ends - starts, 8)]).byteswap()


def hash_spans(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a step."""
    lanes = np.ndarray((len(norm) + 1,), "<u8", np.concatenate([norm, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = ends - starts
    h = mix((lanes[starts] & _MASK[np.minimum(size, 8)]) ^ size.astype(U) * _GOLD)
    left, at = np.flatnonzero(size > 8), 8
    while left.size:
        h[left] = mix(h[left] * STEP + (lanes[starts[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    return h


def shingles(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles in order, repeats included, and where each text's begin.

    A text with fewer words, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(of)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], U)
    text = np.repeat(np.arange(len(n)), count)
    first = of[:-1][text] + (np.arange(at[-1]) - at[:-1][text])
    width = np.minimum(n, k)[text]
    for w in np.unique(width):
        pick = np.flatnonzero(width == w)
        begin = first[pick]
        s = np.full(len(pick), U(int(w)))
        for j in range(int(w)):
            s = s * STEP + h[begin + j]
        out[pick] = mix(s)
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and once each, and where each text's begin."""
    values = values.copy()
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            values[i:j].sort()
    if not len(values):
        return values, at
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]
