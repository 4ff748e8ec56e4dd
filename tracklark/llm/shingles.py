"""Word shingles as 64-bit numbers, computed for whole Arrow columns at a time.

Text bytes are lower-cased (A to Z), words stand between white space (\\x20, \\x09 to \\x0D). A word's number is a
polynomial over its bytes, got for all words of a chunk from one running sum; a shingle's number mixes those of its
words. Two different shingles share a number with a chance of 2^-64; sets are told apart by two such numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text worked on at a time; a longer text is a chunk of its own.
CHUNK = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


STEP = 0x9E3779B97F4A7C15
BYTE = mix(np.arange(1, 257, dtype=U) * U(STEP))
BASE = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_OF = BYTE[LOWER]
PLACE = mix(np.arange(300, 300 + WORDS + 1, dtype=U) * U(STEP)) | U(1)

#: Added for texts of fewer words than a shingle, by their number of words.
SHORT = PLACE[WORDS] * np.arange(WORDS, dtype=U)


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to size - 1 modulo 2^64, and their inverses."""
    one = lambda base: np.concatenate([[U(1)], np.full(size - 1, base, U)]).cumprod(dtype=U)
    return one(U(BASE)), one(U(pow(BASE, -1, 1 << 64)))


def powers_for(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(max(CHUNK, 1 << (size - 1).bit_length())) if size else powers(CHUNK)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and where each row's begin (one more at the end)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of rows: the first row, the words' numbers, and where each row's words begin (one more at the end)."""
    data, at = bytes_of(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        part = data[at[row] : at[end]]
        ends_of_rows = at[row : end + 1] - at[row]
        blank = SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[ends_of_rows] = True
        starts = np.flatnonzero(~blank & (np.append(True, blank[:-1]) | edge[:-1])) if len(part) else np.zeros(0, np.intp)
        ends = np.flatnonzero(~blank & (np.append(blank[1:], True) | edge[1:])) + 1 if len(part) else starts
        up, down = powers_for(len(part))
        total = np.append(U(0), np.cumsum(BYTE_OF[part] * up[: len(part)], dtype=U))
        number = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(STEP))
        yield row, number, np.searchsorted(starts, ends_of_rows)
        row = end


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its distinct shingles in rising order."""
    for _, words, at in words_of(column):
        n = len(words) - WORDS + 1
        many = mix(sum(words[k : k + n] * PLACE[k] for k in range(WORDS))) if n > 0 else np.zeros(0, U)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                own = np.sort(many[a : b - WORDS + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif b > a:
                yield mix((words[a:b] * PLACE[: b - a]).sum(dtype=U, keepdims=True) + SHORT[b - a])
            else:
                yield np.zeros(0, U)


def set_numbers(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers of a set."""
    spread = mix(tokens ^ U(STEP))
    total = np.array([spread.sum(dtype=U), (spread * (spread >> U(32) | U(1))).sum(dtype=U)]) + U(len(tokens) * BASE % (1 << 64))
    one, two = mix(total).view(np.int64).tolist()
    return one, two
