"""Byte-level helpers shared by the text operators.

Everything works on whole texts as numpy byte arrays taken straight from
Arrow buffers. Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``;
as all these are single-byte characters, word ends never cut a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The white space that separates words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, _U64), "down": np.ones(1, _U64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS["up"])) if n < 1 << 24 else n
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, _U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, independent of where the span stands.

    One cumulative polynomial sum serves all spans, so the cost is linear in
    the text, however many or long the spans are.
    """
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(_U64) * _U64(0x2545F4914F6CDD1D))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a text."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = IS_WORD[data]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; the whole sequence if shorter; empty without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out = out * _U64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k]
    return np.unique(mix64(out + _U64(width)))


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text of an Arrow string column as a view of its bytes; null gives an empty one."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64, count=n + 1 + column.offset)[column.offset :]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(n):
        yield body[:0] if nulls is not None and nulls[i] else body[at[i] : at[i + 1]]


def code_points(data: np.ndarray) -> int:
    """Number of characters of a UTF-8 text."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many marks behind it as make it differ from all columns, which Spark compares without regard to case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(spark) -> None:
    """Hand at most 16 MB of rows (or a single longer one) to Python at once, so that long texts stay within a worker's memory. All operators set the same value, and only where the session allows more."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
    known = re.match(r"(-?\d+)b?$", spark.conf.get(name))
    if not known or not 0 < int(known[1]) <= most:
        spark.conf.set(name, f"{most}b")
