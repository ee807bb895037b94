"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Spark hands a task Arrow batches; `blocks` cuts them into runs of rows of bounded byte size, and the
other functions work on the flat UTF-8 buffer of such a run.  A hash of a substring is the sum of its
eight-byte lanes, each first mixed with its number by a bijection that is not linear, so that no pattern
of bytes makes two texts collide other than by chance.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
#: Lanes beyond the first that are hashed at once.
_LANES_AT_ONCE = 1 << 17
#: By number of bytes, what keeps only these of a lane.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Space and the five control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SALT = mix(np.full(1, 0x9E3779B97F4A7C15, U))[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Yield (rows, buffer, offsets): a slice of a batch, its texts' bytes, and where each text starts.

    At the end memory that is free goes back to the system, since a worker outlives its task.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        if pa.types.is_large_string(texts.type):
            kind = np.int64
        else:
            texts, kind = texts.cast(pa.string()), np.int32
        _, at, data = texts.buffers()
        offs = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
        del batch, texts, at, data, offs
    give_back()


def give_back() -> None:
    """Return what the allocators of numpy and Arrow hold without need to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tokens(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of the maximal runs without white space; no run crosses a text's end."""
    inside = ~space[buf]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edge = offs[:-1][offs[:-1] < len(buf)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[edge[edge > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def owners(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The text that each start lies in."""
    return np.searchsorted(offs, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of buf[start:end].

    With a two-dimensional `ends`, each of its rows gives another end for every start.
    """
    text = np.zeros(len(buf) + 8, np.uint8)
    text[: len(buf)] = LOWER[buf] if lower else buf
    lanes = np.ndarray(len(buf) + 1, "<u8", text.data, strides=(1,))
    many = np.atleast_2d(ends)
    out = np.empty(many.shape, U)
    for row, end in zip(out, many, strict=True):
        size = end - starts
        row[:] = mix((lanes[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ _SALT)
        long = np.flatnonzero(size > 8)
        until = np.concatenate([[0], np.cumsum((size[long] - 1) // 8)])
        for a in range(0, int(until[-1]), _LANES_AT_ONCE):
            b = min(a + _LANES_AT_ONCE, int(until[-1]))
            lo, hi = int(np.searchsorted(until, a, "right")) - 1, int(np.searchsorted(until, b))
            first = np.maximum(until[lo:hi], a) - a
            who = np.repeat(np.arange(lo, hi), np.diff(np.append(first, b - a)))
            number = np.arange(a, b) - until[who] + 1
            at = starts[long[who]] + 8 * number
            lane = lanes[at] & _FIRST_BYTES[np.minimum(end[long[who]] - at, 8)]
            row[long[lo:hi]] += np.add.reduceat(mix(lane ^ mix(number.astype(U) * _SALT)), first)
        row[:] = mix(row + size.astype(U) * _SALT)
    return out if ends.ndim == 2 else out[0]


_LANES = mix(np.arange(1, 65, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int):
    """Distinct k-word shingle hashes of each text, ascending within a text, and each text's first one.

    Words are runs without white space, A-Z lower-cased; a text of 1 to k-1 words has its whole sequence
    as its one shingle, and a text without words has none.
    """
    starts, ends = tokens(buf, offs)
    n = len(offs) - 1
    word, owner = hashes(buf, starts, ends, lower=True), owners(starts, offs)
    first = np.searchsorted(owner, np.arange(n + 1))
    counts = np.diff(first)
    m = len(word) - k + 1
    if m > 0:
        total = np.zeros(m, U)
        for j in range(k):
            total += word[j : j + m] * _LANES[j]
        total = mix(total)[owner[:m] == owner[k - 1 :]]
    else:
        total = np.zeros(0, U)
    size = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    size[short] = 1
    at = np.concatenate([[0], np.cumsum(size)])
    vals = np.empty(at[-1], U)
    fill = np.ones(at[-1], bool)
    fill[at[short]] = False
    vals[fill] = total
    for i in short:
        a, c = first[i], counts[i]
        vals[at[i] : at[i] + 1] = mix(np.sum(word[a : a + c] * _LANES[:c], keepdims=True) + U(c) * _LANES[40:41])
    for i in np.flatnonzero(size > 1):
        vals[at[i] : at[i + 1]].sort()
    keep = np.ones(len(vals), bool)
    keep[1:] = vals[1:] != vals[:-1]
    keep[at[:-1][size > 0]] = True
    return vals[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each run of `values`; an empty run sums to nought."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[offs[1:]] - sums[offs[:-1]]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points of the buffer before each byte, and at its end their number."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed 64-bit integers of the same bits."""
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)
