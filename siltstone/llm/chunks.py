"""Unique chunks of a run of texts, for encoders that work on each distinct chunk once.

A text is cut between two bytes wherever no token of the encoder can hold both; the chunks' tokens are then
the text's.  Which pairs of neighbouring bytes a token may hold is the encoder's to say, as a table.
"""

from __future__ import annotations

import numpy as np

from siltstone.llm import kernel as K

#: Encoders take longer runs than the other operators, for fewer distinct chunks.
BLOCK_BYTES = 2 << 20


def spaced(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text that is not empty with a space before it."""
    n = np.diff(offs)
    at = offs + np.concatenate([[0], np.cumsum(n > 0)])
    out = np.full(at[-1], 32, np.uint8)
    fill = np.ones(len(out), bool)
    fill[at[:-1][n > 0]] = False
    out[fill] = buf
    return out, at


def chunks(buf: np.ndarray, offs: np.ndarray, joined: np.ndarray):
    """Starts and ends of the chunks, and the first chunk of each text; `joined` tells, by 256 * byte + next byte, what is not cut."""
    new = np.ones(len(buf), bool)
    new[1:] = ~joined[(buf[:-1].astype(np.uint16) << 8) | buf[1:]]
    new[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts, np.searchsorted(starts, offs)


def unique(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct chunk, and each chunk's number among the distinct ones.

    Chunks of one hash are held against each other, length and bytes, some `at_once` bytes together; should two differ, the bytes decide.
    """
    _, sample, number = np.unique(K.hashes(buf, starts, ends), return_index=True, return_inverse=True)
    if not _same(buf, starts, ends, sample[number], at_once):
        raw = buf.tobytes()
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        sample = np.unique(number, return_index=True)[1]
    return sample, number


def _same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at_once: int) -> bool:
    """Whether every chunk has the length and the bytes of the chunk named beside it."""
    size = ends - starts
    if not np.array_equal(size, size[other]):
        return False
    # Shifts from a chunk to its first like; only chunks that are not their own first are compared.
    again = np.flatnonzero(starts[other] != starts)
    for part in np.split(again, np.flatnonzero(np.diff(np.cumsum(size[again]) // at_once)) + 1):
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(buf[np.repeat(starts[part], n) + step], buf[np.repeat(starts[other[part]], n) + step]):
            return False
    return True


def spread(lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each occurrence lie in the values of the distinct chunks, and the offsets of the occurrences."""
    size = lengths[number]
    first = (np.cumsum(lengths) - lengths)[number] if len(lengths) else number
    at = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(first - at[:-1], size) + np.arange(at[-1]), at
