"""Vectorised text kernels that run inside Arrow batches on the executors.

A kernel takes a slice of texts as one UTF-8 byte array with document offsets and returns
flat arrays (word spans, hashes, document numbers).  Nothing here knows about Spark; the
operators feed it one bounded slice at a time (:func:`slices`), so memory does not depend
on the size of a partition or on the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F | 1

_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U64)

#: The blanks of the word pattern ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(_U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U64(30)
        x *= _U64(0xBF58476D1CE4E5B9)
        x ^= x >> _U64(27)
        x *= _U64(0x94D049BB133111EB)
        x ^= x >> _U64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for every span; another ``lane`` gives an independent hash.

    A span is the sum of its 8-byte chunks, each mixed with its place: no power of a base is
    involved, so that texts made of few letters in regular patterns do not meet.
    """
    size = ends - starts
    span, place = _places((size + 7) >> 3)
    at = starts[span] + 8 * place
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    chunk = eight[at] & _LOW[np.minimum(size[span] - 8 * place, 8)]
    return _summed(chunk, span, place, size, lane)


def sequence_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of ``values[first:end]`` as sequences, in the manner of :func:`span_hashes`."""
    span, place = _places(end - first)
    return _summed(values[first[span] + place], span, place, end - first, lane)


def _places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the span and place in it for every part, ``count`` parts a span."""
    if len(count) and count.min() == count.max() == 1:
        return np.arange(len(count)), np.zeros(len(count), dtype=np.int64)
    span = np.repeat(np.arange(len(count)), count)
    return span, np.arange(len(span)) - (np.cumsum(count) - count)[span]


def _summed(part: np.ndarray, span: np.ndarray, place: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
    total = np.zeros(len(size), dtype=_U64)
    with np.errstate(over="ignore"):
        mixed = mix64(part + (place + 1).astype(_U64) * _U64(_BASE) + _U64(lane) * _U64(_SHINGLE_BASE))
        filled = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1]))) if len(span) else span
        total[span[filled]] = np.add.reduceat(mixed, filled) if len(span) else 0
        return mix64(total + size.astype(_U64) * _U64(_SHINGLE_BASE) + _U64(lane))


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row count, bytes, offsets)`` of runs of whole texts, about SLICE_BYTES each.

    A null text counts as empty.  One longer text makes a slice of its own: texts are never cut.
    """
    done = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        if not len(chunk):
            continue
        _, where, data = chunk.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), len(chunk))
            yield done + at, to - at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        done += len(chunk)


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a document border always ends a run."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, keep[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, keep[1:]
    return np.flatnonzero(keep & (~before | edge[:-1])), np.flatnonzero(keep & (~after | edge[1:])) + 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = runs(~BLANK[buf], offsets)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def window_hashes(values: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values of one document, and where each window starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    total = np.zeros(len(at), dtype=_U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * _U64(_SHINGLE_BASE) + values[at + k]
    return mix64(total), at


def word_shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For every document its sorted distinct ``width``-word shingle hashes (ASCII letters lower-cased).

    With fewer words than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    buf = LOWER_ASCII[buf]
    starts, ends, docs = words(buf, offsets)
    count = np.bincount(docs, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    hashed = span_hashes(buf, starts, ends)
    shingles, at = window_hashes(hashed, docs, width)
    border = np.searchsorted(at, first)
    out = []
    for d in range(len(offsets) - 1):
        if count[d] >= width:
            own = np.sort(shingles[border[d] : border[d + 1]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count[d]:
            whole, _ = window_hashes(hashed[first[d] : first[d + 1]], np.zeros(count[d], np.int64), int(count[d]))
            out.append(mix64(whole + _U64(count[d])))
        else:
            out.append(np.zeros(0, _U64))
    return out
