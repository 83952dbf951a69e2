"""Whole-batch text primitives in numpy over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once; a single longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 18

#: (modulus, base): primes just below 2^31 and arbitrary bases of the two polynomials of span_hashes.
_FIELDS = ((2147483647, 1103515245), (2147483629, 747796405))
#: Spans of more bytes are hashed by XXH64.
LONG_SPAN = 4096
_powers: list[tuple[np.ndarray, np.ndarray]] = []

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `limit` bytes."""
    buf, offs = buffers(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross the document offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts, ends = np.empty(n, bool), np.empty(n, bool)
    starts[0], ends[-1] = inside[0], inside[-1]
    starts[1:] = inside[1:] & (~inside[:-1] | first[1:n])
    ends[:-1] = inside[:-1] & (~inside[1:] | first[1:n])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _field_powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """By modulus the base's powers and those of its inverse, for CHUNK_BYTES + LONG_SPAN places."""
    if not _powers:
        for p, base in _FIELDS:
            both = []
            for x in (base, pow(base, -1, p)):
                out = np.ones(1, np.uint64)
                while len(out) < CHUNK_BYTES + LONG_SPAN + 1:  # doubles
                    out = np.concatenate([out, out * np.uint64(pow(x, len(out), p)) % np.uint64(p)])
                both.append(out)
            _powers.append(tuple(both))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (by ascending starts): equal bytes, equal hashes.

    Two polynomials modulo primes from prefix sums over the bytes; spans beyond LONG_SPAN by XXH64.
    """
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    for k in np.flatnonzero(lengths > LONG_SPAN):
        out[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), 7)
    short = np.flatnonzero(lengths <= LONG_SPAN)
    while len(short):
        low = int(starts[short[0]])
        n = int(np.searchsorted(starts[short], low + CHUNK_BYTES))
        now, short = short[:n], short[n:]
        a, b = starts[now] - low, ends[now] - low
        part = buf[low : low + int(b.max())].astype(np.uint64) + np.uint64(1)
        prefix, found = np.zeros(len(part) + 1, np.uint64), np.zeros(n, np.uint64)
        for (p, _), (up, down) in zip(_FIELDS, _field_powers(), strict=True):
            # terms stay below 2^39 and their sums below 2^59
            np.cumsum(part * up[: len(part)], out=prefix[1:])
            found = (found << np.uint64(32)) | ((prefix[b] - prefix[a]) % np.uint64(p) * down[a] % np.uint64(p))
        out[now] = found
    return mix(out)


def shingles(words: np.ndarray, per_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number by document) of word n-grams; a shorter non-empty document is one shingle.

    words: hashes of all words, document after document; per_doc: words of each document.
    """
    ends = np.cumsum(per_doc)
    starts = ends - per_doc
    counts = np.where(per_doc > 0, np.maximum(per_doc - n + 1, 1), 0)
    out_starts = np.cumsum(counts) - counts
    at = np.repeat(starts - out_starts, counts) + np.arange(counts.sum())
    short = np.repeat(np.minimum(per_doc, n), counts)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out *= np.uint64(0xF1357AEA2E62A9C5)
        out += np.where(short > k, padded[at + k], np.uint64(0)) if (short <= k).any() else padded[at + k]
    out += short.astype(np.uint64)
    return mix(out), counts


def doc_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words and their number by document."""
    starts, ends = spans(~WHITE[buf], offs)
    return starts, ends, np.diff(np.searchsorted(starts, offs))
