"""NumPy kernels shared by the text operators: word spans, Rabin-Karp hashes and packed hash lists.

All arithmetic is modulo 2**64. A polynomial hash of any span comes from two prefix sums and one
multiplication by an inverse power, so every window of a text costs the same whatever its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

BYTE_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted
WORD_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < size at least (tables grow in powers of two)."""
    size = max(1 << 16, 1 << (size - 1).bit_length())
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix64((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE_CODES[data], BYTE_BASE)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    edge = np.diff((~SEPARATORS[data]).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[memoryview]:
    """UTF-8 bytes of every row; null as empty."""
    out: list[memoryview] = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = memoryview(chunk.buffers()[2] or b"")
        null = chunk.is_null().to_numpy(zero_copy_only=False)
        out += [data[0:0] if n else data[a:b] for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), null.tolist())]
    return out


def by_bytes(texts: list[memoryview], limit: int = 16 << 20) -> list[tuple[int, int]]:
    """The texts in runs (start, end) of `limit` bytes at most, or of one text."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            out.append((start, i))
            start, held = i, 0
        held += len(t)
    return [*out, (start, len(texts))] if texts else []


CHUNK = 3 << 18  # a batch fits the power tables of 2**20 entries


def word_hashes(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    Works on about a megabyte at a time; a longer text is cut between words only.
    """
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    batch: list[tuple[int, memoryview]] = []
    held = 0

    def flush() -> None:
        nonlocal batch, held
        if not batch:
            return
        data = np.frombuffer(b"\n".join(t for _, t in batch), dtype=np.uint8)
        starts, ends = word_spans(data)
        hashes.append(span_hashes(byte_prefix(data), starts, ends, BYTE_BASE))
        bounds = np.cumsum([len(t) + 1 for _, t in batch])
        cut = np.searchsorted(starts, bounds)
        np.add.at(counts, [i for i, _ in batch], np.diff(cut, prepend=0))
        batch, held = [], 0

    for i, text in enumerate(texts):
        for piece in pieces(text):
            batch.append((i, piece))
            held += len(piece)
            if held >= CHUNK:
                flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


def pieces(text: memoryview) -> list[memoryview]:
    """The text in parts of about CHUNK bytes, cut at separators."""
    if len(text) <= 2 * CHUNK:
        return [text]
    out, at, data = [], 0, np.frombuffer(text, dtype=np.uint8)
    while len(text) - at > 2 * CHUNK:
        cut, step = -1, CHUNK
        while cut < 0 and at + step < len(text):
            gaps = np.flatnonzero(SEPARATORS[data[at + step - CHUNK : at + step]])
            cut = at + step - CHUNK + int(gaps[-1]) if len(gaps) else -1
            step += CHUNK
        if cut <= at:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def window_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of `size` words inside one text, and each window's first word."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    inside = np.ones(len(words) + 1, dtype=bool)
    for end in np.cumsum(counts).tolist():
        inside[max(0, end - size + 1) : end] = False
    starts = np.flatnonzero(inside[: len(words) - size + 1])
    if size > 4:
        return span_hashes(prefix_sums(words, WORD_BASE), starts, starts + size, WORD_BASE), starts
    code = words[starts]  # a few terms are summed at once, without tables of powers
    for j in range(1, size):
        code *= np.uint64(WORD_BASE)
        code += words[j:][starts]
    return mix64(code + np.uint64(size)), starts


_ZIP = zstandard.ZstdCompressor(level=1)
_UNZIP = zstandard.ZstdDecompressor()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstd-compressed byte planes of their differences."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return _ZIP.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZIP.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes; upper planes that are zero cost almost nothing."""
    return _ZIP.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZIP.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def pack_bits(flags: np.ndarray) -> bytes:
    return _ZIP.compress(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_UNZIP.decompress(data), dtype=np.uint8), count=size).astype(bool)


def bucket_edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Slices of ascending values: bucket b holds values[edges[b]:edges[b + 1]], equal ranges of the hash space."""
    firsts = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(values, firsts), len(values))
