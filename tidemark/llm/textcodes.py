"""Code-point arrays: classes, rolling hashes and bounded chunks of text, shared by the operators of this subpackage.

Everything works on whole batches: the texts of a chunk are joined with one separator each and viewed as one
array of code points, so that NumPy does per character what a loop would do per text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

OTHER, LETTER, DIGIT, SPACE, BREAK = 0, 1, 2, 3, 4
CHUNK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CACHE: dict = {}


def class_table() -> np.ndarray:
    """OTHER, LETTER (L*), DIGIT (N*) or SPACE (Unicode White_Space) of every code point."""
    if "classes" not in _CACHE:
        major = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
        raw = np.frombuffer(major.encode("ascii"), np.uint8)
        table = np.zeros(0x110000, np.uint8)
        table[raw == ord("L")] = LETTER
        table[raw == ord("N")] = DIGIT
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _CACHE["classes"] = table
    return _CACHE["classes"]


def ideograph_table() -> np.ndarray:
    """True for Han and kana, whose characters are words of their own."""
    if "ideographs" not in _CACHE:
        table = np.zeros(0x110000, bool)
        for first, last in (
            (0x2E80, 0x2FD5), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF),
            (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0xFF66, 0xFF9F), (0x16FE2, 0x16FF1), (0x1AFF0, 0x1B167), (0x20000, 0x323AF),
        ):
            table[first : last + 1] = True
        table &= np.isin(class_table(), (LETTER, DIGIT))
        _CACHE["ideographs"] = table
    return _CACHE["ideographs"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with one separator after each, and where each starts and ends in it."""
    whole = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(texts) else ends
    return whole, starts, ends


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` characters; a longer text is a range of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the result."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _CACHE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_CHARS + 4096)
        power, inverse = np.full(size, _BASE), np.full(size, _BASE_INV)
        power[0] = inverse[0] = 1
        have = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        if size <= 4 * CHUNK_CHARS:
            _CACHE["powers"] = have
    return have


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each pair; equal slices have equal hashes wherever they stand."""
    power, inverse = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i], ..., starts[i] + counts[i] - 1 of every i, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, counts)
