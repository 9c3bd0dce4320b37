"""Vectorised word and hash arithmetic over Arrow string columns.

All functions work on a chunk: the concatenated UTF-8 bytes of some whole texts
(``buf``) and ``offs``, the ``n + 1`` offsets of the texts in it. A text is never
cut: a chunk holds one text at least, and more up to ``CHUNK`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64


def byte_table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Words `[^\x20\x09-\x0D]+`, and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALPHANUMERIC = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
#: Codes of a second hash, independent of the first.
CHECK_CODES = mix(np.arange(257, 513, dtype=U64) * U64(BASE))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U64)
    return _powers["up"], _powers["down"]


def range_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of codes[s:e] for each pair, from one running sum."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * up[: len(codes)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(BASE))


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    got = batch.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, size: int = CHUNK):
    """Yield (first row, one past the last row, buf, offs)."""
    buf, offs = raw_bytes(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE):
    """Word starts and ends in buf, and for each text the range of its words."""
    starts_of, ends_of = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]]
    m = inside[buf]
    edge = m.copy()
    edge[1:] &= ~m[:-1]
    edge[starts_of] = m[starts_of]
    starts = np.flatnonzero(edge)
    edge = m.copy()
    edge[:-1] &= ~m[1:]
    edge[ends_of - 1] = m[ends_of - 1]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offs)


def place_keys(n: int) -> np.ndarray:
    """A fixed pseudorandom key for each place in a word, n of them at least."""
    if len(_powers.get("places", ())) < n:
        _powers["places"] = mix(np.arange(1, max(n, 1024) + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
    return _powers["places"]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A hash of each word: the sum of its bytes' codes, each times the key of its place, and its length.

    Keys that are no powers of one number leave no words, however regular, that collide for every choice of codes.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    head = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(head, size)
    keys = place_keys(int(size.max()))[at]
    at += np.repeat(starts, size)
    keys *= codes[buf[at]]
    return mix(np.add.reduceat(keys, head) + size.astype(U64) * U64(BASE))


PRIME = (1 << 61) - 1
LOW = U64((1 << 31) - 1)


def prime_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    a1, a0, b1, b0 = a >> U64(31), a & LOW, b >> U64(31), b & LOW
    middle = a1 * b0 + a0 * b1
    x = U64(2) * a1 * b1 + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31)) + a0 * b0
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME, n of them at least."""
    if len(_powers.get("prime", ())) < n:
        size = max(n, CHUNK // 2)
        base = BASE % PRIME
        for name, b in (("prime", base), ("inverse", pow(base, -1, PRIME))):
            table = np.ones(size, dtype=U64)
            known = 1
            while known < size:
                more = min(known, size - known)
                table[known : known + more] = prime_product(table[:more], np.full(more, pow(b, known, PRIME), dtype=U64))
                known += more
            _powers[name] = table
    return _powers["prime"], _powers["inverse"]


class PrimeHash:
    """Polynomial hashes modulo PRIME of byte ranges of buf, up to 4 million bytes long.

    Two running sums, of the upper and the lower half of the powers, stay below 2**64; only the wanted ranges are reduced.
    """

    def __init__(self, buf: np.ndarray):
        assert len(buf) < 1 << 22
        up, self.down = prime_powers(len(buf) + 1)
        codes = buf.astype(U64) + U64(1)
        self.sums = []
        for half in (up[: len(buf)] & LOW, up[: len(buf)] >> U64(31)):
            half *= codes
            total = np.zeros(len(buf) + 1, dtype=U64)
            np.cumsum(half, dtype=U64, out=total[1:])
            self.sums.append(total)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = ((s[ends] - s[starts]) % U64(PRIME) for s in self.sums)
        x = (prime_product(high, np.full(len(high), 1 << 31, dtype=U64)) + low) % U64(PRIME)
        return mix(prime_product(x, self.down[starts]) + (ends - starts).astype(U64) * U64(BASE))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All word indices that start a whole window, and the text of each."""
    count = np.maximum(np.diff(first) - (length - 1), 0)
    text = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(count.sum()) - before[text] + first[:-1][text], text


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at positions inside any [start, end)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
