"""A wavelet matrix of token ids in one compressed file image.

The image holds a sequence of ids cut into documents. Ids are recoded by
falling frequency in the shard, so the upper bit planes are nearly empty and
compress well. Each plane is the sequence's bits after a stable partition by
all higher bits; it is stored in blocks of :data:`BLOCK` bits, each block
compressed by itself, with the number of ones before every block. So access,
counting and lookup of occurrences read only the blocks that they touch.

Layout, little-endian: magic, header length (4 bytes), header as JSON, then the
arrays that the header places: doc ids, document ends, alphabet, rank
directory, block ends, blocks.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
#: Bits in a block of a plane.
BLOCK = 1 << 16


def _packed(raw: bytes) -> bytes:
    small = zstandard.ZstdCompressor(level=1).compress(raw)
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def _unpacked(data: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=size) if data[:1] == b"\x01" else data[1:]


def build(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """Image of ``ids``; ``ends`` are the places after each document's last id.

    ``doc_ids`` may hold None.
    """
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    alphabet = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype(np.uint32)
    code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    rest = code[ids] if n else code
    levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    zeros, ranks, chunks = [], [], []
    for level in range(levels):
        bit = (rest & code.dtype.type(1 << (levels - 1 - level))) != 0
        whole = np.packbits(bit, bitorder="little").tobytes()
        ones = [np.count_nonzero(bit[i : i + BLOCK]) for i in range(0, n, BLOCK)]
        ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        chunks += [_packed(whole[i : i + BLOCK // 8]) for i in range(0, len(whole), BLOCK // 8)]
        zeros.append(n - int(ranks[-1][-1]))
        rest = np.concatenate([rest[~bit], rest[bit]])
    arrays = {
        "doc_ids": _packed(np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()),
        "nulls": _packed(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        "ends": _packed(np.asarray(ends, "<i8").tobytes()),
        "alphabet": _packed(alphabet.astype("<u4").tobytes()),
        "ranks": _packed(np.array(ranks, "<i8").tobytes()),
        "block_ends": _packed(np.cumsum([len(c) for c in chunks]).astype("<i8").tobytes()),
        "blocks": b"".join(chunks),
    }
    head = {"n": n, "docs": len(doc_ids), "levels": levels, "zeros": zeros, "alphabet": len(alphabet), "sizes": {k: len(v) for k, v in arrays.items()}}
    said = json.dumps(head).encode()
    return MAGIC + struct.pack("<I", len(said)) + said + b"".join(arrays.values())


class WaveletFile:
    """Reads an image (bytes, or a memory map of a file)."""

    def __init__(self, image):
        if bytes(image[:8]) != MAGIC:
            raise ValueError("not a wavelet image")
        (size,) = struct.unpack("<I", image[8:12])
        self._image = image
        self.head = json.loads(bytes(image[12 : 12 + size]))
        at, self._at = 12 + size, {}
        for name, length in self.head["sizes"].items():
            self._at[name] = (at, at + length)
            at += length
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        docs, letters = self.head["docs"], self.head["alphabet"]
        per_level = -(-self.n // BLOCK)
        null = self._array("nulls", np.uint8, docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(self._array("doc_ids", "<i8", docs), null, strict=True)]
        self.ends = self._array("ends", "<i8", docs)
        self.alphabet = self._array("alphabet", "<u4", letters)
        self._ranks = self._array("ranks", "<i8", self.levels * (per_level + 1)).reshape(self.levels, per_level + 1)
        self._block_ends = self._array("block_ends", "<i8", self.levels * per_level)
        self._per_level = per_level
        self._block = lru_cache(64)(self._read_block)

    @classmethod
    def open(cls, path: str) -> WaveletFile:
        import mmap

        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _array(self, name: str, kind, count: int) -> np.ndarray:
        lo, hi = self._at[name]
        return np.frombuffer(_unpacked(bytes(self._image[lo:hi]), count * np.dtype(kind).itemsize), kind)

    def _read_block(self, level: int, block: int) -> np.ndarray:
        k = level * self._per_level + block
        base = self._at["blocks"][0]
        lo = base + (int(self._block_ends[k - 1]) if k else 0)
        raw = _unpacked(bytes(self._image[lo : base + int(self._block_ends[k])]), BLOCK // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(BLOCK, self.n - block * BLOCK))

    def _ones(self, level: int, place: int) -> int:
        """Ones before a place of a plane."""
        block, inside = divmod(place, BLOCK)
        ones = int(self._ranks[level, block])
        return ones + int(self._block(level, block)[:inside].sum()) if inside else ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) zero or one of a plane."""
        before = self._ranks[level] if bit else np.minimum(np.arange(self._per_level + 1) * BLOCK, self.n) - self._ranks[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        code = 0
        for level in range(self.levels):
            block, inside = divmod(place, BLOCK)
            bit = int(self._block(level, block)[inside])
            ones = self._ones(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        found = np.flatnonzero(self.alphabet == token)
        if not len(found):
            return None
        code = int(found[0])
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return code, lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in places lo to hi - 1."""
        found = self._range(token, lo, self.n if hi is None else hi)
        return found[2] - found[1] if found else 0

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        found = self._range(token, 0, self.n)
        if not found or not 0 <= k < found[2] - found[1]:
            raise IndexError(k)
        code, place = found[0], found[1] + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def occurrences(self, token: int) -> list[int]:
        """All places of an id, in order."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, in order: the partitions undone from the lowest plane up."""
        rest = np.zeros(self.n, np.uint32 if self.head["alphabet"] > 1 << 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            bit = np.concatenate([self._read_block(level, b) for b in range(self._per_level)]).view(bool)
            back = np.empty_like(rest)
            back[~bit] = rest[: self.zeros[level]]
            back[bit] = rest[self.zeros[level] :] | rest.dtype.type(1 << (self.levels - 1 - level))
            rest = back
        return self.alphabet[rest] if self.n else np.zeros(0, np.uint32)
