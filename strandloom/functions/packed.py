"""k-mers of up to 31 bases as longs of two bits a base.

Codes run A, C, G, T = 0..3, so they sort as the strings do. Cutting and packing
is one numpy pass over the bytes of a batch: a string of k letters for every
position costs several times as much in the JVM, and as a key in every shuffle.
What follows the packing, such as neighbours and reverse complements, is bit
arithmetic in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest k-mer that a code holds.
LONGEST = 31
#: Bytes of sequences cut at once, and where every k-mer becomes a row; a longer single sequence is a block of its own.
BLOCK_BYTES, ROW_BYTES = 1 << 20, 1 << 17

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)


def codes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, code of the reverse complement, row, position in the row) of every k-mer of plain bases."""
    base = _CODE[data]
    n = len(base) - k + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.concatenate([[0], np.cumsum(base == 4)])
    at = np.flatnonzero((odd[k:] == odd[: n]) & (row[:n] == row[k - 1 :]))
    one = base.astype(np.int64)
    # Runs of 1, 2, 4, ... bases, joined to runs of k by the bits of k.
    piece, piece_rc, size = one, 3 - one, 1
    whole = whole_rc = None
    done, left = 0, k
    while left:
        if left & 1:
            if whole is None:
                whole, whole_rc = piece, piece_rc
            else:
                m = len(piece) - done
                whole, whole_rc = whole[:m] << (2 * size) | piece[done:], piece_rc[done:] << (2 * done) | whole_rc[:m]
            done += size
        left >>= 1
        if left:
            m = len(piece) - size
            piece, piece_rc = piece[:m] << (2 * size) | piece[size:], piece_rc[size:] << (2 * size) | piece_rc[:m]
            size *= 2
    row = row[at]
    return whole[at], whole_rc[at], row, at - offsets[row]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of a batch; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1))
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def counted(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): canonical codes, counted by themselves in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                code, turned, _, _ = codes(data, offsets, k)
                values, n = np.unique(np.minimum(code, turned), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["kmer", "n"])

    return seqs.select("seq").mapInArrow(run, "kmer long, n long")


def sets(seqs: DataFrame, k: int, key: str) -> DataFrame:
    """(key, kmer): distinct canonical codes of every row (key: long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(1)):
                code, turned, row, _ = codes(data, offsets, k)
                code = np.minimum(code, turned)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                fresh = np.ones(len(code), bool)
                fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row[fresh])), pa.array(code[fresh])], [key, "kmer"])

    return seqs.select(F.col(key).cast("long"), "seq").mapInArrow(run, f"{key} long, kmer long")


def placed(reads: DataFrame, k: int) -> DataFrame:
    """(read_index, i, last, kmer, turned): canonical codes with their places.

    ``last`` is the place of the read's last k-mer; ``turned`` tells that the read
    holds the reverse complement of the code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(1), ROW_BYTES):
                code, turned, row, at = codes(data, offsets, k)
                last = (np.diff(offsets) - k)[row]
                columns = [batch.column(0).take(pa.array(lo + row)), pa.array(at.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.minimum(code, turned)), pa.array(turned < code)]
                yield pa.RecordBatch.from_arrays(columns, ["read_index", "i", "last", "kmer", "turned"])

    return reads.select(F.col("read_index").cast("long"), "seq").mapInArrow(run, "read_index long, i int, last int, kmer long, turned boolean")


def pack(kmer: Column) -> Column:
    """Code of a string of A, C, G and T."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def spell(code: Column, k: int) -> Column:
    """The string of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def head(code: Column) -> Column:
    """Code without its last base."""
    return F.shiftright(code, 2)


def tail(code: Column, k: int) -> Column:
    """Code without its first base."""
    return code.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))


def reverse_complement(code: Column, k: int) -> Column:
    """Code of the reverse complement: bases turned by swapping ever larger groups of bits."""
    c = F.bitwise_not(code)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        low = F.lit(mask)
        c = F.shiftright(c, shift).bitwiseAND(low).bitwiseOR(F.shiftleft(c.bitwiseAND(low), shift))
    c = F.shiftright(c, 32).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft(c, 32))
    return F.shiftrightunsigned(c, 64 - 2 * k)
