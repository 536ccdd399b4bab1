"""Super-k-mers: runs of neighbouring k-mers with one minimizer, as two longs.

The minimizer of a k-mer is the smallest of its canonical m-mers in a scrambled
order, so both strands agree on it and runs of one letter get no special place.
Neighbouring k-mers mostly share it: a run of them travels as its bases, two bits
each, in place of a long for every k-mer. All k-mers of one canonical code
have the same minimizer, so they meet where the minimizer is dealt to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.packed import _CODE, blocks, codes

#: Bases of a minimizer, unless k is short, and most bases of a run.
M, MOST = 11, 64
#: Bytes of sequences whose runs are cut at once.
CUT_BYTES = 1 << 17
#: k-mers that a task counts at once: some whole minimizers, or a part of the codes of a larger one.
BLOCK = 1 << 18

_ODD = 0x9E3779B97F4A7C15 | 1


def minimizer_length(k: int) -> int:
    return min(M, max(1, k // 2))


def windows(value: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` of every ``size`` neighbours, from runs of 1, 2, 4, ... of them."""
    out, done, left = None, 0, size
    piece, width = value, 1
    while left:
        if left & 1:
            if out is None:
                out = piece
            else:
                n = len(piece) - done
                out = join(out[:n], piece[done:], width)
            done += width
        left >>= 1
        if left:
            n = len(piece) - width
            piece = join(piece[:n], piece[width:], width)
            width *= 2
    return out


def _joined(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    return a << np.uint64(2 * width) | b


def turned(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    c = ~code.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, low = np.uint64(shift), np.uint64(mask)
        c = c >> s & low | (c & low) << s
    return c >> np.uint64(64 - 2 * k)


def scrambled(code: np.ndarray, m: int) -> np.ndarray:
    """The canonical m-mer's place in the scrambled order, one to one."""
    low = np.minimum(code, turned(code, m))
    return low * np.uint64(_ODD) & np.uint64(4**m - 1)


def minimizer_of(code: np.ndarray, k: int, m: int) -> np.ndarray:
    """Minimizer of packed k-mers."""
    code, mask = code.astype(np.uint64), np.uint64(4**m - 1)
    best = scrambled(code & mask, m)
    for i in range(1, k - m + 1):
        best = np.minimum(best, scrambled(code >> np.uint64(2 * i) & mask, m))
    return best.astype(np.int64)


def cut_rows(data: np.ndarray, offsets: np.ndarray, k: int, shared: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first 32 bases, next 32 bases, k-mers, sequence) of every run of plain bases.

    With ``shared`` = 1 the minimizers are those of the k - 1 bases between neighbours (junctions): a
    run has all k-mers at its junctions, so a k-mer between two runs lies in both.
    """
    m, none = minimizer_length(k), np.zeros(0, np.int64)
    n, window = len(data) - k + 1, k - shared
    if n <= 0:
        return none, none, none, none, none
    base = _CODE[data]
    plain = np.minimum(base, 3).astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.concatenate([[0], np.cumsum(base == 4)])
    whole = lambda size: (odd[size:] == odd[:-size]) & (row[: len(row) - size + 1] == row[size - 1 :])
    at = np.flatnonzero(whole(window))
    if not len(at):
        return none, none, none, none, none
    order = scrambled(windows(plain, m, _joined), m)
    least = windows(order, window - m + 1, lambda a, b, width: np.minimum(a, b))[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(at)))
    begin, least = at[first], least[first]
    if shared:
        kmer = np.concatenate([[False], whole(k), [False]])  # at place + 1
        before, after = kmer[begin], kmer[begin + size]
        begin, size = begin - before, size - 1 + before + after
        some = size > 0
        begin, size, least = begin[some], size[some], least[some]
    # Runs of more k-mers than fit are cut into several.
    most = MOST - k + 1
    parts = -(-size // most)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size, least = np.repeat(begin, parts) + within * most, np.minimum(most, np.repeat(size, parts) - within * most), np.repeat(least, parts)
    padded = np.concatenate([plain, np.zeros(MOST, np.uint64)])
    half = windows(padded, 32, _joined)
    bases = size + k - 1
    hi, lo = half[begin], half[begin + 32]
    keep = lambda x, b: np.where(b <= 0, np.uint64(0), x >> (64 - 2 * np.clip(b, 1, 32)).astype(np.uint64) << (64 - 2 * np.clip(b, 1, 32)).astype(np.uint64))
    return least.astype(np.int64), keep(hi, bases).view(np.int64), keep(lo, bases - 32).view(np.int64), size, row[begin]


def cut(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(minimizer, first 32 bases, next 32 bases, k-mers) of every run of plain bases."""
    return cut_rows(data, offsets, k)[:4]


def rows_apart(data: np.ndarray, offsets: np.ndarray, k: int, shared: int = 0) -> list[np.ndarray]:
    """As :func:`cut_rows`, some sequences at a time."""
    parts, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CUT_BYTES, "right")) - 1))
        *runs, row = cut_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, shared)
        parts.append([*runs, row + lo])
        lo = hi
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5


def cut_apart(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """As :func:`cut`, some sequences at a time."""
    return rows_apart(data, offsets, k)[:4]


def spread(hi: np.ndarray, lo: np.ndarray, size: np.ndarray, k: int, parts: int = 1, part: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(canonical code, run) of all k-mers of runs, or of those of one of several parts of the codes."""
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    codes, runs = [], []
    for j in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > j)
        a, b = hi[own], lo[own]
        if j >= 32:
            top = b << np.uint64(2 * j - 64)
        elif j:
            top = a << np.uint64(2 * j) | b >> np.uint64(64 - 2 * j)
        else:
            top = a
        code = top >> np.uint64(64 - 2 * k)
        code = np.minimum(code, turned(code, k))
        if parts > 1:
            mine = (code * np.uint64(_ODD) >> np.uint64(32)) % np.uint64(parts) == part
            code, own = code[mine], own[mine]
        codes.append(code.astype(np.int64))
        runs.append(own)
    return (np.concatenate(codes), np.concatenate(runs)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Sums of codes travel as two longs, so only their last step can overflow, and Spark tells.
_LOW = 21


def code_sums(df: DataFrame, k: int, m: int, *keep: str) -> DataFrame:
    """(keep..., canonical, packed, minimizer): over all k-mers of plain bases of ``seq``, sums of the
    canonical codes, of the codes and of the codes of their smallest m-mers; null without any.

    These codes run A, C, T, G = 0..3; least is meant in the order of the letters.
    """
    names = [f"{c}_{part}" for c in ("canonical", "packed", "minimizer") for part in ("high", "low")]

    def parts(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        code, turn, row, at = codes(data, offsets, k)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        short = windows(np.minimum(_CODE[data], 3).astype(np.uint64), m, _joined)
        least = windows(short, k - m + 1, lambda a, b, width: np.minimum(a, b))[at + offsets[row]] if len(row) else code
        out = []
        for value in (np.minimum(code, turn), code, least.astype(np.int64)):
            value = value ^ (value >> 1 & 0x5555555555555555)
            for part in (value >> _LOW, value & (1 << _LOW) - 1):
                sums, found = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, bool)
                if len(first):
                    sums[row[first]], found[row[first]] = np.add.reduceat(part, first), True
                out.append(pa.array(sums, mask=~found))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), *parts(data, offsets)], [*keep, *names])

    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in names)])
    got = df.select(*keep, "seq").mapInArrow(run, kinds)
    return got.select(*keep, *((F.col(f"{c}_high") * (1 << _LOW) + F.col(f"{c}_low")).alias(c) for c in ("canonical", "packed", "minimizer")))


RUNS = "minimizer long, hi long, lo long, size int, n long"


def super_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(minimizer, hi, lo, size, n): runs of every sequence, equal ones of a block counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                rows = np.stack(cut_apart(data, offsets, k), 1)
                order = np.lexsort(rows.T[::-1])
                rows = rows[order]
                fresh = np.ones(len(rows), bool)
                fresh[1:] = (rows[1:] != rows[:-1]).any(1)
                n = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
                rows = rows[fresh]
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(rows[:, 3].astype(np.int32)), pa.array(n)], ["minimizer", "hi", "lo", "size", "n"])

    return seqs.select("seq").mapInArrow(run, RUNS)


def counted_runs(k: int, by_minimizer: bool):
    """Function of batches of runs to (kmer, n).

    With ``by_minimizer`` the runs come sorted by minimizer and a k-mer comes out once;
    otherwise every block counts for itself.
    """

    most = BLOCK if by_minimizer else 4 * BLOCK

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hi, lo, size, n = (rows[c].to_numpy() for c in ("hi", "lo", "size", "n"))
        parts = max(1, -(-int(size.sum()) // (2 * most)))
        for part in range(parts):
            code, run = spread(hi, lo, size, k, parts, part)
            values, inverse = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(inverse, n[run], minlength=len(values)).astype(np.int64))], ["kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = [], 0
        for batch in batches:
            kept.append(batch)
            total += int(batch.column(3).to_numpy().sum()) if batch.num_rows else 0
            if total < most:
                continue
            rows = pa.Table.from_batches(kept).combine_chunks()
            name = rows["minimizer"].to_numpy()
            edge = int(np.searchsorted(name, name[-1])) if by_minimizer else len(rows)
            if edge:
                yield from count(rows.slice(0, edge))
            kept = rows.slice(edge).to_batches()
            total = int(rows["size"].to_numpy()[edge:].sum())
        if kept:
            yield from count(pa.Table.from_batches(kept).combine_chunks())

    return run


#: Columns of a run on its way: its minimizer, bases and k-mers, how often transcripts have it (t) and others (n), and its least place.
_COLUMNS = ("minimizer", "hi", "lo", "size", "n", "t", "place")
#: k-mers of a bin of minimizers, and least and most bits of a bin's number.
BIN_KMERS, BIN_BITS = 1 << 22, (8, 14)
#: Bytes of sequences whose equal runs are counted at once.
RUN_BYTES = 1 << 22


def _planes(values: np.ndarray) -> bytes:
    """Equal bytes of all numbers side by side, which compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view(np.int64).ravel()


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Runs, sorted by minimizer, as bytes."""
    raw = b"".join(map(_planes, [np.diff(columns[0], prepend=0), *columns[1:]]))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def binned(columns: list[np.ndarray], m: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bin, data) of runs: those whose minimizers share a bin in a row."""
    if len(columns[0]):
        where = ((columns[0].astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(4**m - 1)) >> np.uint64(2 * m - min(bits, 2 * m))).astype(np.int64)
        order = np.lexsort((columns[0], where))
        where, columns = where[order], [c[order] for c in columns]
        edges = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
        data = [squeezed([c[lo:hi] for c in columns]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(where[edges[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["bin", "data"])


def unsqueezed(data: list[bytes]) -> list[np.ndarray]:
    """The columns of several squeezed blocks of runs."""
    parts = []
    for x in data:
        raw = np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd"), np.uint8)
        columns = [_numbers(c) for c in raw.reshape(len(_COLUMNS), -1)]
        columns[0] = np.cumsum(columns[0])
        parts.append(columns)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def placed_runs(seqs: DataFrame, k: int, shared: int, bits: int, large: list[int], of_large: bool = False) -> DataFrame:
    """(bin, data): runs of (seq, transcript, place), equal ones of a block counted; those of ``large`` minimizers, or all others.

    A row has all runs of a block whose minimizers share a bin.
    """
    m, names = minimizer_length(k), np.array(sorted(large), np.int64)

    def found(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        marked, at = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2).to_numpy()
        for start, _, data, offsets in blocks(batch.column(0), RUN_BYTES):
            runs = rows_apart(data, offsets, k, shared)
            if of_large or len(names):
                own = np.isin(runs[0], names) == of_large
                runs = [x[own] for x in runs]
            name, hi, lo, size, row = runs
            if not len(name):
                continue
            mixed = ((hi.view(np.uint64) ^ size.astype(np.uint64)) * np.uint64(_ODD) ^ lo.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            order = np.argsort(mixed >> np.uint64(2 * m) | name.astype(np.uint64) << np.uint64(64 - 2 * m))
            name, hi, lo, size, row = (x[order] for x in (name, hi, lo, size, row + start))
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (size[1:] != size[:-1])
            first, t = np.flatnonzero(fresh), marked[row].astype(np.int64)
            yield [*(x[first] for x in (name, hi, lo, size)), np.add.reduceat(1 - t, first), np.add.reduceat(t, first), np.minimum.reduceat(at[row], first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in found(batch):
                yield from binned(columns, m, bits)

    return seqs.select("seq", "transcript", F.col("place").cast("long")).mapInArrow(run, "bin int, data binary")


def large_minimizers(seqs: DataFrame, k: int, shared: int, most: int) -> tuple[list[int], int]:
    """Minimizers whose runs hold more than ``most`` k-mers, and perhaps some of three quarters as many; bits of the bins of all.

    A task tells of those with more than a quarter of its share of ``most``, so what all tasks keep back of one is
    a quarter of ``most`` at most: a bounded list, without a table of runs.
    """
    m = minimizer_length(k)
    share = most // (4 * max(1, seqs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(4**m, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                name, _, _, size, _ = rows_apart(data, offsets, k, shared)
                np.add.at(seen, name, size)
        often = np.flatnonzero(seen > share)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1)), pa.array(np.append(seen[often], seen.sum()))], ["minimizer", "kmers"])

    told = seqs.select("seq").mapInArrow(run, "minimizer long, kmers long").groupBy("minimizer").agg(F.sum("kmers").alias("kmers"))
    got = {r[0]: r[1] for r in told.where((F.col("kmers") > most - most // 4) | (F.col("minimizer") < 0)).collect()}
    bits = int(np.clip((got.pop(-1, 0) // BIN_KMERS).bit_length(), *BIN_BITS))
    return list(got), bits


def summed(columns: list[np.ndarray], k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code, n, t, place) of the canonical k-mers of runs, in parts of their codes of about ``most`` k-mers at a time."""
    _, hi, lo, size, n, t, place = columns
    parts = max(1, -(-int(size.sum()) // most))
    for part in range(parts):
        code, run = spread(hi, lo, size, k, parts, part)
        order = np.argsort(code)
        code, run = code[order], run[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            yield code[first], np.add.reduceat(n[run], first), np.add.reduceat(t[run], first), np.minimum.reduceat(place[run], first)


def by_bins(work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of batches of (bin, data), sorted by bin: ``work`` on the columns of some whole minimizers, of about ``most`` k-mers or one minimizer each."""

    def whole(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = unsqueezed(data)
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.diff(columns[0], prepend=-1))
        before = np.cumsum(columns[3])[first] - columns[3][first]
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + most)))
            part = slice(first[lo], first[hi] if hi < len(first) else None)
            yield from work([c[part] for c in columns])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at = [], None
        for batch in batches:
            for here, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here != at and kept:
                    yield from whole(kept)
                    kept = []
                at = here
                kept.append(data)
        if kept:
            yield from whole(kept)

    return run
