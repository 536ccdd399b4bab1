"""The FASTQ data source on ranges of every size, against plain reading."""

import gzip
import random
import struct
import types
import zlib

import pytest

from strandloom.sources import fastq
from strandloom.sources import sequences as Q


def made(seed, n=60, end="\n"):
    """Records with qualities that look like headers or separators, empty and long ones; the text and what it holds."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 300]) if i < n - 1 else 9
        seq = "".join(rng.choice("acgtN") for _ in range(size))
        qual = "".join(rng.choice("@+I!") for _ in range(size))
        rows.append((f"r{i} \u00e9", seq.upper(), qual, f"@r{i} \u00e9{end}{seq}{end}+{rng.choice(['', f'r{i}'])}{end}{qual}{end}"))
    return "".join(r[3] for r in rows).encode(), [r[:3] for r in rows]


def members(data, size):
    """Gzip members that tell their size, of so many bytes of the data each."""
    out = []
    for lo in [*range(0, len(data), size), None]:
        piece = b"" if lo is None else data[lo : lo + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(piece) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, 18 + len(body) + 8 - 1)
        out.append(head + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


def read(path, size, split):
    got = []
    for part in fastq.ranges(path, size, split):
        place = 0
        for batch in fastq.records(part):
            assert batch.column("place").to_pylist() == list(range(place, place + batch.num_rows))
            place += batch.num_rows
            got += list(zip(*(batch.column(c).to_pylist() for c in ("header", "seq", "qual"))))
    return got


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [1, 2, 7, 50, 333, 4096, 1 << 20])
def test_plain_ranges(tmp_path, monkeypatch, split, end):
    data, rows = made(split, 25 if split < 7 else 60, end)
    for chunk in (13, 1 << 20):
        monkeypatch.setattr(fastq, "CHUNK", chunk)
        for cut in (0, len(end)):  # with and without the last line feed
            (tmp_path / "a.fq").write_bytes(data[: len(data) - cut])
            assert read(str(tmp_path / "a.fq"), len(data) - cut, split) == rows


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_gzip_members(tmp_path, split):
    data, rows = made(5)
    path = tmp_path / "a.fq.gz"
    path.write_bytes(b"".join(gzip.compress(data[lo : lo + 700]) for lo in range(0, len(data), 700)))
    assert [p.kind for p in fastq.ranges(str(path), path.stat().st_size, split)] == ["gzip"]
    assert read(str(path), path.stat().st_size, split) == rows


@pytest.mark.parametrize("split", [60, 300, 2000])
@pytest.mark.parametrize("size", [90, 700])
def test_members_that_tell_their_size(tmp_path, split, size):
    data, rows = made(6)
    path = tmp_path / "a.fq.gz"
    path.write_bytes(members(data, size))
    parts = list(fastq.ranges(str(path), path.stat().st_size, split))
    assert {p.kind for p in parts} == {"members"} and len(parts) > 1
    assert read(str(path), path.stat().st_size, split) == rows


def test_a_record_longer_than_many_ranges_and_an_empty_file(tmp_path):
    data = b"@a\n" + b"A" * 3_000_000 + b"\n+\n" + b"@" * 3_000_000 + b"\n@b\nC\n+\nI\n@cut\nAC\n"
    (tmp_path / "a.fq").write_bytes(data)
    assert [(h, len(s)) for h, s, _ in read(str(tmp_path / "a.fq"), len(data), 100_000)] == [("a", 3_000_000), ("b", 1)]
    (tmp_path / "b.fq").write_bytes(b"")
    assert list(fastq.ranges(str(tmp_path / "b.fq"), 0, 10)) == []


def test_numbers_through_many_files(spark, tmp_path):
    rows = []
    for i in range(4):
        data, found = made(10 + i, 20 + i)
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"p{i}.fq").write_bytes(data) if i % 2 else (tmp_path / "d" / f"p{i}.fq.gz").write_bytes(gzip.compress(data))
        rows += found
    (tmp_path / "d" / "_SUCCESS").write_text("")
    for path in (f"{tmp_path}/d", f"file://{tmp_path}/d", f"{tmp_path}/d/p*"):
        got = Q.read_fastq(spark, path, split=500, across_files=True).orderBy("read_index").collect()
        assert [(r.header, r.seq, r.qual) for r in got] == rows and [r.read_index for r in got] == list(range(len(rows)))
    each = Q.read_fastq(spark, f"{tmp_path}/d", split=500).where("file LIKE '%p3.fq'").orderBy("read_index").collect()
    assert [r.read_index for r in each] == list(range(23))


def test_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    data, rows = made(3)
    (tmp_path / "a.fq").write_bytes(data)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(data))

    def closed(path):
        raise pa.ArrowInvalid("unknown scheme")

    monkeypatch.setattr(Q, "fs", types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=closed)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = Q.read_fastq(spark, f"{tmp_path}/a.fq", f"{tmp_path}/b.fq.gz").orderBy("file", "read_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.header, r.seq, r.qual) for r in got] == rows * 2


def test_little_is_read_beyond_a_range(tmp_path):
    data = b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ACGT" * 50, b"IIII" * 50) for i in range(6000))
    (tmp_path / "a.fq").write_bytes(data)
    sizes = []
    for part in fastq.ranges(str(tmp_path / "a.fq"), len(data), 256_000):
        with fastq.opened(part.path) as f:
            stream = fastq._plain(f, part)
            own = next(stream)
            sizes.append(len(own[0]) + len(next(stream, (b"", False))[0]))
    assert len(sizes) > 5 and max(sizes) <= 256_000 + (1 << 14)
    assert len(read(str(tmp_path / "a.fq"), len(data), 256_000)) == 6000
