"""What a task holds at once doesn't grow with its input."""

import numpy as np
import pyarrow as pa

from strandloom.functions import packed as P
from strandloom.functions import superkmers as M


class Stub:
    """Gives the function of batches that a query would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, kinds):
        return run


def random_texts(n, size, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(x) for x in rng.choice(list("ACGT"), (n, size))]


def test_places_come_in_small_batches(spark):
    seqs = random_texts(600, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(seqs)], ["read_index", "seq"])
    got = list(P.placed(Stub(), 21)(iter([batch])))
    assert max(b.num_rows for b in got) <= 1 << 17
    assert sum(b.num_rows for b in got) == 600 * 980
    assert [r for b in got for r in b.column("read_index").unique().to_pylist()] == list(range(600))


def test_large_minimizer_is_counted_in_parts(monkeypatch):
    k, seqs = 21, random_texts(80, 90)
    ends = np.cumsum([0, *map(len, seqs)])
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    rows = M.cut(data, ends, k)
    assert all((a == b).all() for a, b in zip(rows, M.cut_apart(data, ends, k), strict=True))
    monkeypatch.setattr(M, "CUT_BYTES", 100)
    assert all((a == b).all() for a, b in zip(rows, M.cut_apart(data, ends, k), strict=True))
    monkeypatch.setattr(M, "BLOCK", 500)
    hi, lo, size = rows[1:]
    columns = [np.full(len(hi), 7), hi, lo, size.astype(np.int32), np.full(len(hi), 3)]  # dealt as one minimizer
    runs = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["minimizer", "hi", "lo", "size", "n"])
    got = list(M.counted_runs(k, True)(iter([runs])))
    code, turned, _, _ = P.codes(data, ends, k)
    values, n = np.unique(np.minimum(code, turned), return_counts=True)
    assert max(b.num_rows for b in got) < 1500 < len(values)
    assert sorted((x, y) for b in got for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) == list(zip(values.tolist(), (3 * n).tolist(), strict=True))
