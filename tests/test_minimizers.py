"""Super-k-mers, counting by minimizer and contraction inside buckets, against direct versions."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.functions import packed, superkmers
from strandloom.operators import kmers, unitigs


def texts(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ACGT" * 5 + "N") for _ in range(rng.choice([0, 3, 21, 50, 400]))) for _ in range(120)]
    return [*made, "A" * 3000, "ACAC" * 300, *["A" * 200] * 40, *made[:30]]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [5, 15, 21, 31])
def test_runs_hold_every_kmer_with_its_minimizer(k):
    m = superkmers.minimizer_length(k)
    for _, _, data, offsets in packed.blocks(pa.array(texts(k))):
        code, turned, _, _ = packed.codes(data, offsets, k)
        minimizer, hi, lo, size = superkmers.cut(data, offsets, k)
        got, run = superkmers.spread(hi, lo, size, k)
        assert collections.Counter(got.tolist()) == collections.Counter(np.minimum(code, turned).tolist())
        assert (superkmers.minimizer_of(got, k, m) == minimizer[run]).all()
        assert len(size) < len(code) / 2


@pytest.mark.parametrize("k", [15, 21, 31])
@pytest.mark.parametrize("hot", [1 << 22, 200])
def test_both_ways_of_counting(spark, monkeypatch, k, hot):
    """A run of one letter holds a third of all k-mers; with a low limit its minimizer is large."""
    monkeypatch.setattr(superkmers, "BLOCK", 500)
    monkeypatch.setattr(kmers, "HOT_KMERS", hot)
    monkeypatch.setattr(kmers.counted_by_minimizer, "__defaults__", (hot,))
    rows = texts(7)
    expected = collections.Counter()
    for s in rows:
        for i in range(len(s) - k + 1):
            if "N" not in s[i : i + k]:
                expected[min(s[i : i + k], rc(s[i : i + k]))] += 1
    df = spark.createDataFrame([(s,) for s in rows], "seq string").repartition(3)
    for by_minimizer in (True, False):
        assert {r["kmer"]: r["n"] for r in kmers.count_kmers(df, k, 2, by_minimizer=by_minimizer).collect()} == {x: n for x, n in expected.items() if n > 1}
    assert kmers.count_kmers(df.limit(0), k).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_contraction_follows_the_given_links_only(seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(10_000), 400)
    prev = {b: a for a, b in zip(nodes[:300], nodes[1:300])} | {b: a for a, b in zip(nodes[300:], [*nodes[301:], nodes[300]])}  # a chain and a ring
    some = rng.sample(sorted(prev), 350) if seed else sorted(prev)
    at, d = unitigs.contract(np.array(some), np.array([prev[x] for x in some]))
    given = set(some)
    for node, a, n in zip(some, at.tolist(), d.tolist()):
        walk, steps = prev[node], 1
        while walk in given and walk != node:
            walk, steps = prev[walk], steps + 1
        assert (a, n) == ((walk, steps) if walk != node else (prev[node], 1))


def test_small_buckets_give_the_same_unitigs(spark, monkeypatch):
    rng = random.Random(3)
    ring = "".join(rng.choice("ACGT") for _ in range(90))
    rows = ["".join(rng.choice("ACGT") for _ in range(700)) for _ in range(4)] + [ring + ring[:20]]
    rows += [rows[0][:300] + rows[1][300:], "A" * 60 + rows[2][:40]]
    found = kmers.count_kmers(spark.createDataFrame([(s,) for s in rows], "seq string"), 15, pack=True)
    graph = kmers.edges(found, 15)
    packed_way = {tuple(r) for r in unitigs.compact(found, graph, 15).collect()}
    monkeypatch.setattr(unitigs, "BLOCK", 3)
    assert {tuple(r) for r in unitigs.compact(found, graph, 15).collect()} == packed_way
    spelled = kmers.spelled(found, 15, "kmer"), kmers.spelled(graph, 15, "u", "v")
    monkeypatch.setattr(unitigs, "LONGEST", 3)  # strings, without buckets
    assert {tuple(r) for r in unitigs.compact(*spelled, 15).collect()} == packed_way
