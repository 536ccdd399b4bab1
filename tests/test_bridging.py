"""Repeat bridging against a direct enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import bridging


def paths_from(known, arcs, most, forks):
    out, stack = set(), [((n,), 0, 0) for n in known]
    while stack:
        path, dist, passed = stack.pop()
        ways = [(b, w) for (a, b), w in arcs.items() if a == path[-1]]
        passed += len(ways) > 1
        good = [(b, w) for b, w in ways if passed <= forks and dist + w <= most]
        if ways and not good and len(path) > 1:
            out.add((path, dist, False))
        for b, w in good:
            if b in path:
                continue
            if b in known:
                out.add(((*path, b), dist + w, True))
            else:
                stack.append(((*path, b), dist + w, passed))
    return out


def least(arcs, start, most):
    best, todo = {start: 0}, [start]
    while todo:
        a = todo.pop()
        for (x, b), w in arcs.items():
            if x == a and best[a] + w <= most and best[a] + w < best.get(b, 1 << 30):
                best[b] = best[a] + w
                todo.append(b)
    return best


def expected(walk, arcs, most, forks, gap):
    place = {}
    for i, n in enumerate(walk):
        place.setdefault(n, i)
    out = [p for p, _, home in paths_from(place, arcs, most, forks) if not home]
    back = [p[::-1] for p, _, home in paths_from(place, {(b, a): w for (a, b), w in arcs.items()}, most, forks) if not home]
    found = set()
    for p in out:
        reach = least(arcs, p[-1], gap)
        for q in back:
            rest = p[:-1] if p[-1] == q[0] else p
            if q[0] in reach and place[p[0]] < place[q[-1]] and not set(rest) & set(q):
                found.add((p[0], q[-1], p, reach[q[0]], q))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(16)]
    arcs = {tuple(rng.sample(nodes, 2)): rng.choice([1, 2, 3]) for _ in range(26)}
    walks = {"t0": rng.sample(nodes, 4), "t1": [*rng.sample(nodes, 3), nodes[0], nodes[0]]}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src string, dst string, w long")
    rows = spark.createDataFrame([(t, i, n) for t, w in walks.items() for i, n in enumerate(w)], "walk string, pos int, node string")
    left = bridging.leaving(rows, df, 8, 2).collect()
    for t, w in walks.items():
        assert {(tuple(r["path"]), r["dist"], r["home"]) for r in left if r["walk"] == t} == paths_from(set(w), arcs, 8, 2)
    got = {(r["walk"], r["source"], r["target"], tuple(r["first"]), r["gap"], tuple(r["second"])) for r in bridging.bridges(rows, df, 6, 1, 7).collect()}
    assert got == {(t, *x) for t, w in walks.items() for x in expected(w, arcs, 6, 1, 7)}


def test_sequences(spark):
    df = spark.createDataFrame([(["ACGT", "GTT"], 5, 2, ["GGA", "GAC"]), (["ACGT", "GTT"], 0, 2, ["GTT", "TTA"])], "f array<string>, gap long, w long, s array<string>")
    got = [r[0] for r in df.select(bridging.bridge_sequence(F.col("f"), F.col("gap"), F.col("w"), F.col("s"), 3)).collect()]
    assert got == ["ACGTT" + "NNN" + "GGAC", "ACGTTA"]
