"""The sequence graph on small inputs, against direct versions in Python."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.operators import bubbles, kmers, mapping, traversal, unitigs

K = 7
SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(SWAP)


def random_seq(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_index long, seq string")


def brute_count(seqs, k=K):
    c = collections.Counter()
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                c[min(w, rc(w))] += 1
    return c


def brute_unitigs(count):
    """Canonical unitigs by walking; cycles are opened at any node and compared as sets of k-mers."""
    nodes = {x for w in count for x in (w, rc(w))}
    out = {u: [u[1:] + b for b in "ACGT" if u[1:] + b in nodes] for u in nodes}
    inn = {u: [b + u[:-1] for b in "ACGT" if b + u[:-1] in nodes] for u in nodes}
    step = {u: v[0] for u, v in out.items() if len(v) == 1 and len(inn[v[0]]) == 1 and v[0] not in (u, rc(u))}
    ends = set(step.values())
    done, seqs = set(), set()
    for u in nodes - ends:
        walk = [u]
        while walk[-1] in step:
            walk.append(step[walk[-1]])
        done |= set(walk)
        s = walk[0] + "".join(w[-1] for w in walk[1:])
        seqs.add(min(s, rc(s)))
    return seqs, nodes - done


def test_counts_and_reverse_reads(spark):
    seqs = [random_seq(90, 1), random_seq(40, 2) + "N" + random_seq(30, 3), "ACGT", ""]
    got = {r.kmer: r.n for r in kmers.count_kmers(frame(spark, seqs), K).collect()}
    assert got == brute_count(seqs)
    assert got == {r.kmer: r.n for r in kmers.count_kmers(frame(spark, [rc(s) if "N" not in s else s for s in seqs]), K).collect()}


def test_unitigs_with_branches_and_a_cycle(spark):
    loop = random_seq(40, 9)
    seqs = [random_seq(60, 4) + "GATTACA" + random_seq(30, 5), random_seq(25, 6) + "GATTACA" + random_seq(20, 7), loop + loop[:K]]
    solid = kmers.count_kmers(frame(spark, seqs), K)
    got = unitigs.numbered(unitigs.compact(solid, kmers.edges(solid), K)).collect()
    expected, cyclic = brute_unitigs(brute_count(seqs))
    found = {r.seq for r in got}
    assert expected <= found
    rings = found - expected
    inside = {min(w, rc(w)) for s in rings for w in (s[i : i + K] for i in range(len(s) - K + 1))}
    assert inside == {min(w, rc(w)) for w in cyclic}
    assert sorted(r.unitig_id for r in got) == list(range(len(got)))
    places = [min(w, rc(w)) for r in got for w in (r.seq[i : i + K] for i in range(r.len - K + 1))]
    assert sorted(set(places)) == sorted(brute_count(seqs))


def test_error_removal_and_rescue(spark):
    main, rare = "ACGTTGC" + "A" + "GGATC", "ACGTTGC" + "C" + "GGTTC"
    seqs = [main] * 4 + [rare]
    graph = kmers.edges(kmers.count_kmers(frame(spark, seqs), K))
    weak = kmers.weak_edges(graph, 0.5)
    assert {(r.u, r.v) for r in weak.collect()} == {("ACGTTGC", "CGTTGCC"), ("GGCAACG", "GCAACGT")}
    assert kmers.weak_edges(graph, 0.0).count() == 0
    transcript = kmers.edges(kmers.count_kmers(frame(spark, [main, rare]), K))
    assert kmers.rescue(weak, transcript).count() == 0
    assert kmers.without_edges(graph, weak).count() == graph.count() - 2


def exon_skip(spark):
    k = 15
    a, b, c = random_seq(60, 11), random_seq(60, 12), random_seq(60, 13)
    parts = [a, b, c, a[-k + 1 :] + c[: k - 1]]
    contigs = spark.createDataFrame(list(enumerate(parts)), "unitig_id long, seq string")
    transcript, skipped = a + b + c, a + c
    reads = frame(spark, [transcript] + [skipped] * 3 + [transcript] * 2)
    return k, parts, contigs, reads, transcript, skipped


def test_mapping_links_and_a_skipped_exon(spark):
    k, parts, contigs, reads, transcript, skipped = exon_skip(spark)
    hits = mapping.map_reads(reads, unitigs.index(contigs, k), k)
    forward = hits.where("read_index = 0 AND orientation = 'FW'").count()
    assert forward == sum(len(p) - k + 1 for p in parts[:3])
    own = hits.where("read_index = 0")
    colours = mapping.coloured(contigs, mapping.unitig_counts(own), mapping.unitig_counts(hits.where("read_index > 0")), k)
    counts = {r.unitig_id: (r.trustable, r.tr_count, r.sr_count) for r in colours.collect()}
    assert counts == {0: (True, 2, 10), 1: (True, 2, 4), 2: (True, 2, 10), 3: (False, 0, 6)}
    pairs = mapping.linked_pairs(mapping.runs(hits), colours, k)
    edges = {(r.src, r.src_strand, r.dst, r.dst_strand): (len(r.label), r.n) for r in mapping.linking_edges(pairs, reads, k).collect()}
    assert edges[0, "F", 2, "F"] == (k - 1, 3) and edges[0, "F", 1, "F"] == (k - 1, 3)
    assert edges[2, "R", 0, "R"] == (k - 1, 3)
    hint = {(r.src, r.dst) for r in mapping.hints(pairs).where("src_strand = 'F' AND dst_strand = 'F'").collect()}
    assert hint == {(0, 1), (1, 2), (0, 2)}
    mates = spark.createDataFrame([(1, 2)], "left long, right long")
    across = {(r.src, r.src_strand, r.dst, r.dst_strand) for r in mapping.mate_hints(hits, colours, mates).collect()}
    assert (0, "F", 2, "R") in across

    limits = bubbles.Limits(k=k, min_edit_distance=0.1)
    vertex = mapping.without_blue_only(mapping.vertices(colours, k))
    found = bubbles.find_bubbles(own, reads.where("read_index = 0"), vertex, mapping.linking_edges(pairs, reads, k), mapping.hints(pairs), limits)
    (row,) = found.collect()
    assert (row.path, row.label, row.source, row.target, row.event_type) == ("0_F 2_F", "AS", 60 - k, 120, "AS")
    assert row.orig_seq == transcript[60 - k : 120 + k] and row.alt_seq == skipped[60 - k : 60 + k]
    assert {r.metric for r in bubbles.stats(found).collect()} >= {"bubbles", "AS", "SNP"}
    assert mapping.quantified(own, colours).first().sr_mean == 8.0


def walk_of(nodes, seqs, k, gap=0):
    """Walk of a transcript through whole vertices, and the transcript."""
    rows, at, transcript = [], 0, ""
    for n in nodes:
        weight = len(seqs[n]) - k + 1
        rows += [(at + j, *n, j, weight) for j in range(weight)]
        transcript = transcript + seqs[n][k - 1 if transcript else 0 :]
        at += weight
    return pd.DataFrame([r for r in rows if r[0] != gap - 1], columns=["i", "unitig_id", "strand", "pos", "weight"]), transcript


def right_side(arcs, seqs, reads, k, related):
    rows = [("arc", *a, *b, seqs[a], len(seqs[a]) - k + 1, reads.get(a, 1), seqs[b], len(seqs[b]) - k + 1, reads.get(b, 1), True, "", None, None) for a, b in arcs]
    rows += [(kind, *[None] * 12, unitigs, seq) for kind, unitigs, seq in related]
    return pd.DataFrame(rows, columns="kind src src_strand dst dst_strand src_seq src_w src_sr dst_seq dst_w dst_sr link label unitigs seq".split())


def overlapping_nodes(k, n, seed):
    """Vertices that each begin with the last k - 1 bases of the one before."""
    whole = random_seq(60 * n, seed)
    return {(i, "F"): whole[max(0, 60 * i - k + 1) : 60 * i + 60] for i in range(n)}


def test_bubbles_behind_many_similar_paths_and_to_a_second_end():
    k = 15
    seqs = overlapping_nodes(k, 4, 50)
    start, one, end, far = sorted(seqs)
    out, into = seqs[start][-k + 1 :], seqs[end][: k - 1]
    base = random_seq(60, 60)
    middle = {(100 + i, "F"): out + base[: 20 + i] + "ACGT"["CGTA".index(base[20 + i])] + base[21 + i :] + into for i in range(12)}
    middle |= {(200, "F"): out + random_seq(60, 61) + into, (300, "F"): out + random_seq(60, 62) + seqs[far][: k - 1]}
    walk, transcript = walk_of([start, one, end, far], seqs, k, gap=5)
    arcs = [(start, one), (one, end), (end, far)] + [p for n in middle for p in ((start, n), (n, far if n[0] == 300 else end))]
    seqs |= middle
    right = right_side(arcs, seqs, {n: 9 if n[0] < 200 else 2 for n in middle}, k, [("own", [0, 1, 2, 3], transcript)])
    limits = bubbles.Limits(k=k, complexity_as=2)
    found = bubbles._search(limits)((0,), walk, right)
    assert sorted(found["path"]) == ["0_F 100_F 2_F", "0_F 200_F 2_F", "0_F 300_F 3_F"]
    for r in found.itertuples():
        assert r.orig_seq == transcript[r.source : r.target + k] and r.orig_seq[:k] == r.alt_seq[:k] and r.orig_seq[-k:] == r.alt_seq[-k:]
    # A transcript that shares a flank and holds one of the paths makes it known; one that shares none doesn't.
    for unitigs, paths in (([0], 2), ([77], 3)):
        told = right_side(arcs, seqs, {n: 9 if n[0] < 200 else 2 for n in middle}, k, [("own", [0, 1, 2, 3], transcript), ("other", unitigs, "A" + seqs[200, "F"] + "A")])
        assert len(bubbles._search(limits)((0,), walk, told)) == paths


def test_search_enters_only_what_leads_to_a_target():
    """A mesh of 40 layers that leads nowhere costs nothing."""
    k = 15
    seqs = overlapping_nodes(k, 3, 70)
    nodes = sorted(seqs)
    walk, transcript = walk_of(nodes, seqs, k)
    mesh = {(1000 + 2 * i + j, "F"): random_seq(40, 1000 + 2 * i + j) for i in range(40) for j in range(2)}
    arcs = list(zip(nodes, nodes[1:], strict=False)) + [(nodes[0], (1000, "F")), (nodes[0], (1001, "F"))]
    arcs += [((1000 + 2 * i + j, "F"), (1002 + 2 * i + m, "F")) for i in range(39) for j in range(2) for m in range(2)]
    found = bubbles._search(bubbles.Limits(k=k))((0,), walk, right_side(arcs, seqs | mesh, {}, k, [("own", [0, 1, 2], transcript)]))
    assert len(found) == 0


def test_gap_splits_a_run(spark):
    rows = [(0, "FW", i, u, "F", i) for i, u in ((0, 1), (1, 1), (3, 1), (4, 2), (5, 1))]
    hits = spark.createDataFrame(rows, "read_index long, orientation string, i int, unitig_id long, strand string, pos int")
    got = [(r.run, r.unitig_id, r.first_i, r.last_i) for r in mapping.runs(hits).orderBy("run").collect()]
    assert got == [(1, 1, 0, 1), (2, 1, 3, 3), (3, 2, 4, 4), (4, 1, 5, 5)]


def test_unitig_edge_labels(spark):
    x = "ACGGTC"
    seqs = ["TTTT" + x, x + "GGAA", rc(x) + "CCAT", "GATT" + rc(x)]
    df = spark.createDataFrame(list(enumerate(seqs)), "unitig_id long, seq string")
    got = {(r.src, r.dst): r.label for r in unitigs.unitig_edges(df, 7).collect()}
    assert got[0, 1] == "FF" and got[1, 0] == "RR" and got[0, 3] == "FR" and got[1, 2] == "RF" and (0, 2) not in got


def test_reachability(spark):
    graph = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 20), ("c", "a", 1), ("c", "d", 9)], "src string, dst string, w long")
    start = spark.createDataFrame([(1, "a")], "group long, node string")
    end = spark.createDataFrame([(1, "c")], "group long, node string")
    assert {(r.node, r.dist) for r in traversal.reachable(start, graph, 12).collect()} == {("a", 0), ("b", 5), ("c", 10)}
    assert {r.node for r in traversal.between(start, end, graph, 12).collect()} == {"a", "b", "c"}


def test_empty_inputs(spark):
    none = frame(spark, []).where(F.lit(True))
    solid = kmers.count_kmers(none, K)
    assert solid.count() == 0 and unitigs.compact(solid, kmers.edges(solid), K).count() == 0


def test_a_search_stops_at_its_first_target(spark):
    from strandloom.operators import traversal

    line = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(30)] + [("n0", "n20", 9)], "src string, dst string, w long")
    starts = spark.createDataFrame([("a", "n0"), ("b", "n28"), ("c", "n0")], "group string, node string")
    targets = spark.createDataFrame([("a", "n3"), ("a", "n25"), ("b", "n0"), ("c", "n0")], "group string, node string")
    assert {tuple(r) for r in traversal.nearest(starts, targets, line, 40).collect()} == {("a", 3), ("c", 0)}
    seen = traversal.reachable(starts, line, 40, targets).where("group = 'a'").select("node").collect()
    assert {r["node"] for r in seen} <= {f"n{i}" for i in [*range(5), *range(20, 24)]}  # what lies behind is never reached
    assert {tuple(r) for r in traversal.nearest(starts.where("group = 'b'"), targets, line, 40).collect()} == set()


def test_sample_of_hot_small_and_null_groups(spark):
    import hashlib

    from strandloom.operators import simulate

    rows = [(i, "hot" if i % 3 else None if i % 9 == 0 else f"g{i % 60}") for i in range(3000)] + [(None, "alone")]
    got = {tuple(r) for r in simulate.sample_per_group(spark.createDataFrame(rows, "id long, g string"), "g", "id", 0.1).collect()}
    expected = set()
    for g in {g for _, g in rows}:
        own = sorted((i for i, x in rows if x == g), key=lambda i: ("", 0) if i is None else (hashlib.md5(str(i).encode()).hexdigest(), i))
        expected |= {(i, g) for i in own[: max(1, int(len(own) * 0.1))]}
    assert got == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reachable_of_sets(spark, seed, monkeypatch):
    """As the search from every group; groups with the same sources are searched once."""
    rng = random.Random(seed)
    arcs = {(str(a), str(b)): rng.choice([1, 2, 7]) for a, b in (rng.sample(range(12), 2) for _ in range(30))}
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src string, dst string, w long")
    rows = [(g, str(rng.randrange(13))) for g in range(6) for _ in range(3)] + [(g, n) for g in range(100, 160) for n in ("1", "5", "1")]
    sources = spark.createDataFrame(rows, "group int, node string")
    expected = sorted(map(tuple, traversal.reachable(sources, graph, 9).collect()))
    searched = []
    plain = traversal.reachable
    monkeypatch.setattr(traversal, "reachable", lambda s, *rest: (searched.append(s.distinct().count()), plain(s, *rest))[1])
    assert sorted(map(tuple, traversal.reachable_of_sets(sources, graph, 9).collect())) == expected
    assert searched[0] <= 13
