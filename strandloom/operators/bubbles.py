"""Bubbles: a known path of a transcript paired with a novel one from the reads.

The search runs per transcript on the part of the linking graph that the
transcript's vertices reach within the length limit, so a task holds one
transcript, its neighbourhood and the transcripts that share a vertex with it,
whatever the size of the whole graph. Paths are enumerated in a fixed order, so
results are the same in every run.

A path leaves the transcript at the last k-mer of a vertex and comes back at the
first k-mer of another one, so both paths of a bubble begin and end with the same
k bases. Only vertices from which a target can still be reached within the length
limit are entered.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.alignment import edit_both, semi_global_both, turned
from strandloom.operators.traversal import reachable
from strandloom.plans.checkpoints import written


@dataclass(frozen=True)
class Limits:
    """Options of the search; the defaults are those of the command line."""

    k: int = 31
    max_length_as: int = 2000
    max_length_intron: int = 11100
    complexity_as: int = 10
    complexity_ir: int = 1
    min_edit_distance: float = 0.2
    cluster_share: float = 0.2


def _extend(path, label, seqs, k):
    """Sequence along a path: the last k bases of the first node, then new bases."""
    out = seqs[path[0]][-k:]
    for i, node in enumerate(path[1:], 1):
        out += label.get((path[i - 1], node), "")
        out += seqs[node][k - 1 : k] if i == len(path) - 1 else seqs[node][k - 1 :]
    return out


def _rest(targets, back, weights, budget):
    """Least cost from every node to a target, as far as it lies within the budget."""
    least, heap = {}, [(0, t) for t in sorted(targets)]
    while heap:
        cost, node = heapq.heappop(heap)
        if node in least:
            continue
        least[node] = cost
        for before in back.get(node, ()):
            if cost + weights[node][0] <= budget and before not in least:
                heapq.heappush(heap, (cost + weights[node][0], before))
    return least


def _paths(start, targets, links, back, weights, hints, budget, full):
    """Simple paths from a start to any target within the budget, one at a time.

    No path to a target in ``full`` comes; the caller adds to it as it goes.
    Neighbours that more of the path hints at come first, then those with more
    short reads, then by name.
    """
    rest = _rest(set(targets), back, weights, budget)
    stack = [((start,), 0)]
    while stack and len(full) < len(targets):
        path, used = stack.pop()
        if len(path) > 1 and path[-1] in targets:
            if path[-1] not in full:
                yield path
            continue
        choices = []
        for node in links.get(path[-1], ()):
            if node in rest and node not in path and used + weights[node][0] + rest[node] <= budget:
                hinted = sum((p, node) in hints for p in path)
                choices.append(((hinted, weights[node][1], [-node[0], node[1]]), (*path, node), used + weights[node][0]))
        stack += [(p, c) for _, p, c in sorted(choices, key=lambda x: x[0])]


def _class(distance: int, length: int, limits: Limits) -> str:
    if distance <= 1:
        return "SNP"
    if distance / length <= limits.min_edit_distance:
        return "MSNPs"
    return "REPEATS" if length <= 2 * limits.k - 8 else "AS"


def _similar(a: str, b: str, share: float) -> bool:
    return semi_global_both(a, b) / max(1, min(len(a), len(b))) < share


_FOUND = (
    "read_index long, label string, source int, target int, orig_path string, path string, orig_seq string, alt_seq string, n_nodes int, n_branches int, "
    "edit_distance int, event_type string, representative boolean"
)


def _search(limits: Limits):
    k = limits.k
    columns = [c.split()[0] for c in _FOUND.split(", ")]

    def run(key, walk: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = right[right["kind"] == "own"]["seq"]
        if not len(walk) or not len(own):
            return pd.DataFrame([], columns=columns)
        transcript = own.iloc[0]
        walk = walk.sort_values("i")
        places, nodes = walk["i"].tolist(), list(zip(walk["unitig_id"], walk["strand"], strict=True))
        first, last = dict(zip(places, walk["pos"] == 0, strict=True)), dict(zip(places, walk["pos"] == walk["weight"] - 1, strict=True))
        at = dict(zip(places, nodes, strict=True))

        seqs, weights, links, back, label, hints = {}, {}, {}, {}, {}, set()
        for r in right[right["kind"] == "arc"].itertuples():
            a, b = (int(r.src), r.src_strand), (int(r.dst), r.dst_strand)
            for n, s, w, c in ((a, r.src_seq, r.src_w, r.src_sr), (b, r.dst_seq, r.dst_w, r.dst_sr)):
                seqs[n], weights[n] = s, (max(1, int(w)), int(c))
            hints.add((a, b))
            if r.link:
                links.setdefault(a, []).append(b)
                back.setdefault(b, []).append(a)
                label[a, b] = r.label or ""
        related = [(set(r.unitigs), r.seq) for r in right[right["kind"] != "arc"].itertuples()]

        def known(path, novel) -> bool:
            for unitigs, seq in related:
                if path[0][0] in unitigs or path[-1][0] in unitigs:
                    if novel in seq or turned(novel) in seq or _similar(seq, novel, limits.min_edit_distance):
                        return True
            return False

        rows, seen = [], []
        for i in places:
            source = at[i]
            if source not in links or not last[i] or at.get(i + 1) == source:
                continue
            spans = (("AS", limits.complexity_as, limits.max_length_as + 1, None), ("IR", limits.complexity_ir, limits.max_length_intron + 1, i + k + 1))
            for kind, most, budget, end in spans:
                allowed = {at[j] for j in places if j >= i + max(1, k - 10) and (end is None or j < end)}
                targets = {}
                for j in places:
                    if j > i and at[j] in allowed and at[j] != source and at[j] in weights and at[j] not in targets:
                        targets[at[j]] = j
                targets = {n: j for n, j in targets.items() if first[j]}
                if not targets:
                    continue
                given, full = {}, set()
                for path in _paths(source, targets, links, back, weights, hints, budget, full):
                    novel = _extend(path, label, seqs, k)
                    if known(path, novel):
                        continue
                    old = any(_similar(s, novel, limits.min_edit_distance) for s in seen)
                    seen.append(novel)
                    if old:
                        continue
                    given[path[-1]] = given.get(path[-1], 0) + 1
                    if given[path[-1]] >= most:
                        full.add(path[-1])
                    j = targets[path[-1]]
                    passed = list(dict.fromkeys(at[x] for x in places if i <= x <= j))
                    name = lambda p: " ".join(f"{n}_{s}" for n, s in p)
                    orig = transcript[i : j + k]
                    distance = edit_both(orig, novel)
                    branches = sum(len(links.get(n, ())) > 1 or len(back.get(n, ())) > 1 for n in path)
                    rows.append([key[0], kind, i, j, name(passed), name(path), orig, novel, len(path), branches, distance, _class(distance, len(novel), limits)])
        # Clusters of each class begin with the transcript itself.
        kept: dict[str, list[str]] = {}
        for r in rows:
            mine = kept.setdefault(r[-1], [transcript])
            r.append(not any(_similar(r[7], s, limits.cluster_share) for s in mine))
            if r[-1]:
                mine.append(r[7])
        return pd.DataFrame(rows, columns=columns)

    return run


def find_bubbles(mapping: DataFrame, transcripts: DataFrame, vertex: DataFrame, links: DataFrame, hint: DataFrame, limits: Limits) -> DataFrame:
    """One row per bubble, with its class and whether it heads a cluster.

    ``mapping``: hits of the transcripts; ``transcripts``: (read_index, seq);
    ``vertex``: as from :func:`strandloom.operators.mapping.vertices`; ``links``
    and ``hint``: as from the functions of those names there. A path is novel if
    no transcript that has one of its end vertices holds it or is similar to it,
    and no earlier path of this transcript is.
    """
    name = lambda u, s: F.concat_ws("_", F.col(u).cast("string"), F.col(s))
    good = written(vertex.where("trustable").withColumn("node", name("unitig_id", "strand")), "vertices")
    forward = mapping.where("orientation = 'FW'")
    walk = forward.join(good.select("unitig_id", "strand", "weight"), ["unitig_id", "strand"])
    walk = written(walk.select("read_index", "i", "unitig_id", "strand", "pos", "weight"), "walks")
    both = hint.select("src", "src_strand", "dst", "dst_strand")
    arcs = both.join(links.select("src", "src_strand", "dst", "dst_strand", "label"), ["src", "src_strand", "dst", "dst_strand"], "left").withColumn("link", F.col("label").isNotNull())
    end = lambda side: good.select(F.col("unitig_id").alias(side), F.col("strand").alias(f"{side}_strand"), F.col("seq").alias(f"{side}_seq"), F.col("weight").alias(f"{side}_w"), F.col("sr_count").alias(f"{side}_sr"))
    arcs = written(arcs.join(end("src"), ["src", "src_strand"]).join(end("dst"), ["dst", "dst_strand"]), "arcs")
    graph = arcs.where("link").select(name("src", "src_strand").alias("src"), name("dst", "dst_strand").alias("dst"), F.greatest("dst_w", F.lit(1)).cast("long").alias("w"))
    near = reachable(walk.select(F.col("read_index").alias("group"), name("unitig_id", "strand").alias("node")), graph, max(limits.max_length_as, limits.max_length_intron) + 1)
    named = arcs.withColumns({"a": name("src", "src_strand"), "b": name("dst", "dst_strand")})
    local = near.select("group", F.col("node").alias("a")).join(named, "a").join(near.select("group", F.col("node").alias("b")), ["group", "b"]).withColumnRenamed("group", "read_index").drop("a", "b")
    local = local.withColumn("kind", F.lit("arc"))

    # Transcripts that share an end vertex of a path, which is one of the walk, with the transcript.
    holds = mapping.select("unitig_id", "read_index").distinct()
    shared = walk.select("read_index", "unitig_id").distinct().join(holds.withColumnRenamed("read_index", "other"), "unitig_id")
    related = shared.groupBy("read_index", "other").agg(F.collect_set("unitig_id").alias("unitigs"))
    related = related.join(transcripts.select(F.col("read_index").alias("other"), "seq"), "other")
    related = related.withColumn("kind", F.when(F.col("other") == F.col("read_index"), "own").otherwise("other")).drop("other")
    found = (
        walk.groupBy("read_index")
        .cogroup(local.unionByName(related, allowMissingColumns=True).groupBy("read_index"))
        .applyInPandas(_search(limits), _FOUND)
    )
    return found.withColumn("bubble_id", F.row_number().over(Window.partitionBy("read_index").orderBy("source", "label", "path")))


def stats(bubbles: DataFrame) -> DataFrame:
    """(metric, value): named counters of a run."""
    kinds = ["SNP", "MSNPs", "REPEATS", "AS"]
    counts = [F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in kinds]
    one = bubbles.agg(F.count("*").alias("bubbles"), F.count(F.when(F.col("representative"), 1)).alias("clusters"), *counts)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("metric", "value"))
