"""Alternative paths over a region too tangled to enumerate: repeat bridging.

From every node of a known walk, paths leave it and grow as a frontier table until they
come home to the walk, or stop because they would pass more forks than allowed or
grow too long. The same on the reversed graph gives the paths that come back.
A stopped path out and a stopped path in are joined where the end of one reaches the
begin of the other within a bounded distance, and nothing else of them is shared;
what lies between stays unknown. The join goes through a table of who reaches whom,
so paths that can't meet are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import path_sequence
from strandloom.operators.paths import reversed_arcs
from strandloom.operators.traversal import reachable
from strandloom.plans.checkpoints import dropped, written


def leaving(walks: DataFrame, graph: DataFrame, most: int, forks: int) -> DataFrame:
    """(walk, path, dist, home): paths from a node of a walk (walk, node) over nodes that aren't its own.

    ``home``: the last node is one of the walk. Otherwise the path stopped where going on
    would pass more than ``forks`` nodes with several arcs (the first one included) or
    exceed the length ``most``; of one that stopped for its length, all
    its arcs do. A path that ends at a node without arcs is dropped.
    """
    own = written(walks.select("walk", "node").distinct(), "walk")
    degree = graph.groupBy("src").agg(F.count("*").alias("n_out"))
    arcs = written(graph.join(degree, "src"), "arcs")
    front = written(own.select("walk", "node", F.array("node").alias("path"), F.lit(0).cast("long").alias("dist"), F.lit(0).alias("forks")), "front")
    done = []
    while not front.isEmpty():
        step = front.join(arcs, F.col("node") == F.col("src"))
        passed = F.col("forks") + (F.col("n_out") > 1).cast("int")
        step = step.select("walk", "node", "path", "dist", "dst", "w", passed.alias("passed"), ((passed > forks) | (F.col("dist") + F.col("w") > most)).alias("late"))
        step = step.join(own.select("walk", F.col("node").alias("dst"), F.lit(True).alias("mine")), ["walk", "dst"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
        step = written(step, "step")
        stopped = step.groupBy("walk", "path", "dist").agg(F.min("late").alias("late")).where(F.col("late") & (F.size("path") > 1))
        done.append(written(stopped.select("walk", "path", "dist", F.lit(False).alias("home")), "stopped"))
        went = step.where(~F.col("late") & ~F.array_contains("path", F.col("dst")))
        went = went.select("walk", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("dist") + F.col("w")).alias("dist"), F.col("passed").alias("forks"), "mine")
        done.append(written(went.where("mine").select("walk", "path", "dist", F.lit(True).alias("home")), "home"))
        before, front = front, written(went.where("NOT mine").drop("mine"), "front")
        dropped(before, step)
    out = done[0] if done else own.select("walk", F.array("node").alias("path"), F.lit(0).cast("long").alias("dist"), F.lit(False).alias("home")).where("false")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def bridges(walks: DataFrame, graph: DataFrame, most: int, forks: int, gap: int) -> DataFrame:
    """(walk, source, target, first, gap, second): pairs of a path out and a path in that an unknown stretch joins.

    ``walks``: (walk, pos, node), ``graph``: (src, dst, w). The source stands before the
    target in the walk (first positions count). ``gap`` is the length from the end of
    the first path to the begin of the second one, its first node included; 0
    where both are one node, which then stands in both.
    """
    place = written(walks.groupBy("walk", "node").agg(F.min("pos").alias("pos")), "places")
    out = leaving(place, graph, most, forks).where("NOT home").select("walk", F.col("path").alias("first"), F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("end"))
    back = leaving(place, reversed_arcs(graph), most, forks).where("NOT home")
    back = back.select("walk", F.reverse("path").alias("second"), F.get("path", F.lit(0)).alias("target"), F.element_at("path", -1).alias("begin"))
    out, back = written(out, "out"), written(back, "back")
    reach = reachable(out.select(F.col("end").alias("group"), F.col("end").alias("node")).distinct(), graph, gap).select(F.col("group").alias("end"), F.col("node").alias("begin"), F.col("dist").alias("gap"))
    # Only ends and begins of one walk meet.
    met = out.join(reach, "end").join(back, ["walk", "begin"])
    at = lambda c: place.select("walk", F.col("node").alias(c), F.col("pos").alias(f"{c}_pos"))
    met = met.join(at("source"), ["walk", "source"]).join(at("target"), ["walk", "target"]).where("source_pos < target_pos")
    alone = F.when(F.col("end") == F.col("begin"), F.slice("first", 1, F.size("first") - 1)).otherwise(F.col("first"))
    return met.where(~F.arrays_overlap(alone, "second")).select("walk", "source", "target", "first", "gap", "second")


def bridge_sequence(first: Column, gap: Column, weight: Column, second: Column, k: int) -> Column:
    """Sequences of both parts with an N for each unknown k-mer between; ``first`` and ``second`` are node sequences, ``weight`` the k-mers of the second's first node.

    Where both parts share a node, they are one path.
    """
    apart = F.concat(path_sequence(first, k, True), F.repeat(F.lit("N"), F.greatest(gap - weight, F.lit(0)).cast("int")), path_sequence(second, k, True))
    return F.when(gap == 0, path_sequence(F.concat(first, F.slice(second, 2, F.size(second))), k, True)).otherwise(apart)
