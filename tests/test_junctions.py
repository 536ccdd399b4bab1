"""The graph by junctions, against the tables of edges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.operators import glue, junctions, kmers, unitigs
from strandloom.plans import checkpoints

K = 7


def graph_of(spark, seqs, k=K, least=1):
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string")
    return kmers.count_kmers(rows, k, least, pack=True).localCheckpoint()


def drawn(seed, n=40, length=60):
    rng = random.Random(seed)
    return ["".join(rng.choices("ACGT", k=length)) for _ in range(n)]


def symmetric(graph, k):
    """A fifth of the edges, on both strands."""
    some = graph.where("u % 5 = 0").select("u", "v")
    turned = some.select(kmers.turned(some, "v", k).alias("u"), kmers.turned(some, "u", k).alias("v"))
    return some.unionByName(turned).distinct().localCheckpoint()


@pytest.mark.parametrize("small", [False, True])
def test_degrees_and_weak_edges_equal_those_of_edges(spark, monkeypatch, small):
    if small:  # blocks of a few buckets, and every minimizer dealt by junctions
        monkeypatch.setattr(junctions, "BLOCK", 50)
        monkeypatch.setattr(junctions, "hot_minimizers", lambda kmers, k: list(range(64)))
    solid = graph_of(spark, drawn(1))
    graph = kmers.edges(solid, K).localCheckpoint()
    expected = kmers.degrees(graph).groupBy("n_in", "n_out").agg(F.count("*").alias("nodes"))
    assert sorted(junctions.degree_counts(solid, K).collect()) == sorted(expected.collect())
    assert sorted(junctions.weak_edges(solid, K, 0.4).collect()) == sorted(kmers.weak_edges(graph, 0.4, K).collect())
    assert sorted(junctions.forks(solid, K).collect()) == sorted(kmers.branching(graph).select(F.least("kmer", kmers.turned(graph.select(F.col("u").alias("kmer")), "kmer", K)).alias("kmer")).distinct().collect())


def test_rescue_without_the_edges_of_transcripts(spark):
    reads, known = graph_of(spark, drawn(2, 60)), graph_of(spark, drawn(2, 10) + drawn(3, 20))
    removed = kmers.weak_edges(kmers.edges(reads, K), 0.5, K).localCheckpoint()
    expected = kmers.rescue(removed, kmers.edges(known, K))
    got = kmers.rescue_at(removed, known, junctions.forks(known, K), K)
    assert sorted(got.collect()) == sorted(expected.collect())
    assert 0 < got.count() < removed.count()


@pytest.mark.parametrize("block", [junctions.BLOCK, 30])
def test_unitigs_equal_those_of_the_table_of_edges(spark, monkeypatch, block):
    monkeypatch.setattr(junctions, "BLOCK", block)
    k = 9
    ring = "ACGGTTCATGCATTCCGA"
    solid = graph_of(spark, [*drawn(4, 30, 200), ring + ring[: k - 1], "A" * 20, "TTTTGGGGAAAACCCC" * 3], k)
    graph = kmers.edges(solid, k).localCheckpoint()
    assert sorted(unitigs.unitigs_of(solid, k).collect()) == sorted(unitigs.compact(solid, graph, k).collect())
    gone = symmetric(graph, k)
    expected = unitigs.compact(solid, kmers.without_edges(graph, gone), k)
    assert sorted(unitigs.unitigs_of(solid, k, gone).collect()) == sorted(expected.collect())


def test_rings_and_one_long_stretch(spark, monkeypatch):
    monkeypatch.setattr(junctions, "BLOCK", 16)
    k, rng = 21, random.Random(5)
    low = lambda s: min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    ring, long = ("".join(rng.choices("ACGT", k=n)) for n in (40, 200))
    solid = graph_of(spark, [ring + ring[: k - 1], long], k)
    got = {r.seq: r.coverage for r in unitigs.unitigs_of(solid, k).collect()}
    least = min(low((ring * 2)[i : i + k]) for i in range(40))
    around = next(s for s in (ring * 3, low(ring * 3), (ring * 3)[::-1].translate(str.maketrans("ACGT", "TGCA"))) if least in s)
    opened = around[around.index(least) :][: 40 + k - 1]
    assert got == {low(long): 1.0, low(opened): 1.0}


def test_settled_leaves_only_its_own_table(spark):
    inside = []

    def make():
        inside.append(checkpoints.written(spark.range(5).toDF("x"), "inner"))
        return inside[0].where("x > 1")

    kept = checkpoints.settled("outer", make)
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(inside[0]._strandloom_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def placed(spark, seqs):
    return spark.createDataFrame([(i // 3, i % 4 == 0, s) for i, s in enumerate(seqs)], "place long, transcript boolean, seq string")


def awkward(k):
    """Repeats, rings, hairpins, one-letter runs and short sequences."""
    rng, turn = random.Random(8), str.maketrans("ACGT", "TGCA")
    words = ["".join(rng.choices("ACGT", k=n)) for n in (30, 45, 60, 80, 120, 300)]
    texts = ["".join(rng.choices(words, k=6)) for _ in range(40)]
    rings = ["".join(rng.choices("ACGT", k=n)) for n in (5, 40, 900)]
    return [*texts, *(x[::-1].translate(turn) for x in texts[:7]), *(r * (2 + 2 * k // len(r)) for r in rings), words[4] + words[4][::-1].translate(turn), "A" * 90, "AC" * 80, "", "ACGT", texts[0] + "N" + texts[1], words[5] * 3]


@pytest.mark.parametrize("hot, rows", [(junctions.HOT_RUNS, glue.ROWS), (300, 8)])
@pytest.mark.parametrize("least", [1, 2])
def test_texts_have_the_unitigs_of_their_kmers(spark, monkeypatch, hot, rows, least):
    monkeypatch.setattr(junctions, "HOT_RUNS", hot)
    monkeypatch.setattr(glue, "ROWS", rows)
    seqs = awkward(21)
    solid = graph_of(spark, seqs, 21, least)
    expected = sorted(unitigs.compact(solid, kmers.edges(solid, 21), 21).collect())
    assert sorted(unitigs.unitigs_of_texts(placed(spark, seqs), 21, least).collect()) == expected
    assert sorted(unitigs.unitigs_of(solid, 21).collect()) == expected


@pytest.mark.parametrize("hot", [junctions.HOT_RUNS, 300])
def test_weak_edges_and_forks_of_texts_need_no_table_of_kmers(spark, monkeypatch, hot):
    """Every side was counted twice, and the k-mers of both were dealt three times more."""
    monkeypatch.setattr(junctions, "HOT_RUNS", hot)
    for module in (kmers, junctions):
        monkeypatch.setattr(module, "count_kmers" if module is kmers else "dealt", lambda *a, f=getattr(module, "count_kmers" if module is kmers else "dealt"), **b: calls.append(1) or f(*a, **b))
    calls, rng = [], random.Random(11)
    # Words cut anywhere, so that reads branch where transcripts do and elsewhere.
    words = ["".join(rng.choices("ACGT", k=n)) for n in (30, 45, 60, 80)]
    seqs = [*awkward(21), *("".join(w[rng.choice([0, 0, 7]) :] for w in rng.choices(words, k=9)) for _ in range(80))]
    rows = placed(spark, seqs)
    removed = kmers.rescue_marked(junctions.weak_and_forks(rows, 21, 2, 0.34), 21).localCheckpoint()
    got = sorted(unitigs.unitigs_of_fragments(lambda: junctions.merged_fragments(rows, 21, 2, removed), 21).collect())
    assert not calls

    reads, known = (kmers.count_kmers(rows.where(c), 21, n, pack=True).localCheckpoint() for c, n in (("NOT transcript", 2), ("transcript", 1)))
    weak = kmers.weak_edges(kmers.edges(reads, 21), 0.34, 21).localCheckpoint()
    gone = kmers.rescue(weak, kmers.edges(known, 21)).localCheckpoint()
    assert 0 < gone.count() < weak.count()
    assert sorted(removed.collect()) == sorted(gone.collect())
    solid = reads.unionByName(known).groupBy("kmer").agg(F.max("n").alias("n")).localCheckpoint()
    assert got == sorted(unitigs.compact(solid, kmers.without_edges(kmers.edges(solid, 21), gone), 21).collect())


def test_a_long_stretch_is_written_a_few_times_only(spark, monkeypatch):
    """Stretches of one text meet in one round, which took a round for each doubling of their number before."""
    tables = []
    for module in (glue, unitigs):
        monkeypatch.setattr(module, "written", lambda df, name: tables.append(checkpoints.written(df, name)) or tables[-1])
    long = "".join(random.Random(9).choices("ACGT", k=60_000))
    solid = graph_of(spark, [long], 21).withColumn("place", F.lit(1))
    assert unitigs.unitigs_of(solid, 21).count() == 1
    assert len(tables) <= 3


def test_written_tables_leave_no_shuffle_files(spark):
    """Files of all rounds stayed on disk until the driver collected its garbage."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = folders.getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}

    before = left()
    rows = checkpoints.written(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 50).alias("g")).agg(F.count("*").alias("n")), "rows")
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    assert rows.count() == 50
