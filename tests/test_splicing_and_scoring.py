"""Annotation, simulation, scoring and streaming operators."""

from pyspark.sql import functions as F

from strandloom.operators import evaluate, simulate, splicing, unitigs
from strandloom.plans import checkpoints
from strandloom.streaming import lookup


def test_chains(spark):
    df = spark.createDataFrame([("10^20-30^",), ("5[9)7",), ("",)], "c string")
    chain = splicing.splice_chain(F.col("c"))
    rows = df.select(chain.alias("a"), splicing.reversed_chain(chain).alias("b")).collect()
    assert [(s.coord, s.kind) for s in rows[0].a] == [(10, "end"), (20, "start"), (30, "end")]
    assert [(s.coord, s.kind) for s in rows[0].b] == [(30, "start"), (20, "end"), (10, "start")]
    assert [(s.coord, s.kind) for s in rows[1].a] == [(5, "start"), (9, "end")]
    assert rows[2].a == []


def test_exons(spark):
    df = spark.createDataFrame([("T", 50, 60), ("T", 1, 9), ("T", 20, 30)], "transcript_id string, start int, end int")
    around = {r.start: (r.previous and r.previous.start, r.next and r.next.start) for r in splicing.neighbours(df).collect()}
    assert around == {1: (None, 20), 20: (1, 50), 50: (20, None)}
    sites = spark.createDataFrame([("T", 30, "end"), ("T", 50, "start"), ("T", 51, "start")], "transcript_id string, coord int, kind string")
    assert {(r.coord, r.start) for r in splicing.exon_at(df, sites).collect()} == {(30, 20), (50, 50)}
    flank = df.select("start", splicing.trimmed_flanks(F.col("start"), F.col("end"), 10, True).alias("l"), splicing.trimmed_flanks(F.col("start"), F.col("end"), 10, False).alias("r"))
    assert {r.start: (r.l and (r.l.start, r.l.end), r.r and (r.r.start, r.r.end)) for r in flank.collect()} == {1: (None, None), 20: ((21, 30), (20, 29)), 50: ((51, 60), (50, 59))}
    pairs = splicing.event_pairs(spark.createDataFrame([("a,b", "c,d")], "transcripts_1 string, transcripts_2 string"))
    assert {(r.transcript_1, r.transcript_2) for r in pairs.collect()} == {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    reasons = spark.createDataFrame([(True, None, 5, 5), (False, 50, 50, 5), (True, 5, 50, 5), (True, 50, 50, None), (True, 50, 50, 5)], "m boolean, l int, r int, x int")
    got = [r.why for r in reasons.select(splicing.rejection(F.col("m"), F.col("l"), F.col("r"), F.col("x"), 31).alias("why")).collect()]
    assert got == ["no_flank", "flank_mismatch", "short_flank", "no_exon", None]


def test_overlaps_once(spark):
    spans = [(1, 0, 1000), (2, 10, 20), (3, 20, 30), (4, 31, 40), (5, 990, 2000)]
    got = sorted(tuple(r) for r in splicing.overlapping(spark.createDataFrame(spans, "id int, start int, end int"), 50).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3)]


def test_simulation(spark):
    seqs = spark.createDataFrame([(1, "ACGTT" * 40), (2, "A" * 101), (3, "A" * 102)], "read_index long, seq string")
    got = simulate.simulate_reads(seqs).collect()
    assert sorted((r.read_index, r.start) for r in got) == [(1, 0), (1, 30), (1, 60), (1, 90), (3, 0)]
    assert all(len(r.seq) == 101 for r in got)
    rows = spark.createDataFrame([(i, "g" if i < 25 else "h", "A" * i) for i in range(28)], "id int, gene string, seq string")
    shallow, rest = simulate.shallow_and_rest(rows, "gene", "id", 0.1, 3)
    assert shallow.groupBy("gene").count().orderBy("gene").collect()[0]["count"] == 2
    assert shallow.count() == 3 and rest.count() == 25


def test_scoring(spark):
    x, y = "ACGTACGGTTCAGGCTTAAC", "ACGTACGGTTTTCAGGCTTAAC"
    truth = spark.createDataFrame([(1, x, y), (2, "GGGGGCCCCC", "GGGGGACCCCC")], "id long, a string, b string")
    found = spark.createDataFrame([(10, y, x), (11, "TTTTTTTTTT", "TTTTTATTTTT")], "id long, a string, b string")
    hit = evaluate.matches(truth, found, 7)
    assert [tuple(r) for r in hit.collect()] == [(1, 10)]
    twice = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert evaluate.distinct_bubbles(twice).count() == 2
    flags = spark.createDataFrame([(10, True, True, False), (11, False, True, False), (12, False, False, True), (13, False, False, False)], "id long, matched boolean, same_gene boolean, chimeric boolean")
    classed = evaluate.triage(flags)
    assert [r["class"] for r in classed.orderBy("id").collect()] == ["matched", "same_gene", "chimeric", "unexplained"]
    score = evaluate.precision_recall(truth, classed, hit).first()
    assert (score.recall, score.precision) == (0.5, 0.5)
    shallow = spark.createDataFrame([(1, "CC" + x)], "id long, seq string")
    named = truth.withColumns({"a_transcript": F.lit("t1"), "b_transcript": F.when(F.col("id") == 1, "t2").otherwise("t3")})
    heard = evaluate.expressed_transcripts(spark.createDataFrame([("t1_0",), ("t1_1",), ("t2_5",)], "header string"))
    assert [r.id for r in evaluate.truth_filter(named, shallow, heard).collect()] == [1]
    assert evaluate.truth_filter(named, shallow, heard.where("transcript_id = 't1'")).count() == 0


def test_best_score_where_nothing_is_contained(spark):
    import random

    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(80))
    near, nearer = base[:40] + "AAAA" + base[44:], base[:40] + ("A" if base[40] != "A" else "C") + base[41:]
    truth = spark.createDataFrame([(1, base, base[::-1])], "id long, a string, b string")
    found = spark.createDataFrame([(5, near, base[::-1] + "X"), (6, nearer, base[::-1]), (7, nearer, base[::-1])], "id long, a string, b string")
    assert [tuple(r) for r in evaluate.matches(truth, found, 15).collect()] == [(1, 6)]


def test_classes_of_found_bubbles(spark):
    import random

    rng = random.Random(5)
    g1, g1b, g2 = ("".join(rng.choice("ACGT") for _ in range(90)) for _ in range(3))
    changed = g1b[:50] + ("A" if g1b[50] != "A" else "C") + g1b[51:]
    every = spark.createDataFrame([(1, "g1", g1), (2, "g1", g1b), (3, "g2", g2)], "id long, gene string, seq string")
    found = spark.createDataFrame([(10, "g1", g1[:40]), (11, "g1", changed), (12, "g1", g2[5:60]), (13, "g1", "ACGT" * 12)], "id long, gene string, novel string")
    matched = spark.createDataFrame([(1, 10)], "truth_id long, found_id long")
    classed = evaluate.classified(found, matched, every, every.where("id <> 2").select("id"))
    assert [r["class"] for r in classed.orderBy("id").collect()] == ["matched", "same_gene", "chimeric", "unexplained"]


def test_streaming_lookup(spark, tmp_path):
    contigs = spark.createDataFrame([(1, "ACGTACCTTGA"), (2, "GGGATTTCC")], "unitig_id long, seq string")
    index = unitigs.index(contigs, 5)
    reads = spark.createDataFrame([(1, "ACGTACC"), (2, "GGGATTT")], "read_index long, seq string")
    reads.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/in")
    query = lookup.stream_unitig_counts(stream, index, 5).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert {r.unitig_id: r.hits for r in spark.table("hits").collect()} == {1: 6, 2: 6}


def test_saved_step_is_reused(spark, tmp_path):
    path = f"{tmp_path}/step"
    assert checkpoints.saved(spark.range(3), path).count() == 3
    assert checkpoints.saved(spark.range(9), path, resume=True).count() == 3
    assert checkpoints.saved(spark.range(9), path).count() == 9


def test_holders_by_length_class(spark):
    """Needles of every length, one base to longer than k, with odd letters; a short one leaves the candidates of others alone."""
    import random

    rng = random.Random(11)
    hay = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 60, 200])))) for i in range(40)]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    needles = []
    for i in range(150):
        _, s = hay[rng.randrange(40)]
        at, n = rng.randrange(len(s) + 1), rng.choice([0, 1, 3, 7, 8, 12, 16, 25, 31, 80])
        needles.append((i, rng.choice([s[at : at + n], rc(s[at : at + n]), s[at : at + n] + "A"])))
    needles += [(900, "NNN"), (901, "ANA"), (902, None)]
    hay.append((50, "GGANAGG"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, seq string")
    got = {tuple(r) for r in evaluate.holders(frame(needles), frame(hay)).collect()}
    assert got == {(i, j) for i, s in needles if s and s != "NNN" for j, h in hay if s in h or rc(s) in h}


def test_exons_over_windows_of_a_chromosome(spark):
    import random

    rng = random.Random(4)
    genome = {"c1": "".join(rng.choice("ACGT") for _ in range(95)), "c2": "".join(rng.choice("ACGT") for _ in range(30))}
    rows = []
    for i in range(60):
        c = rng.choice(["c1", "c2", "none"])
        exons = [(a, a + rng.randrange(0, 40)) for a in (rng.randrange(1, 90) for _ in range(rng.randrange(1, 4)))]
        rows.append((i, 1, c, exons))
    df = spark.createDataFrame(rows, "row long, side int, chr string, exons array<struct<start:int,end:int>>")
    got = {r["row"]: r["seq"] for r in splicing.spliced_from(df, spark.createDataFrame(list(genome.items()), "chr string, seq string"), 10).collect()}
    expected = {i: "".join(genome[c][a - 1 : b] for a, b in sorted(exons)) for i, _, c, exons in rows if c in genome}
    assert {i: got.get(i, "") for i in expected} == expected and not set(got) - set(expected)


def test_rows_are_numbered_through_all_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v")).repartition(7)
    assert all(r["v"] == r["i"] for r in splicing.placed(df, "v").collect())
