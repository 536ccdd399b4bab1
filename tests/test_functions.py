"""Scalar sequence functions and alignment scores."""

import random

from pyspark.sql import functions as F

from strandloom.functions import alignment
from strandloom.functions import sequence as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_complement_and_reverse(spark):
    assert one(spark, S.complement(F.col("s")), s="ACGTacgtN*K") == "TGCAtgcaN*?"
    assert one(spark, S.reverse_complement(S.reverse_complement(F.col("s"))), s="ACCGTN") == "ACCGTN"
    assert one(spark, S.canonical(F.col("s")), s="TTT") == "AAA"
    assert one(spark, S.is_acgt(F.col("s")), s="ACGN") is False


def test_kmers_cross_pieces(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 4, 5, 255, 256, 257, 261, 700)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    got = sorted((r.id, r.pos, r.kmer) for r in S.explode_kmers(df, 5, "id").collect())
    assert got == sorted((i, p, s[p : p + 5]) for i, s in enumerate(seqs) for p in range(len(s) - 4))


def test_pack_orders_bases(spark):
    assert one(spark, S.pack(F.col("s")), s="ACTG") == 0 * 64 + 1 * 16 + 2 * 4 + 3
    assert one(spark, S.pack(F.col("s")), s="G" * 31) == 4**31 - 1


def test_event_type(spark):
    kind = lambda ed, n: one(spark, S.event_type(F.col("d"), F.col("a"), 31, 0.2), d=ed, a="A" * n)
    assert [kind(1, 100), kind(20, 100), kind(40, 54), kind(40, 100)] == ["SNP", "MSNPs", "REPEATS", "AS"]


def test_path_sequences(spark):
    df = spark.createDataFrame([(["AACCG", "CCGTT", "GTTAC"], ["", "GG"]), (["AACCG"], [])], "n array<string>, l array<string>")
    rows = df.select(S.path_sequence(F.col("n"), 3).alias("p"), S.path_sequence(F.col("n"), 3, True).alias("c"), S.linked_sequence(F.col("n"), F.col("l"), 3).alias("l")).collect()
    assert (rows[0].p, rows[0].c, rows[0].l) == ("CCG" + "GTT" + "T", "AACCG" + "GTT" + "TAC", "CCG" + "GTT" + "GG" + "T")
    assert rows[1].p is None and rows[1].l is None


def test_header_and_containment(spark):
    assert one(spark, S.fill_header(">b_[id] len=[n]", id=F.lit(3), n=F.lit(7))) == ">b_3 len=7"
    assert one(spark, S.contained_either_strand(F.col("a"), F.col("b")), a="ACGGTT", b="AACC") is True
    assert one(spark, S.contained_either_strand(F.col("a"), F.col("b")), a="ACGGTT", b="TATAT") is False


def test_best_anchors_skip_the_last_window(spark):
    df = spark.createDataFrame([(1, "ACGTTTACG", "ACG"), (2, "AC", "ACG")], "id long, s string, a string")
    assert [(r.id, r.ed, r.pos) for r in S.best_anchors(df, "s", "a", "id").collect()] == [(1, 0, 0)]


def brute_semi_global(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_semi_global_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert alignment.semi_global(a, b) == brute_semi_global(a, b), (a, b)
    assert alignment.semi_global_both("AACC", "TTGGTTAA") == 0
    assert alignment.ungapped_score("ACGT", "TTACGA") == 6


def test_alignment_columns_and_nulls(spark):
    alignment.register(spark)
    df = spark.createDataFrame([("ACGT", "TTACGTTT"), (None, "A")], "a string, b string")
    assert [r.x for r in df.select(alignment.semi_global_distance("a", "b").alias("x")).collect()] == [0, None]
    assert spark.sql("SELECT ungapped_local_score('ACG', 'ACG') AS x").first().x == 6


def plain_anchored(long, short, k):
    n, found = k - 1, []
    for s in (long, long[::-1].translate(str.maketrans("ACGT", "TGCA"))):
        if len(s) <= n or len(short) < n:
            continue
        tried = range(len(s) - n)
        fit = lambda anchor: [alignment.edit_distance(s[i : i + n], anchor) for i in tried]
        first, last = fit(short[:n]), fit(short[len(short) - n :])
        found += [alignment.edit_distance(s[i : j + n], short) for i in tried for j in tried if first[i] == min(first) and last[j] == min(last) and j + n > i]
    return min(found, default=None)


def test_anchored_distance(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14)))) for _ in range(120)]
    pairs += [("ACGTACGTTTGCA", "ACGTTGCA"), ("TTTT", None), (None, "ACGTA")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    got = {r.id: r.d for r in df.select("id", S.anchored_distance(F.col("a"), F.col("b"), 5).alias("d")).collect()}
    assert got == {i: plain_anchored(a, b, 5) if a is not None and b is not None else None for i, (a, b) in enumerate(pairs)}
