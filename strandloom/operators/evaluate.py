"""Scoring of found bubbles against a truth set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandloom.functions import packed
from strandloom.functions.alignment import ungapped_local_score, ungapped_matches
from strandloom.functions.sequence import canonical, contained_either_strand, explode_kmers, reverse_complement
from strandloom.plans.checkpoints import written


def bubble_key(a: Column, b: Column) -> Column:
    """Equal for bubbles that differ in the order of paths or in strand only."""
    ra, rb = reverse_complement(a), reverse_complement(b)
    return F.least(F.concat_ws("/", a, b), F.concat_ws("/", b, a), F.concat_ws("/", ra, rb), F.concat_ws("/", rb, ra))


def distinct_bubbles(bubbles: DataFrame) -> DataFrame:
    """Bubbles (a, b, ...) without repetitions up to order and strand."""
    return bubbles.withColumn("x_key", bubble_key(F.col("a"), F.col("b"))).dropDuplicates(["x_key"]).drop("x_key")


def shared_kmer_pairs(left: DataFrame, right: DataFrame, k: int = 31, least: int = 10) -> DataFrame:
    """(x, y, shared): rows (id, seq) of both sides with enough common canonical k-mers."""

    def kmers(df: DataFrame, name: str) -> DataFrame:
        if k <= packed.LONGEST and isinstance(df.schema["id"].dataType, LongType):
            return packed.sets(df, k, "id").withColumnRenamed("id", name)
        return explode_kmers(df, k, "id").select(F.col("id").alias(name), canonical(F.col("kmer")).alias("kmer")).distinct()

    met = kmers(left, "x").join(kmers(right, "y"), "kmer").groupBy("x", "y").agg(F.count("*").alias("shared"))
    return met.where(F.col("shared") >= least)


#: Lengths of the k-mers by which needles are looked up; shorter needles are looked up whole.
SIZES = (31, 16, 8)


def holders(needles: DataFrame, hay: DataFrame, k: int = 31) -> DataFrame:
    """(id, holder): rows (id, seq) of ``needles`` that a row (id, seq) of ``hay`` holds, on either strand.

    Each needle is looked up by a k-mer of its own length class, so a short one
    changes nothing for the others, and by its rarest one: the one that the fewest
    rows of ``hay`` have. Candidates are compared in full. The class follows the longest
    stretch of plain bases; a needle without any isn't found. Ids are longs.
    """
    plain = F.array_max(F.transform(F.regexp_extract_all("seq", F.lit("[ACGT]+"), F.lit(0)), lambda s: F.char_length(s)))
    size = F.col("plain")
    for n in sorted(x for x in SIZES if x <= k):
        size = F.when(F.col("plain") >= n, n).otherwise(size)
    classed = needles.select("id", "seq", plain.alias("plain")).where("plain > 0").select("id", "seq", size.alias("size"))
    out = needles.select("id", F.col("id").alias("holder")).where("false")
    for n in sorted(r["size"] for r in classed.select("size").distinct().collect()):  # ten classes at most
        own = packed.sets(classed.where(F.col("size") == n), n, "id")
        held = packed.sets(hay, n, "id").withColumnRenamed("id", "holder").join(own.select("kmer").distinct(), "kmer", "left_semi")
        held = written(held, "held")
        counts = held.groupBy("kmer").agg(F.count("*").alias("n"))
        # A needle with a k-mer that no row has is held by none.
        known = own.join(counts, "kmer", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kmer")).alias("x")).where("x.n > 0")
        out = out.unionByName(known.select("id", "x.kmer").join(held, "kmer").select("id", "holder"))
    both = out.join(needles.select("id", "seq"), "id").join(hay.select(F.col("id").alias("holder"), F.col("seq").alias("hay")), "holder")
    return both.where(F.col("hay").contains(F.col("seq")) | F.col("hay").contains(reverse_complement(F.col("seq")))).select("id", "holder").distinct()


def matches(truth: DataFrame, found: DataFrame, k: int = 31, least: int = 10) -> DataFrame:
    """(truth_id, found_id): bubbles (id, a, b) whose paths contain one another.

    A bubble of the truth without any such partner gets the one with the best
    ungapped score, the smallest id among equals. Only pairs that share k-mers are
    compared, ``least`` of them for a score.
    """
    a = truth.select(F.col("id").alias("id"), F.concat_ws("N", "a", "b").alias("seq"))
    b = found.select(F.col("id").alias("id"), F.concat_ws("N", "a", "b").alias("seq"))
    t = truth.select(F.col("id").alias("x"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    f = found.select(F.col("id").alias("y"), F.col("a").alias("fa"), F.col("b").alias("fb"))
    both = shared_kmer_pairs(a, b, k, 1).join(t, "x").join(f, "y")
    same = lambda p, q: contained_either_strand(F.col(p), F.col(q))
    fits = (same("ta", "fa") & same("tb", "fb")) | (same("ta", "fb") & same("tb", "fa"))
    exact = both.where(fits).select(F.col("x").alias("truth_id"), F.col("y").alias("found_id"))
    rest = both.where(F.col("shared") >= least).join(exact, F.col("x") == F.col("truth_id"), "left_anti")
    rc = lambda c: reverse_complement(F.col(c))
    sums = [ungapped_local_score(p, F.col("fa")) + ungapped_local_score(q, F.col("fb")) for p, q in ((F.col("ta"), F.col("tb")), (F.col("tb"), F.col("ta")), (rc("ta"), rc("tb")), (rc("tb"), rc("ta")))]
    scored = rest.select("x", "y", F.greatest(*sums).alias("score")).where("score > 0")
    best = scored.groupBy("x").agg(F.max_by("y", F.struct("score", -F.col("y"))).alias("found_id")).select(F.col("x").alias("truth_id"), "found_id")
    return exact.unionByName(best)


def expressed_transcripts(reads: DataFrame, mark: str = "_") -> DataFrame:
    """(transcript_id): distinct beginnings of read headers, up to the first mark."""
    return reads.select(F.substring_index("header", mark, 1).alias("transcript_id")).distinct()


def truth_filter(bubbles: DataFrame, shallow: DataFrame, expressed: DataFrame, k: int = 31) -> DataFrame:
    """Bubbles (id, a, b, a_transcript, b_transcript) with one path in the shallow set and
    the other not, both of expressed transcripts.

    ``shallow``: (id, seq); ``expressed``: (transcript_id).
    """
    out = bubbles
    for side in ("a", "b"):
        held = holders(bubbles.select("id", F.col(side).alias("seq")), shallow, k).select("id").distinct()
        out = out.join(held.withColumn(f"x_{side}", F.lit(True)), "id", "left")
        out = out.join(expressed.select(F.col("transcript_id").alias(f"{side}_transcript")).distinct(), f"{side}_transcript", "left_semi")
    known = [F.coalesce(F.col(f"x_{side}"), F.lit(False)) for side in ("a", "b")]
    return out.where(known[0] != known[1]).select(*bubbles.columns)


def same_gene(novel: DataFrame, transcripts: DataFrame, least: float = 0.95) -> DataFrame:
    """(id): novel paths (id, gene, seq) that a transcript (gene, seq) of their gene holds,
    or matches without gaps in at least that share of bases, on either strand."""
    met = novel.join(transcripts.select("gene", F.col("seq").alias("hay")), "gene")
    turned = reverse_complement(F.col("seq"))
    held = F.col("hay").contains(F.col("seq")) | F.col("hay").contains(turned)
    alike = F.greatest(ungapped_matches(F.col("seq"), F.col("hay")), ungapped_matches(turned, F.col("hay")))
    return met.where(held | (alike >= least * F.char_length("seq"))).select("id").distinct()


def classified(found: DataFrame, matched: DataFrame, transcripts: DataFrame, shallow: DataFrame, k: int = 31) -> DataFrame:
    """Found bubbles (id, gene, novel) with their class.

    ``matched``: (found_id); ``transcripts``: (id, gene, seq) of all genes;
    ``shallow``: (id), those of them that the search knew.
    """
    novel = found.select("id", "gene", F.col("novel").alias("seq"))
    others = transcripts.join(shallow.select("id"), "id", "left_anti")
    flags = found
    for name, ids in (
        ("matched", matched.select(F.col("found_id").alias("id"))), ("same_gene", same_gene(novel, others)),
        ("chimeric", holders(novel.select("id", "seq"), transcripts.select("id", "seq"), k).select("id")),
    ):
        flags = flags.join(ids.distinct().withColumn(name, F.lit(True)), "id", "left").fillna(False, [name])
    return triage(flags)


def triage(found: DataFrame) -> DataFrame:
    """Adds the class of each found bubble, first reason first.

    Needs the booleans matched, same_gene and chimeric.
    """
    return found.withColumn(
        "class", F.when(F.col("matched"), "matched").when(F.col("same_gene"), "same_gene").when(F.col("chimeric"), "chimeric").otherwise("unexplained")
    )


def precision_recall(truth: DataFrame, classed: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: truth, found, recall and precision ("same gene" counts as right)."""
    hit = matched.select("truth_id").distinct().agg(F.count("*").alias("hit"))
    total = truth.agg(F.count("*").alias("truth"))
    right = classed.agg(F.count("*").alias("found"), F.count(F.when(F.col("class").isin("matched", "same_gene"), 1)).alias("right"))
    one = total.join(hit).join(right)  # three tables of one row
    return one.select("truth", "found", (F.col("hit") / F.col("truth")).alias("recall"), (F.col("right") / F.col("found")).alias("precision"))
