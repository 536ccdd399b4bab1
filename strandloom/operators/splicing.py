"""Splice chains, exons and event sequences from annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.checkpoints import written

# The marks of the annotation format, and the form of a splice site.
STARTS = ("-", "(", "[")
ENDS = ("^", ")", "]")
SITE = r"(\d+)([\^\-\(\)\[\]]?)"


def splice_chain(text: Column) -> Column:
    """Array of (coord, kind) for tokens such as ``120^300-``.

    ``-``, ``(`` and ``[`` begin an exon; ``^``, ``)`` and ``]`` end one. A
    coordinate without a mark is dropped.
    """
    pattern = F.lit(SITE)
    coords, marks = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    sites = F.transform(
        coords,
        lambda c, i: F.struct(
            c.cast("int").alias("coord"),
            F.when(F.get(marks, i).isin(*STARTS), "start").when(F.get(marks, i).isin(*ENDS), "end").alias("kind"),
        ),
    )
    return F.filter(sites, lambda s: s["kind"].isNotNull())


def reversed_chain(chain: Column) -> Column:
    """The chain read on the minus strand: backwards, with starts and ends swapped."""
    return F.transform(
        F.reverse(chain), lambda s: F.struct(s["coord"].alias("coord"), F.when(s["kind"] == "start", "end").otherwise("start").alias("kind"))
    )


def spliced(exons: Column, chromosome: Column) -> Column:
    """Sequence of exons (start, end; 1-based, inclusive), in order of their starts."""
    ordered = F.array_sort(exons)
    return F.array_join(F.transform(ordered, lambda e: F.substring(chromosome, e["start"], e["end"] - e["start"] + 1)), "")


def trimmed_flanks(start: Column, end: Column, k: int, left: bool) -> Column:
    """The k bases of a flanking exon next to the event; null if it is shorter than k."""
    fits = end - start + 1 >= k
    pair = F.struct((end - k + 1).alias("start"), end.alias("end")) if left else F.struct(start.alias("start"), (start + k - 1).alias("end"))
    return F.when(fits, pair)


def neighbours(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """Adds the exons before and after each exon of a transcript."""
    order = Window.partitionBy(transcript).orderBy("start")
    exon = F.struct("start", "end")
    return exons.withColumns({"previous": F.lag(exon).over(order), "next": F.lead(exon).over(order)})


def exon_at(exons: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites (transcript_id, coord, kind) with the exon that begins or ends there."""
    begins, ends = exons.alias("e"), sites.alias("s")
    hit = F.when(F.col("s.kind") == "start", F.col("e.start")).otherwise(F.col("e.end")) == F.col("s.coord")
    return ends.join(begins, (F.col("s.transcript_id") == F.col("e.transcript_id")) & hit).select("s.*", "e.start", "e.end")


def event_pairs(events: DataFrame) -> DataFrame:
    """Both transcript lists of an event (``a,b`` and ``c``) as pairs, one row each."""
    one = events.withColumn("transcript_1", F.explode(F.split("transcripts_1", ",")))
    return one.withColumn("transcript_2", F.explode(F.split("transcripts_2", ","))).drop("transcripts_1", "transcripts_2")


def _variant(sites: Column, exons: Column) -> Column:
    """Struct (reason, flank exons and inner exons) of one variant.

    ``sites``: left flank, chain and right flank, as (coord, kind). The first and
    the last site name the flanking exons: the one that ends there, or the one
    before (after) the one that begins (ends) there. Between them, sites stand in
    pairs of a start and an end of one exon.
    """
    place = lambda s: F.array_position(F.transform(exons, lambda e: F.when(s["kind"] == "start", e["start"]).otherwise(e["end"]) == s["coord"]), True)
    places = F.transform(sites, place)  # from 1, or 0 where no exon has the site
    n = F.size(sites)
    left = F.try_element_at(places, F.lit(1)).cast("int") - F.when(F.try_element_at(sites, F.lit(1))["kind"] == "start", 1).otherwise(0)
    right = F.try_element_at(places, F.lit(-1)).cast("int") + F.when(F.try_element_at(sites, F.lit(-1))["kind"] == "end", 1).otherwise(0)
    opens = F.when(F.try_element_at(sites, F.lit(1))["kind"] == "end", 2).otherwise(1)
    closes = F.when(F.try_element_at(sites, F.lit(-1))["kind"] == "start", n - 1).otherwise(n)
    inner = F.slice(places, opens, F.greatest(closes - opens + 1, F.lit(0)))
    pairs = F.filter(inner, lambda _, i: i % 2 == 0)
    partners = F.filter(inner, lambda _, i: i % 2 == 1)
    reason = (
        F.when(exons.isNull() | F.exists(places, lambda p: p == 0), "no_site")
        .when((left < 1) | (right > F.size(exons)), "no_flank")
        .when(pairs != partners, "no_exon")
    )
    body = F.transform(pairs, lambda p: F.get(exons, p.cast("int") - 1))
    return F.struct(reason.alias("reason"), F.get(exons, left - 1).alias("left"), body.alias("inner"), F.get(exons, right - 1).alias("right"))


def event_bubbles(events: DataFrame, exons: DataFrame, genome: DataFrame, k: int) -> DataFrame:
    """Events as pairs of sequences, or the reason why an event gives none.

    ``events``: as from ``read_events``, with ids; ``exons``: (transcript_id,
    gene_name, exons); ``genome``: (chr, seq). Every pair of transcripts of both
    variants is tried; chains of the minus strand are read backwards. Returns
    event_id, transcript_1, transcript_2, gene_1, gene_2, seq_1, seq_2, reason.
    """
    minus = F.col("strand") == "-"
    flank = F.split("flanks", ",")
    one = lambda c: splice_chain(F.coalesce(c, F.lit("")))
    facing = lambda c: F.when(minus, reversed_chain(one(c))).otherwise(one(c))
    a, b = F.get(flank, F.lit(0)), F.get(flank, F.lit(1))
    left = F.when(minus, reversed_chain(one(b))).otherwise(one(a))
    right = F.when(minus, reversed_chain(one(a))).otherwise(one(b))
    rows = events.withColumns({"sites_1": F.concat(left, facing(F.col("chain_1")), right), "sites_2": F.concat(left, facing(F.col("chain_2")), right)})
    rows = rows.withColumns({"transcripts_1": F.replace("transcripts_1", F.lit("/"), F.lit(",")), "transcripts_2": F.replace("transcripts_2", F.lit("/"), F.lit(","))})
    pairs = event_pairs(rows)
    for i in ("1", "2"):
        own = exons.select(F.col("transcript_id").alias(f"transcript_{i}"), F.col("gene_name").alias(f"gene_{i}"), F.col("exons").alias(f"exons_{i}"))
        pairs = pairs.join(own, f"transcript_{i}", "left").withColumn(f"v{i}", _variant(F.col(f"sites_{i}"), F.col(f"exons_{i}")))
    length = lambda e: F.col(f"{e}.end") - F.col(f"{e}.start") + 1
    short = (F.least(length("v1.left"), length("v1.right"), length("v2.left"), length("v2.right")) < k).alias("short")
    trim = lambda v: (trimmed_flanks(F.col(f"{v}.left.start"), F.col(f"{v}.left.end"), k, True), trimmed_flanks(F.col(f"{v}.right.start"), F.col(f"{v}.right.end"), k, False))
    (l1, r1), (l2, r2) = trim("v1"), trim("v2")
    reason = F.coalesce(F.col("v1.reason"), F.col("v2.reason"), F.when(short, "short_flank"), F.when((l1 != l2) | (r1 != r2), "flank_mismatch"))
    whole = lambda v, left, right: F.when(F.col("reason").isNull(), F.concat(F.array(left), F.col(f"{v}.inner"), F.array(right)))
    judged = pairs.withColumn("reason", reason).withColumns({"x_row": F.monotonically_increasing_id(), "x_1": whole("v1", l1, r1), "x_2": whole("v2", l2, r2)})
    judged = written(judged.select("event_id", "transcript_1", "transcript_2", "gene_1", "gene_2", "reason", "chr", "x_row", "x_1", "x_2"), "events")
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"x_{n}").alias("exons")) for n in (1, 2)))).alias("x")
    seqs = spliced_from(judged.where("reason IS NULL").select(F.col("x_row").alias("row"), "chr", sides).select("row", "x.side", "chr", "x.exons"), genome)
    pick = lambda n: F.max(F.when(F.col("side") == n, F.col("seq"))).alias(f"seq_{n}")
    out = judged.join(seqs.groupBy("row").agg(pick(1), pick(2)), judged.x_row == F.col("row"), "left")
    return out.select("event_id", "transcript_1", "transcript_2", "gene_1", "gene_2", "seq_1", "seq_2", "reason")


#: Bases of a window of a chromosome.
WINDOW = 10_000


def windows_of(genome: DataFrame, width: int = WINDOW) -> DataFrame:
    """(chr, window, piece): chromosomes (chr, seq) in pieces, which a join moves in place of whole ones."""
    return genome.select("chr", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("window", "piece"))


def spliced_from(rows: DataFrame, genome: DataFrame, width: int = WINDOW) -> DataFrame:
    """(row, side, seq): as :func:`spliced` for (row, side, chr, exons), from the windows that the exons touch."""
    exons = rows.select("row", "side", "chr", F.posexplode(F.array_sort("exons")).alias("i", "e")).select("row", "side", "chr", "i", "e.start", "e.end").where("end >= start")
    dealt = exons.withColumn("window", F.explode(F.sequence(F.floor((F.col("start") - 1) / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int"))))
    begin = F.col("window") * width  # bases before the window
    first = F.greatest(F.col("start") - begin, F.lit(1)).cast("int")
    cut = F.substring("piece", first, (F.least(F.col("end") - begin, F.lit(width)) - first + 1).cast("int"))
    parts = dealt.join(windows_of(genome, width), ["chr", "window"]).select("row", "side", F.struct("i", "window", cut.alias("s")).alias("p"))
    return parts.groupBy("row", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))


def rejection_counts(bubbles: DataFrame) -> DataFrame:
    """(reason, events): why events gave no bubble, and how many gave one."""
    return bubbles.groupBy(F.coalesce("reason", F.lit("successful")).alias("reason")).agg(F.count("*").alias("events"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``i``, their number from 0 in the given order.

    Ranges are numbered by themselves and shifted by the sizes of those before them.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("x_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("x_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    within = F.row_number().over(Window.partitionBy("x_part").orderBy(*order)) - 1
    return ranged.withColumn("x_within", within).join(sizes.select("x_part", before.alias("x_before")), "x_part").withColumn("i", F.col("x_before") + F.col("x_within")).drop("x_part", "x_within", "x_before")


def write_events(bubbles: DataFrame, path: str) -> None:
    """Events that gave sequences, as two FASTA records each, in the order of the events; part after part."""
    kept = placed(bubbles.where("reason IS NULL"), "event_id", "transcript_1", "transcript_2")
    record = lambda n: F.concat(F.format_string(f">Bubble_%d_Gene_%s_TranscriptId_%s_Splicing_{n}\n", "i", f"gene_{n}", f"transcript_{n}"), f"seq_{n}")
    kept.orderBy("i").select(F.concat_ws("\n", record(1), record(2))).write.mode("overwrite").text(path)


def rejection(flank_match: Column, left_length: Column, right_length: Column, exon_length: Column, k: int) -> Column:
    """Why an event can't be turned into a bubble, or null if it can."""
    return (
        F.when(left_length.isNull() | right_length.isNull(), "no_flank")
        .when(~flank_match, "flank_mismatch")
        .when((left_length < k) | (right_length < k), "short_flank")
        .when(exon_length.isNull(), "no_exon")
    )


def overlapping(intervals: DataFrame, width: int) -> DataFrame:
    """(a, b): pairs of (id, start, end) that overlap, a < b.

    Intervals are dealt to bins of ``width`` that they touch; a pair is reported
    by the bin where the later of both starts lies, so once only.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    dealt = intervals.select("id", "start", "end", bins.alias("bin"))
    a, b = dealt.alias("a"), dealt.alias("b")
    touch = (F.col("a.bin") == F.col("b.bin")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    return a.join(b, touch).where(F.floor(F.greatest("a.start", "b.start") / width) == F.col("a.bin")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
