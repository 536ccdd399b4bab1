"""Scalar sequence functions as Spark columns, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: k-mers are cut from pieces of so many positions, since a substring walks its input from the start.
PIECE = 256


def complement(c: Column) -> Column:
    """Complement of each base; N and * stay, anything else becomes ``?``."""
    return F.translate(F.regexp_replace(c, "[^ACGTacgtN*]", "?"), "ACGTacgt", "TGCAtgca")


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def is_acgt(c: Column) -> Column:
    """Whether all letters are plain bases."""
    return c.rlike("^[ACGTacgt]+$")


def canonical(c: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(c, F.reverse(F.translate(c, "ACGT", "TGCA")))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Common characters that aren't letters a-z; a translation drops them faster than a pattern does.
_OTHERS = "".join(c for c in map(chr, (*range(1, 0x250), *range(0x2010, 0x2040))) if c not in _LETTERS)


def encode_text(text: Column) -> Column:
    """Letters a-z of a text, lower-cased, dealt to the four bases in turn."""
    bases = F.translate(F.lower(F.coalesce(text, F.lit(""))), _LETTERS + _OTHERS, ("ACGT" * 7)[:26])
    return F.regexp_replace(bases, "[^ACGT]+", "")


def explode_kmers(df: DataFrame, k: int, *keep: str, seq: str = "seq") -> DataFrame:
    """(keep..., pos, kmer): every k-mer of every sequence, positions from 0."""
    last = F.char_length(seq) - k
    pieces = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.floor(last / PIECE).cast("int")),
            lambda p: F.struct((p * PIECE).alias("at"), F.substring(F.col(seq), p * PIECE + 1, F.lit(PIECE + k - 1)).alias("part")),
        ),
    )
    inner = F.transform(
        F.sequence(F.lit(0), F.char_length("piece.part") - k),
        lambda i: F.struct((F.col("piece.at") + i).alias("pos"), F.substring(F.col("piece.part"), i + 1, F.lit(k)).alias("kmer")),
    )
    return df.select(*keep, F.explode(pieces).alias("piece")).select(*keep, F.explode(inner).alias("x")).select(*keep, "x.pos", "x.kmer")


def pack(kmer: Column) -> Column:
    """2-bit code (A, C, T, G = 0..3) of a k-mer of at most 31 bases, as a long."""
    return F.conv(F.translate(kmer, "ACTG", "0123"), 4, 10).cast("long")


def minimizer(kmer: Column, m: int) -> Column:
    """Smallest m-mer of a k-mer."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.char_length(kmer) - m + 1), lambda i: F.substring(kmer, i, F.lit(m))))


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost distance, the smaller over both strands of ``a``."""
    return F.least(F.levenshtein(a, b), F.levenshtein(reverse_complement(a), b))


def too_similar(a: Column, b: Column, threshold: Column) -> Column:
    """Distance over the longer length, strictly below the threshold."""
    return edit_distance(a, b) / F.greatest(F.char_length(a), F.char_length(b)) < threshold


def event_type(distance: Column, alternative: Column, k: int, share: float) -> Column:
    """SNP, MSNPs, REPEATS or AS, by distance and length of the alternative path."""
    length = F.char_length(alternative)
    return (
        F.when(distance <= 1, "SNP")
        .when(distance / length <= share, "MSNPs")
        .when(length <= 2 * k - 8, "REPEATS")
        .otherwise("AS")
    )


def best_anchors(df: DataFrame, seq: str, anchor: str, *keep: str) -> DataFrame:
    """Positions whose window is closest to the anchor.

    The last window isn't tried, as in the procedure that this follows.
    """
    n = F.char_length(anchor)
    spots = F.sequence(F.lit(0), F.char_length(seq) - n - 1)
    tried = F.transform(
        spots, lambda i: F.struct(F.levenshtein(F.substring(F.col(seq), i + 1, n), F.col(anchor)).alias("ed"), i.alias("pos"))
    )
    rows = df.where(F.char_length(seq) > n).select(*keep, tried.alias("t"))
    best = F.array_min(F.transform("t", lambda x: x["ed"]))
    return rows.select(*keep, best.alias("ed"), F.explode("t").alias("x")).where("x.ed = ed").select(*keep, "ed", "x.pos")


def anchored_distance(long: Column, short: Column, k: int) -> Column:
    """Distance of the short sequence to what lies between its best anchors in the long one, the smaller over both strands.

    Its first and last k - 1 bases are laid at every place of the long sequence where
    each fits best (the last window isn't tried); the least distance over all pairs of
    places with the start before the end counts. Null where there is none, or a
    sequence is too short.
    """
    n = k - 1
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def on(strand: Column) -> Column:
        def places(anchor: Column) -> Column:
            tried = F.transform(
                F.sequence(F.lit(0), F.char_length(strand) - n - 1), lambda i: F.struct(F.levenshtein(F.substring(strand, i + 1, F.lit(n)), anchor).alias("ed"), i.alias("pos"))
            )
            return once(tried, lambda t: once(F.array_min(F.transform(t, lambda x: x["ed"])), lambda m: F.transform(F.filter(t, lambda x: x["ed"] == m), lambda x: x["pos"])))

        span = lambda i, j: F.when(j + n > i, F.levenshtein(F.substring(strand, i + 1, j + n - i), short))
        pairs = once(places(F.right(short, F.lit(n))), lambda ends: F.array_min(F.transform(places(F.left(short, F.lit(n))), lambda i: F.array_min(F.transform(ends, lambda j: span(i, j))))))
        return F.when((F.char_length(strand) > n) & (F.char_length(short) >= n), pairs)

    return F.least(on(long), on(reverse_complement(long)))


def path_sequence(nodes: Column, k: int, context: bool = False) -> Column:
    """Sequence along a path of overlapping unitig sequences.

    Without context: the last k bases of the first node, the inner nodes from
    base k, and base k of the last one; with context the whole end nodes. A path
    of one node has no defined sequence and gives null.
    """
    first = F.element_at(nodes, 1)
    head = first if context else F.right(first, F.lit(k))
    last = F.element_at(nodes, -1)
    tail = F.substring(last, k, 1 << 30) if context else F.substring(last, k, 1)
    inner = F.array_join(F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 2, F.lit(0))), lambda s: F.substring(s, k, 1 << 30)), "")
    return F.when(F.size(nodes) >= 2, F.concat(head, inner, tail))


def linked_sequence(nodes: Column, labels: Column, k: int) -> Column:
    """As :func:`path_sequence`, with the label of each link before its end node."""
    parts = F.transform(nodes, lambda s, i: F.when(i == 0, F.right(s, F.lit(k))).otherwise(
        F.concat(F.coalesce(F.get(labels, i - 1), F.lit("")), F.when(i == F.size(nodes) - 1, F.substring(s, k, 1)).otherwise(F.substring(s, k, 1 << 30)))))
    return F.when(F.size(nodes) >= 2, F.array_join(parts, ""))


def node_names(nodes: Column) -> Column:
    """``id_strand`` of every node of a path, separated by spaces."""
    return F.array_join(F.transform(nodes, lambda n: F.concat_ws("_", n["unitig_id"].cast("string"), n["strand"])), " ")


def fill_header(template: str, **values: Column) -> Column:
    """A header with each ``[name]`` replaced by a column's value."""
    return reduce(lambda c, kv: F.replace(c, F.lit(f"[{kv[0]}]"), kv[1].cast("string")), values.items(), F.lit(template))


def first_occurrences(nodes: Column) -> Column:
    """A path with repeated vertices dropped, order kept."""
    return F.array_distinct(nodes)


def vertex_disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def contained_either_strand(a: Column, b: Column) -> Column:
    """Whether one holds the other, on either strand, or does but for one base at each end."""
    found = F.lit(False)
    for x, y in ((a, b), (b, a)):
        for s in (y, reverse_complement(y)):
            found = found | x.contains(s) | ((F.char_length(s) > 2) & x.contains(F.substring(s, 2, F.char_length(s) - 2)))
    return found
