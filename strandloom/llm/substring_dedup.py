"""Repeated word spans by compaction of a de Bruijn graph.

Every window of :data:`WINDOW` words is an edge of the graph, between the nodes
made of its first and its last 12 words. A window is repeated if an equal edge
starts in a document with a smaller id.

1. Each document's walk is cut into short paths: runs of windows that share
   their minimizer, the smallest hash among the 5-word pieces of a window. Equal
   windows have equal minimizers, so an edge can only repeat inside the group of
   its minimizer, and a group is some hundred bytes where its windows would be
   several times that.
2. Paths are dealt by minimizer. Equal paths are compacted to one: the place of
   its source with the smallest id is known, and every other place has all its
   windows repeated. Where a group has one path only, it doesn't branch and is done.
3. Where paths of a group differ, they branch or end at different places. The
   coordinates of each path's smallest source lead back to its text, the edges
   are taken apart and each is joined with its smallest source.
4. Paths that follow one another without branching, in the document and at the
   source alike, are compacted to one long span.
5. Each long span's source coordinates lead back to the words there. Only where
   their 128-bit digest is that of the span's own words does the span count, so a
   removal never rests on the 64-bit hashes of windows and paths.
6. The words under the verified spans are removed.

Inside a batch, equal paths that occur often are packed into one row before the
shuffle, so a passage that a third of all documents share costs a row for each
batch. Each step that needs texts shuffles them; a step's shuffle files go when
its table is written, so the disk never holds those of two steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialise, no_null, release, small, table
from strandloom.llm.textbytes import blocks, mix64, run_hashes, space_words, word_hashes

WINDOW = 13
PIECE = 5
#: Equal paths of a batch are packed into one row from this number on.
PACK = 8
#: Rows meant for each partition of the texts.
PARTITION_ROWS = 8192
#: Tables of up to so many spans (some 50 bytes each) are broadcast.
BROADCAST_SPANS = 300_000

# A place in a document: 28 bits of the text's hash (tells rows with the same id
# apart), 31 bits for the first window and 4 for the number of windows.
_HASH_BITS = 28
_START_BITS = 31
_MAX = np.int64(np.iinfo(np.int64).max)


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """(window hash, minimizer, path bounds, row of each path, first window of each path in its row).

    Windows of all rows lie end to end; a path is a run of windows of one row
    that share the place of their minimizer.
    """
    starts, ends, first = space_words(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.maximum(n - WINDOW + 1, 0)
    total = int(count.sum())
    row = np.repeat(np.arange(len(n)), count)
    base = np.concatenate([[0], np.cumsum(count)])
    in_row = np.arange(total) - base[row]
    at = first[:-1][row] + in_row
    if not total:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(1, np.int64), row, in_row, n
    edge = run_hashes(words, WINDOW)[at]
    piece = run_hashes(words, PIECE)
    best, place = piece[at], np.zeros(total, np.int64)
    for j in range(1, WINDOW - PIECE + 1):
        other = piece[at + j]
        less = other < best
        best = np.where(less, other, best)
        place[less] = j
    place += at
    fresh = np.ones(total, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    cuts = np.flatnonzero(fresh)
    bounds = np.append(cuts, total)
    return edge, best, bounds, row[cuts], in_row[cuts], n


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimizer, path, doc, place, more) of every path; ``more`` packs the
    (doc, place) pairs of further equal paths, with larger or equal ids."""
    for batch in batches:
        parts = []
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, _, data, offsets in blocks(batch.column(2)):
            edge, best, bounds, row, start, _ = windows_of(data, offsets)
            if not len(row):
                continue
            a, size = bounds[:-1], np.diff(bounds)
            path = mix64(edge[a] + mix64(edge[bounds[1:] - 1] + size.astype(np.uint64)))
            place = hashes[lo + row] << (_START_BITS + 4) | start << 4 | size
            parts.append((best[a], path, ids[lo + row], place))
        if not parts:
            continue
        best, path, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, path, best))
        best, path, doc, place = best[order], path[order], doc[order], place[order]
        fresh = np.ones(len(best), bool)
        fresh[1:] = (best[1:] != best[:-1]) | (path[1:] != path[:-1])
        cuts = np.append(np.flatnonzero(fresh), len(best))
        often = np.flatnonzero(np.diff(cuts) >= PACK)
        stays = np.ones(len(best), bool)
        more = np.full(len(best), None, object)
        for i in often.tolist():
            x, y = int(cuts[i]), int(cuts[i + 1])
            stays[x + 1 : y] = False
            more[x] = np.concatenate([doc[x + 1 : y], place[x + 1 : y]]).tobytes()
        keep = np.flatnonzero(stays)
        columns = [best[keep].view(np.int64), path[keep].view(np.int64), doc[keep], place[keep]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more[keep], pa.binary())], ["best", "path", "doc", "place", "more"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, doc, place, s_doc, s_place) of paths: kind 0 has all its windows repeated,
    since the equal path at the source (s_doc, s_place) has a smaller id; kind 1 is
    the first of its kind in a group of different paths."""
    for batch in batches:
        straight, s_doc, s_place, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        more = batch.column(5)
        parts = [(straight, s_doc, s_place, doc, place)]
        for i in np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False)).tolist():
            both = np.frombuffer(more[i].as_buffer(), np.int64).reshape(2, -1)
            n = both.shape[1]
            parts.append((np.full(n, straight[i]), np.full(n, s_doc[i]), np.full(n, s_place[i]), both[0], both[1]))
        straight, s_doc, s_place, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        kind = np.where(doc > s_doc, 0, 1).astype(np.int32)
        good = (kind == 0) | ~straight
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (kind, doc, place, s_doc, s_place)], ["kind", "doc", "place", "s_doc", "s_place"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(edge, best, doc, place) of every window of the branching paths."""
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, data, offsets in blocks(batch.column(2)):
            edge, best, _, _, _, n = windows_of(data, offsets)
            base = np.concatenate([[0], np.cumsum(np.maximum(n - WINDOW + 1, 0))])
            for i in range(hi - lo):
                spans = batch.column(3)[lo + i].values.to_numpy()
                size = spans & 15
                start = spans >> 4 & (1 << _START_BITS) - 1
                at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                own = base[i] + at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edge[own].view(np.int64)),
                        pa.array(best[own].view(np.int64)),
                        pa.array(np.full(len(at), ids[lo + i])),
                        pa.array(hashes[lo + i] << (_START_BITS + 4) | at << 4 | 1),
                    ],
                    ["edge", "best", "doc", "place"],
                )


def _words_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words end to end with one space after each, and where each begins."""
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size)
    out = data[np.minimum(at, max(0, len(data) - 1))]
    out[begin[1:] - 1] = 0x20
    return out.tobytes(), begin


def _digest(text: bytes, begin: np.ndarray, word: int, n: int) -> bytes:
    """Digest of the words under ``n`` windows from a word on."""
    return hashlib.blake2b(text[begin[word] : begin[word + n + WINDOW - 1] - 1], digest_size=16).digest()


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s_doc, s_low, span, digest) of every wanted span of the sources."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(2)):
            starts, ends, first = space_words(data, offsets)
            text, begin = _words_apart(data, starts, ends)
            rows, spans, digests = [], [], []
            for i in range(hi - lo):
                for span in batch.column(3)[lo + i].values.to_pylist():
                    start, n = span >> _START_BITS, span & (1 << _START_BITS) - 1
                    if start + n + WINDOW - 1 <= first[i + 1] - first[i]:
                        rows.append(lo + i)
                        spans.append(span)
                        digests.append(_digest(text, begin, int(first[i]) + start, n))
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(spans, pa.int64()), pa.array(digests, pa.binary())], ["s_doc", "s_low", "span", "digest"])


def _covered(spans: pa.Array, first: np.ndarray, text: bytes, begin: np.ndarray) -> np.ndarray:
    """Words under those spans of the rows whose words are the source's."""
    words = len(begin) - 1
    edge = np.zeros(words + 1, np.int64)
    for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
        for s in spans[i].as_py():
            start, n = s["span"] >> _START_BITS, s["span"] & (1 << _START_BITS) - 1
            at = int(first[i]) + start
            if at + n + WINDOW - 1 <= first[i + 1] and _digest(text, begin, at, n) == s["digest"]:
                edge[at] += 1
                edge[at + n + WINDOW - 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def _stripped(column: pa.Array, spans: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(first row, words, removed words, kept text bytes, their bounds) of blocks."""
    for lo, hi, data, offsets in blocks(column):
        starts, ends, first = space_words(data, offsets)
        text, begin = _words_apart(data, starts, ends)
        gone = _covered(spans[lo:hi], first, text, begin)
        kept = np.flatnonzero(~gone)
        size = np.diff(begin)[kept]
        # Kept words with a space behind each; the last one of a row loses it.
        out = np.frombuffer(text, np.uint8)[np.arange(int(size.sum())) + np.repeat(begin[kept] - np.concatenate([[0], np.cumsum(size)])[:-1], size)]
        number = np.searchsorted(kept, first)
        cuts = np.concatenate([[0], np.cumsum(size)])[number]
        removed = np.concatenate([[0], np.cumsum(gone)])
        yield lo, np.diff(first), removed[first[1:]] - removed[first[:-1]], out.tobytes(), cuts


def _kept(text: bytes, cuts: np.ndarray) -> Iterator[bytes]:
    """Each row's kept text."""
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield text[a : max(a, b - 1)]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, words, removed, text, cuts in _stripped(batch.column(1), batch.column(2)):
            sums = [hashlib.sha256(t).hexdigest() for t in _kept(text, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo : lo + len(words)], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, words, removed, text, cuts in _stripped(batch.column(1), batch.column(2)):
            kept = [t.decode() for t in _kept(text, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo : lo + len(words)], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text, spans): each row with the places of its repeated windows."""
    body = no_null(text)
    low_bits = F.xxhash64(body).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
    # Not null: an id that is missing never removes or loses anything, and takes no part until the end.
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), low_bits.alias("low"), body.alias("text")
    )
    rows = slim.where("doc_id IS NOT NULL").select("doc", "low", "text")
    paths = rows.mapInArrow(_paths, "best long, path long, doc long, place long, more binary")
    group, equal = Window.partitionBy("best"), Window.partitionBy("best", "path")
    many = (F.max("doc").over(group) > F.min("doc").over(group)) | (F.count("more").over(group) > 0)
    repeated = (
        paths.withColumn("source", F.min(F.struct("doc", "place")).over(equal))
        .withColumns({"straight": F.min("path").over(group) == F.max("path").over(group), "many": many})
        .where("many")
        .select("straight", "source.doc", "source.place", F.col("doc").alias("own"), F.col("place").alias("own_place"), "more")
        .mapInArrow(_unpacked, "kind int, doc long, place long, s_doc long, s_place long")
    )
    repeated = materialise(repeated, "repeated", tidy=True)
    low_of = lambda c: F.shiftright(c, _START_BITS + 4)

    parts = max(1, -(-docs.count() // PARTITION_ROWS))
    dealt = slim.repartition(parts, "doc", "low")
    first_kind = repeated.where("kind = 1").select(F.col("doc").alias("s_doc"), low_of("place").alias("s_low"), "place")
    first_kind = first_kind.groupBy("s_doc", "s_low").agg(F.collect_list("place").alias("spans"))
    same = (F.col("doc") == F.col("s_doc")) & (F.col("low") == F.col("s_low")) & F.col("doc_id").isNotNull()
    edges = dealt.join(first_kind, same).select("doc", "low", "text", "spans").mapInArrow(_edges, "edge long, best long, doc long, place long")
    first = edges.groupBy("edge", "best").agg(F.min(F.struct("doc", "place")).alias("source"), F.max("doc").alias("last")).where("source.doc < last")
    later = edges.join(first, ["edge", "best"]).where("doc > source.doc").select("doc", "place", F.col("source.doc").alias("s_doc"), F.col("source.place").alias("s_place"))
    long_spans = materialise(_compacted(repeated.where("kind = 0").drop("kind").unionByName(later)), "spans", tidy=True)
    release(repeated)

    span = lambda start: (F.shiftleft(start, _START_BITS) + F.col("n")).alias("span")
    wanted = long_spans.select("s_doc", "s_low", span(F.col("s_start"))).distinct().groupBy("s_doc", "s_low").agg(F.collect_list("span").alias("spans"))
    digests = dealt.join(wanted, same).select("doc", "low", "text", "spans").mapInArrow(_source_digests, "s_doc long, s_low long, span long, digest binary")
    digests = small(materialise(digests.dropDuplicates(["s_doc", "s_low", "span"]), "digests", tidy=True), BROADCAST_SPANS)
    told = long_spans.select("doc", "low", F.struct(span(F.col("start"))).alias("own"), "s_doc", "s_low", span(F.col("s_start"))).join(digests, ["s_doc", "s_low", "span"])
    found = told.groupBy(F.col("doc").alias("s_doc"), F.col("low").alias("s_low")).agg(F.collect_list(F.struct("own.span", "digest")).alias("spans"))
    return dealt.join(found, same, "left").select("doc_id", "text", "spans")


def _compacted(spans: DataFrame) -> DataFrame:
    """(doc, low, start, n, s_doc, s_low, s_start): spans of ``n`` windows, as long as they go on.

    A span goes on where the next one of the document begins behind it and has its
    source behind the span's source.
    """
    part = lambda c: F.shiftright(c, 4).bitwiseAND(F.lit((1 << _START_BITS) - 1))
    low = lambda c: F.shiftright(c, _START_BITS + 4)
    rows = spans.dropDuplicates(["doc", "place"]).select(
        "doc", low("place").alias("low"), part("place").alias("start"), F.col("place").bitwiseAND(F.lit(15)).alias("n"), "s_doc", low("s_place").alias("s_low"), part("s_place").alias("s_start")
    )
    order = Window.partitionBy("doc", "low").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    goes_on = (
        (before("s_doc") == F.col("s_doc")) & (before("s_low") == F.col("s_low"))
        & (before("start") + before("n") == F.col("start")) & (before("s_start") + before("n") == F.col("s_start"))
    )
    numbered = rows.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    return numbered.groupBy("doc", "low", "island", "s_doc", "s_low").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("s_start").alias("s_start")).drop("island")


def strip(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row.

    Null and empty texts have no words; a text of fewer than 13 words loses
    none. Rows that share an id never remove each other's words; a row without
    id neither removes nor loses any. Other columns are ignored.
    """
    return _with_spans(docs, text).mapInArrow(_texts, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """As :func:`strip`, with the SHA-256 of the kept text in its place."""
    return _with_spans(docs, text).mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 13-word windows, removed from every document."""
    return digest(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (
  SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (h) WHERE doc_id > m),
r AS (SELECT rid, list(p) AS gone FROM g GROUP BY rid),
a AS (
  SELECT doc_id, ws, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(gone, k)) END AS kept
  FROM d LEFT JOIN r USING (rid))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM a
"""
