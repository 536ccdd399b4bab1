"""Near-duplicate groups by MinHash with tensored banding.

Two collections of :data:`COLLECTION` partial keys, each made of :data:`ROWS`
minimum hashes, are combined in pairs: a table key is one partial key of the
first and one of the second collection. So 2 * 10 partial keys (40 minimum
hashes) give 100 tables instead of the 400 hashes that 100 independent tables of
the same strictness need. Two sets of similarity s share a table with
probability (1 - (1 - s**2)**10)**2: 0.9995 at 0.75, 0.9999 at 0.8.

1. One pass over the texts gives each document's set size, a 128-bit fingerprint
   of its shingle set and the minimum hashes.
2. Equal sets collapse to one node each, whatever the ids of their rows, so one id
   may stand for several sets; only one row per distinct set goes on.
3. In each bucket every member is paired with one member, picked by the bucket's
   key, so a bucket of n rows gives n - 1 pairs, never all of them. The pick
   differs from table to table, which makes up for the pairs left out.
4. Candidates are confirmed on full shingle sets. Each document's likeliest
   partner comes first; pairs that this already connects aren't looked at again.
5. The first links form a forest, whose roots come from pointer doubling; the
   trees that further links join come from label propagation with pointer
   jumping. Both run in Spark.
6. A prefix-filtered exact join finds every link between different groups that
   the tables or the picks missed. Shingles stand in one order, the frequent ones
   last. Of two sets that are similar enough, the first seventh of the smaller and
   the first quarter of the larger one share a shingle, so a template that
   thousands of texts share brings up no pair unless the texts are links. Groups
   found before count as one, so a group of near copies brings up none either.
   A pair whose first quarters show that it can't be a link is dropped, all others
   are confirmed on full sets. The links found join the groups.

Every step is a shuffled join or aggregation that Spark can split or combine on
the map side; what is written between them lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialise, no_null, release, small, table
from strandloom.llm.textbytes import blocks, lowered, mix64, run_hashes, space_words, word_hashes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: What tells the rows of the input apart: id and digest of the text.
ROW = ["doc_id", "th"]
COLLECTION = 10
ROWS = 2
#: Id tables of up to so many rows (16 bytes each) are broadcast to find texts again.
BROADCAST_IDS = 500_000
#: Shingles are counted in chunks of so many. Those that a chunk has OFTEN times or
#: more can count as frequent, at most FREQUENT of all chunks. These figures change
#: the order of shingles only: the exact join finds the same links in any order.
CHUNK = 1 << 22
OFTEN = 2
FREQUENT = 1_000_000

_HASHES = 2 * COLLECTION * ROWS
_ODD = mix64(np.arange(11, 11 + _HASHES, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(1011, 1011 + _HASHES, dtype=np.uint64))
_TABLE = mix64(np.arange(5011, 5011 + COLLECTION * COLLECTION, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their bounds.

    A row of fewer words than a shingle is one shingle of all its words; a row
    without words has none.
    """
    data = lowered(data)
    starts, ends, first = space_words(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = run_hashes(words, SHINGLE)
    sets = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= SHINGLE:
            sets.append(np.unique(runs[s : e - SHINGLE + 1]))
        elif e > s:
            sets.append(run_hashes(words[s:e], e - s) ^ np.uint64(e - s))
        else:
            sets.append(words[:0])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else words[:0]), bounds


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; zero for an empty one."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hashes, one row per set that isn't empty."""
    full = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(full), _HASHES), np.uint32)
    if len(full):
        for j in range(_HASHES):
            out[:, j] = np.minimum.reduceat(((values * _ODD[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), full)
    return out


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of all tables, from the pairs of partial keys."""
    part = np.zeros((len(hashes), 2 * COLLECTION), np.uint64)
    for r in range(ROWS):
        part = mix64(part + hashes[:, r :: ROWS].astype(np.uint64) + np.uint64(r + 1))
    left, right = part[:, :COLLECTION], part[:, COLLECTION:]
    both = left[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + right[:, None, :]
    return mix64(both.reshape(len(hashes), -1) + _TABLE).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(2)):
            values, bounds = shingle_sets(data, offsets)
            f1, f2 = fingerprints(values, bounds)
            hashes, sizes = min_hashes(values, bounds), np.diff(bounds)
            rows = iter(hashes)
            packed = [next(rows).tobytes() if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[lo:hi] for i in range(2)), pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2), pa.array(packed, pa.binary())],
                [*ROW, "n", "f1", "f2", "hashes"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = COLLECTION * COLLECTION
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            hashes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, _HASHES)
            nodes = np.repeat(part.column(0).to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(table_keys(hashes).ravel()), pa.array(nodes)], ["key", "node"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose fingerprint is that of their class."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(3)):
            values, bounds = shingle_sets(data, offsets)
            f1, f2 = fingerprints(values, bounds)
            own = (f1 == batch.column(1)[lo:hi].to_numpy()) & (f2 == batch.column(2)[lo:hi].to_numpy())
            sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(own)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].filter(pa.array(own)), pa.array(sets, pa.binary())], ["node", "items"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of the shingles that many rows of a chunk share."""

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x[n >= OFTEN].view(np.int64)) for x in (values, n)], ["shingle", "n"])

    parts, size = [], 0
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            parts.append(shingle_sets(data, offsets)[0])
            size += len(parts[-1])
            if size >= CHUNK:
                yield often(parts)
                parts, size = [], 0
    if parts:
        yield often(parts)


def _prefixes(frequent: np.ndarray, ranks: np.ndarray):
    """Function that gives each row's fingerprint and the first shingles of its set.

    ``frequent``: sorted hashes of the shingles that come last, in the order of
    ``ranks`` (from 1). All others come before them, ordered by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                values, bounds = shingle_sets(data, offsets)
                f1, f2 = fingerprints(values, bounds)
                rank = np.zeros(len(values), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                    rank = np.where(frequent[at] == values, ranks[at], 0)
                values = values[np.lexsort((rank, np.repeat(np.arange(hi - lo), np.diff(bounds))))]
                n = np.diff(bounds)
                ends = bounds[:-1] + n - (n * PERCENT + 99) // 100 + 1
                first = [values[a:b].tobytes() if m else None for a, b, m in zip(bounds[:-1].tolist(), ends.tolist(), n.tolist(), strict=True)]
                columns = [*(batch.column(i)[lo:hi] for i in range(2)), pa.array(f1), pa.array(f2), pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*ROW, "f1", "f2", "first"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the prefixes, with its place there."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            firsts = part.column(3).to_pylist()
            size = np.array([len(x) // 8 for x in firsts])
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            columns = [np.repeat(part.column(i).to_numpy(), size) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(firsts), np.int64)), *map(pa.array, columns), pa.array(place)], ["shingle", "node", "component", "n", "place"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose common shingles, as far as their prefixes tell, can be enough.

    Common shingles up to the last one that both prefixes hold are all known; any
    other comes after it, and outside of one prefix at least.
    """
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        lists = [batch.column(i) for i in range(4, 8)]
        for i in range(batch.num_rows):
            a, a_place, b, b_place = (c[i].values.to_numpy() for c in lists)
            both, at, bt = np.intersect1d(a, b, return_indices=True)
            if len(both):
                beyond_a = min((x[i] * PERCENT + 99) // 100 - 1, y[i] - 1 - int(b_place[bt].max()))
                beyond_b = min((y[i] * PERCENT + 99) // 100 - 1, x[i] - 1 - int(a_place[at].max()))
                good[i] = (len(both) + max(beyond_a, beyond_b)) * (100 + PERCENT) >= (x[i] + y[i]) * PERCENT
        yield batch.select([0, 1]).filter(pa.array(good))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
                continue
            both = np.sort(np.concatenate([a, b]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            good[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield batch.select([0, 1]).filter(pa.array(good))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches."""
    edges = materialise(links.unionAll(links.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = materialise(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("c").alias("near"))
        better = labels.join(near, labels.node == near.a).select("node", "c", F.least("c", "near").alias("d"))
        hop = labels.select(F.col("node").alias("h"), F.col("c").alias("hc"))
        moved = better.join(hop, F.col("d") == F.col("h")).select("node", F.least("d", "hc").alias("e"), "c")
        new = materialise(moved, "labels")
        if new.where("c <> e").isEmpty():
            return new.select("node", F.col("e").alias("component"))
        labels = new.select("node", F.col("e").alias("c"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest: ``parents`` (a, b) has one smaller b for each a.

    Pointers double in every round; a node that has no parent has no row.
    """
    state = materialise(parents.selectExpr("a AS node", "b AS component"), "roots")
    while True:
        hop = state.selectExpr("node AS h", "component AS h_component")
        moved = state.join(hop, F.col("component") == F.col("h"), "left")
        state = materialise(moved.select("node", F.coalesce("h_component", "component").alias("component"), F.col("h").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("node", "component")


def _forget(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    df.sparkSession._jvm.System.gc()


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.selectExpr("node AS a", "items AS a_items"), "a")
    both = left.join(sets.selectExpr("node AS b", "items AS b_items"), "b")
    return both.select("a", "b", "a_items", "b_items").mapInArrow(_confirmed, "a long, b long")


def _once(rows: DataFrame, repeated: bool) -> DataFrame:
    """One row for each node of ``rows``, where input rows equal in id and text stand for one node."""
    if not repeated:
        return rows
    return rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates(["node"]))


def _sets(pairs: DataFrame, chosen: DataFrame, slim: DataFrame, repeated: bool) -> DataFrame:
    """(node, items): the full set of each node of ``pairs``, from its text."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = small(materialise(chosen.select("node", "copies", "f1", "f2", *ROW).join(wanted, "node"), "wanted"), BROADCAST_IDS)
    again = _once(slim.join(wanted, ROW).select("node", "copies", "f1", "f2", "text"), repeated)
    return materialise(again.select("node", "f1", "f2", "text").mapInArrow(_set_rows, "node long, items binary"), "sets")


def _missed(members: DataFrame, slim: DataFrame, repeated: bool) -> DataFrame:
    """Pairs (a, b) of different components that can be similar enough: all links are among them.

    ``members``: (node, copies, f1, f2, doc_id, th, n, component), one row for each distinct set.
    """
    counts = slim.select("text").mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingle, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((shingle, n))] = np.arange(1, len(n) + 1)
    order = np.argsort(shingle)

    firsts = slim.mapInArrow(_prefixes(shingle[order], ranks[order]), "doc_id long, th long, f1 long, f2 long, first binary").where("first IS NOT NULL")
    rows = _once(firsts.join(members, [*ROW, "f1", "f2"]).select("node", "copies", "component", "n", "first"), repeated)
    rows = rows.select("node", "component", "n", "first")
    rows = rows.mapInArrow(_spread, "shingle long, node long, component long, n long, place long")
    same = Window.partitionBy("shingle")
    shared = rows.withColumns({"least": F.min("component").over(same), "most": F.max("component").over(same)}).where("least <> most")
    shared = materialise(shared.drop("least", "most"), "shared")
    _forget(shared)
    # The smaller set of a link has at least 2 * PERCENT / (100 + PERCENT) of its shingles in common.
    small = shared.where(f"place <= n - (n * {2 * PERCENT} + {99 + PERCENT}) div {100 + PERCENT}")
    fits = (
        "s.shingle = l.shingle AND s.component <> l.component AND (s.n < l.n OR s.n = l.n AND s.node < l.node)"
        f" AND s.n * 100 >= l.n * {PERCENT} AND least(s.n - s.place, l.n - l.place) * {100 + PERCENT} >= (s.n + l.n) * {PERCENT}"
    )
    found = small.alias("s").join(shared.alias("l"), F.expr(fits))
    near = materialise(found.selectExpr("greatest(s.node, l.node) AS a", "least(s.node, l.node) AS b").distinct(), "near")
    _forget(near)
    ends = near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct()
    prefix = shared.join(ends, "node", "left_semi").dropDuplicates(["node", "shingle"]).groupBy("node")
    prefix = materialise(prefix.agg(F.first("n").alias("n"), F.collect_list(F.struct("shingle", "place")).alias("f")).selectExpr("node", "n", "f.shingle AS shingles", "f.place AS places"), "prefixes")
    of = lambda c: prefix.selectExpr(f"node AS {c}", f"n AS {c}_n", f"shingles AS {c}_s", f"places AS {c}_p")
    both = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_n", "b_n", "a_s", "a_p", "b_s", "b_p")
    return materialise(both.mapInArrow(_possible, "a long, b long"), "missed")


def _grouped(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, th, n, component_id, kept), one row per input row."""
    body = no_null(text)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    sketches = materialise(slim.mapInArrow(_sketched, "doc_id long, th long, n long, f1 long, f2 long, hashes binary"), "sketches")
    live = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = live.groupBy("f1", "f2").agg(F.min(F.struct(*ROW)).alias("r")).select("f1", "f2", "r.*")
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    first = [F.first(c).alias(c) for c in ("f1", "f2", *ROW, "n", "hashes")]
    chosen = live.join(classes, ["f1", "f2", *ROW]).groupBy("node").agg(F.count("*").alias("copies"), *first)
    chosen = materialise(chosen, "chosen")
    repeated = not chosen.where("copies > 1").isEmpty()

    rows = chosen.select("node", "hashes").mapInArrow(_keyed, "key long, node long")
    rows = rows.withColumn("p", F.col("node").bitwiseXOR(F.col("key")))
    picked = rows.groupBy("key").agg(F.min("p").alias("least"), F.max("p").alias("most")).where("least <> most")
    pairs = (
        rows.join(picked.select("key", "least"), "key")
        .where("p <> least")
        .select(F.col("node").alias("x"), F.col("least").bitwiseXOR(F.col("key")).alias("y"))
        .select(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("a"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("tables"))
    )
    pairs = materialise(pairs, "pairs")
    _forget(pairs)

    sets = _sets(pairs, chosen, slim, repeated)
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("tables", -F.col("b"))).alias("b"))
    found = roots(_confirm(best, sets))  # each text with its likeliest smaller one: a forest
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    ends = lambda df: df.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("a_c", "a").alias("x"), F.coalesce("b_c", "b").alias("y"))
    rest = ends(pairs.select("a", "b").join(best, ["a", "b"], "left_anti")).where("x <> y").select("a", "b")
    more = materialise(_confirm(rest, sets), "links")
    joined = components(ends(more).select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
    release(sets)
    _forget(pairs)

    labelled = classes.join(found, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("first"))
    labelled = labelled.join(joined, F.col("first") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "first").alias("component"))

    members = materialise(chosen.drop("hashes").join(labelled, ["f1", "f2"]), "members")
    missed = _missed(members, slim, repeated)
    late = _confirm(missed, _sets(missed, chosen, slim, repeated))
    of = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    late = late.join(of("a"), "a").join(of("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()
    last = components(late).select(F.col("node").alias("component"), F.col("component").alias("last"))
    named = members.join(last, "component", "left").select("f1", "f2", "doc_id", F.coalesce("last", "component").alias("component"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labelled = named.join(least, "component").select("f1", "f2", "component_id")
    return (
        sketches.select(*ROW, "n", "f1", "f2")
        .join(labelled, ["f1", "f2"], "left")
        .select(*ROW, "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing. Rows that
    share an id and a text are one document; rows that share an id only are told
    apart, each has the links of its own text. A row without id is linked with
    nothing, has no component and is kept. Other columns are ignored.
    """
    return _grouped(docs, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group, columns unchanged."""
    gone = materialise(_grouped(docs, text).where("NOT kept").select(*ROW).distinct(), "gone").alias("gone")
    rows = docs.alias("row")
    same = (F.col("row.doc_id") == F.col("gone.doc_id")) & (F.xxhash64(no_null(F.col(f"row.`{text}`"))) == F.col("gone.th"))
    return rows.join(small(gone, BROADCAST_IDS), same, "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return groups(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every pair of texts with a common shingle is compared: for small tables only.
ORACLE_SQL = f"""
WITH RECURSIVE n AS MATERIALIZED (
  SELECT row_number() OVER () AS v, doc_id, text, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
sh AS MATERIALIZED (
  SELECT v, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE} - 1], ' '))) END) AS s FROM n),
m AS MATERIALIZED (SELECT v, count(*) AS m FROM sh GROUP BY v),
ids AS (SELECT sh.v, s, m FROM sh JOIN m USING (v) JOIN n USING (v) WHERE doc_id IS NOT NULL),
link AS MATERIALIZED (
  SELECT a.v AS x, b.v AS y FROM ids a JOIN ids b ON a.s = b.s AND a.v <> b.v
  GROUP BY a.v, b.v HAVING 100 * count(*) >= {PERCENT} * (any_value(a.m) + any_value(b.m) - count(*))),
reach AS (SELECT DISTINCT x AS v, x AS r FROM link UNION SELECT v, y FROM reach JOIN link ON r = x),
comp AS (SELECT reach.v, min(doc_id) AS component_id FROM reach JOIN n ON r = n.v GROUP BY reach.v)
SELECT d.doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(d.doc_id = coalesce(component_id, n.doc_id), true) AS kept
FROM (SELECT doc_id, text FROM documents) d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND coalesce(d.text, '') = n.text LEFT JOIN m ON m.v = n.v LEFT JOIN comp ON comp.v = n.v
"""
