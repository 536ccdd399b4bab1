"""Conversation structure repair: a time-major tensor program over edit costs.

The roles of a repaired conversation follow ``(s?(ua)+)?``. Four states tell what
may come next: nothing yet, after the system turn, after a user, after an
assistant. Conversations are bucketed by length; for a bucket of C
conversations the codes of their turns form a matrix (turn, conversation), and
one numpy step a turn updates the costs (conversation, state) of all of them,
from the last turn to the first. All costs stay, so the cheapest edits
are traced forwards for all conversations at once, the ASCII-least letter first:
the letters of equal cost at one place lead to strings that differ there, so
this gives the ASCII-least string.

A conversation of more than :data:`LONG` turns isn't held by one task. Its turns
are range-partitioned in their order and cut into segments; a segment's costs
from each state to each state are a min-plus matrix, which compose along the
conversation; then each segment is traced by itself from the costs at its end.
Only its repaired text goes through one task, as a stream, since SHA-256 is
sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import SPACE_CLASS, SPACES, materialise, small, sql_crc32, table

# Roles, and the costs of the edits.
ROLES = ("system", "user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Turns from which on a conversation goes in segments, and the turns of one.
LONG, SEGMENT = 1 << 16, 1 << 12
#: Largest number of entries of one (turn, conversation) matrix with several conversations.
CELLS = 1 << 20
#: Up to so many long conversations, or repeated turns, are broadcast.
BROADCAST_ROWS = 200_000

_FAR = 1 << 40
#: State after the one role (user or assistant) that can be written anew in a state.
_NEXT = np.array([2, 2, 3, 2])
#: State after keeping a turn of initial s, u, a or another one; 4: not possible.
_STEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: What still has to be inserted at the end of a conversation, by state.
_TAIL = np.array(["", "II", "I", ""])
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)

_FAULTS = "blank long, duplicate long, truncated long, illegal long"
_DAMAGE = 20


def damaged(rows: DataFrame) -> DataFrame:
    """(g, turn, role, text) of the rows after the damage that the digest of id and turn deals.

    A null counts as one space in every column but ``turn``, which keeps it for the order.
    ``g`` names the conversation, null too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select(
        group_name(), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % _DAMAGE).alias("d"),
    )
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return slim.where("d <> 0").select("g", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def group_name():
    return F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")).alias("g")


def coded(rows: DataFrame) -> DataFrame:
    """The rows with ``code``: initial (2 bits), cut off, blank, and equal to a row of an earlier turn.

    Only turns that say at different places what others said take part in the join.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = F.md5(F.concat(F.char_length("g").cast("string"), F.lit(":"), "g", F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    keyed = rows.withColumns({"said": said, "place": place})
    again = keyed.groupBy("said").agg(F.min("place").alias("earliest"), F.max("place").alias("latest")).where("earliest < latest")
    again = small(materialise(again.select("said", "earliest"), "said"), BROADCAST_ROWS)
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    spoken = F.rtrim("text", F.lit(SPACES))
    bits = [
        (4, ~F.substring(spoken, -1, 1).isin(".", "!", "?")),
        (8, ~F.col("text").rlike(SPACE_CLASS.replace("[", "[^"))),
        (16, F.coalesce(F.col("place") > F.col("earliest"), F.lit(False))),
    ]
    code = initial
    for bit, c in bits:
        code = code + F.when(c, bit).otherwise(0)
    return keyed.join(again, "said", "left").select("g", "turn", "role", "text", code.cast("int").alias("code"))


# Kernels over (turn, conversation) matrices


def effective(code: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the program (initial, 4: cut off, 8: must go), and (blank, duplicate, truncated) of each row."""
    blank = (code & 8) > 0
    duplicate = ((code & 16) > 0) | copied
    duplicate &= ~blank
    gone = blank | duplicate
    cut = ((code & 4) > 0) & ~gone
    return (code & 3) + 4 * cut + 8 * gone, np.stack([blank, duplicate, cut], 1)


def illegal(codes: np.ndarray) -> np.ndarray:
    """Whether each row and the next one are no su, ua or au."""
    a, b = codes[:-1] & 3, codes[1:] & 3
    return ~(((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2))


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn, conversation, state) of repairing all from that turn on, given those at the end."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    far, each = np.full((n, 1), _FAR), np.arange(n)[:, None]
    for t in range(turns - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        stays = (TRUNCATED * ((code >> 2) & 1) + _FAR * ((code >> 3) & 1))[:, None]
        kept = np.concatenate([after, far], 1)[each, _STEP[code & 3]] + stays
        best = np.minimum(np.minimum(kept, after[:, _NEXT] + REROLE + stays), after + DELETE)
        costs[t] = np.minimum(best, np.minimum(best[:, _NEXT] + INSERT, best[:, _NEXT[_NEXT]] + 2 * INSERT))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Edits of each conversation from its state at its first turn on, and the state at the end.

    Conversations lie at the end of the matrix.
    """
    turns, n = codes.shape
    at, state, each = turns - length, state.copy(), np.arange(n)
    letters = []
    while True:
        live = at < turns
        if not live.any():
            break
        t = np.minimum(at, turns - 1)
        code, now = codes[t, each], costs[t, each, state]
        step, new = _STEP[code & 3, state], _NEXT[state]
        delete = costs[t + 1, each, state] + DELETE == now
        insert = costs[t, each, new] + INSERT == now
        keep = (step < 4) & (code < 8) & (costs[t + 1, each, np.minimum(step, 3)] + TRUNCATED * ((code >> 2) & 1) == now)
        letter = np.select([~live, delete, insert, keep], [0, 68, 73, 75], 82).astype(np.uint8)
        letters.append(letter)
        state = np.select([~live | (letter == 68), letter == 75], [state, np.minimum(step, 3)], new)
        at = at + (live & (letter != 73))
    if not letters:
        return [""] * n, state
    edits = np.ascontiguousarray(np.stack(letters, 1))
    return [row.tobytes().rstrip(b"\0").decode() for row in edits], state


def buckets(length: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of conversations of similar length, so that a matrix has at most :data:`CELLS` entries or one conversation."""
    order = np.argsort(length, kind="stable")
    cls = np.ceil(np.log2(np.maximum(length[order], 1))).astype(int)
    for part in np.split(order, np.flatnonzero(np.diff(cls)) + 1):
        step = max(1, CELLS // max(1, int(length[part].max(initial=1))))
        for lo in range(0, len(part), step):
            yield part[lo : lo + step]


def matrix(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Codes of conversations as a (turn, conversation) matrix, each at its end."""
    turns = int(length.max(initial=0))
    out = np.zeros((turns, len(length)), np.int64)
    column = np.repeat(np.arange(len(length)), length)
    within = np.arange(len(column)) - np.repeat(np.cumsum(length) - length, length)
    out[turns - length[column] + within, column] = codes[start[column] + within]
    return out


def repaired_lines(edits: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that the edits leave."""
    out, row, state = [], 0, 0
    for letter in edits:
        if letter == "I":
            out.append(ROLES[_NEXT[state] - 1] + ":")
            state = _NEXT[state]
            continue
        if letter != "D":
            role = roles[row]
            step = _STEP["sua".find(role[:1]) if role else 3, state] if letter == "K" else _NEXT[state]
            out.append((role if letter == "K" else ROLES[step - 1]) + ":" + texts[row])
            state = step
        row += 1
    return out


def _repeats(t: pa.Table) -> np.ndarray:
    """Whether a row equals the one before in conversation, turn, role and text."""
    n = len(t)
    same = np.zeros(n, bool)
    if n > 1:
        equal = pa.array(np.ones(n - 1, bool))
        for c in ("g", "turn", "role", "text"):
            a, b = t[c].slice(0, n - 1), t[c].slice(1)
            one = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            equal = pc.and_(equal, one)
        same[1:] = np.asarray(equal.combine_chunks() if isinstance(equal, pa.ChunkedArray) else equal)
    return same


_SHORT = f"g string, {_FAULTS}, cost long, audit string, repaired_sha256 string"


def _repair_whole(t: pa.Table) -> pa.RecordBatch:
    """Results of whole conversations, which lie behind one another in ``t``."""
    g = t["g"].combine_chunks()
    start = np.concatenate([[0], np.flatnonzero(np.asarray(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)))) + 1])
    length = np.diff(np.append(start, len(g)))
    codes, faults = effective(t["code"].to_numpy(), _repeats(t))
    counts = np.add.reduceat(faults.astype(np.int64), start)
    bad = np.append(illegal(codes), False).astype(np.int64)
    bad[start[1:] - 1] = 0
    bad = np.add.reduceat(bad, start)
    cost, audit = np.zeros(len(start), np.int64), [""] * len(start)
    for part in buckets(length):
        m = matrix(codes, start[part], length[part])
        costs = backward(m, np.broadcast_to(_END, (len(part), 4)))
        first = m.shape[0] - length[part]
        cost[part] = costs[first, np.arange(len(part)), 0]
        edits, state = trace(m, costs, length[part], np.zeros(len(part), int))
        for i, e, s in zip(part, edits, state):
            audit[i] = e + str(_TAIL[s])
    digest = []
    for i, (a, n) in enumerate(zip(start, length)):
        lines = repaired_lines(audit[i], t["role"].slice(a, n).to_pylist(), t["text"].slice(a, n).to_pylist())
        digest.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
    columns = [g.take(pa.array(start)).cast(pa.string()), *(pa.array(c) for c in counts.T), pa.array(bad), pa.array(cost), pa.array(audit), pa.array(digest)]
    return pa.RecordBatch.from_arrays(columns, ["g", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair of a partition that is sorted by conversation; only an unfinished one is carried on."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        g = t["g"].combine_chunks()
        cut = np.flatnonzero(np.asarray(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)))) + 1 if len(g) else []
        if len(cut):
            yield _repair_whole(t.slice(0, int(cut[-1])))
            t = t.slice(int(cut[-1]))
        rest = t
    if rest is not None and len(rest):
        yield _repair_whole(rest)


def _ordered():
    return [F.col("g"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their place in it, effective code and faults."""
    last, at = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        same = _repeats(pa.concat_tables([last, t]) if last is not None else t)[0 if last is None else 1 :]
        codes, faults = effective(t["code"].to_numpy(), same)
        columns = [t["g"], t["role"], t["text"], t["part"], pa.array(np.arange(at, at + len(t))), pa.array(codes.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in faults.T)]
        yield from pa.Table.from_arrays(columns, ["g", "role", "text", "part", "at", "code", "blank", "duplicate", "truncated"]).to_batches()
        last, at = t.slice(len(t) - 1), at + len(t)


def _flat(codes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.asarray(pc.list_value_length(codes)).astype(np.int64)
    return pc.list_flatten(codes).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(length) - length, length


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-plus matrix of each segment: costs from a state at its start (rows) to one at its end."""
    for batch in batches:
        codes, start, length = _flat(batch.column("codes"))
        out = np.zeros((len(length), 16), np.int64)
        unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
        for part in buckets(4 * length):
            m = matrix(codes, start[part], length[part])
            four = backward(np.repeat(m, 4, 1), np.tile(unit, (len(part), 1)))
            first = np.repeat(m.shape[0] - length[part], 4)
            to = four[first, np.arange(4 * len(part))].reshape(len(part), 4, 4)  # (segment, end, start)
            out[part] = to.transpose(0, 2, 1).reshape(len(part), 16)
        bad = [int(illegal(codes[a : a + n]).sum()) for a, n in zip(start, length)]
        firsts, lasts = codes[start] & 3, codes[start + length - 1] & 3
        columns = [*(batch.column(c) for c in ("g", "part", "seg")), pa.array(list(out)), pa.array(bad, pa.int64()), pa.array(firsts), pa.array(lasts)]
        yield pa.RecordBatch.from_arrays(columns, ["g", "part", "seg", "m", "bad", "first", "last"])


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of every segment of a conversation, which has a row for each :data:`SEGMENT` turns."""
    rows = rows.sort_values(["part", "seg"])
    end, out = _END, [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = end
        end = (np.asarray(rows["m"].iloc[i]).reshape(4, 4) + end).min(1)
    a, b = rows["last"].to_numpy()[:-1], rows["first"].to_numpy()[1:]
    joints = int(sum(illegal(np.array([x, y]))[0] for x, y in zip(a, b)))
    return pd.DataFrame({"g": rows["g"], "part": rows["part"], "seg": rows["seg"], "ends": out, "cost": int(end[0]), "bad": rows["bad"].sum() + joints})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each segment, and the state at its end, from every state at its start."""
    for batch in batches:
        codes, start, length = _flat(batch.column("codes"))
        ends = pc.list_flatten(batch.column("ends")).to_numpy(zero_copy_only=False).reshape(-1, 4)
        edits, exits = np.empty((len(length), 4), object), np.zeros((len(length), 4), np.int64)
        for part in buckets(length):
            m = matrix(codes, start[part], length[part])
            costs = backward(m, ends[part])
            for s in range(4):
                found, exits[part, s] = trace(m, costs, length[part], np.full(len(part), s))
                edits[part, s] = found
        columns = [*(batch.column(c) for c in ("g", "part", "seg")), pa.array(list(exits)), pa.array([list(e) for e in edits], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["g", "part", "seg", "exits", "edits"])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """State at the start of every segment, and what is inserted after the last one."""
    rows = rows.sort_values(["part", "seg"])
    state, out = 0, []
    for exits in rows["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"g": rows["g"], "part": rows["part"], "seg": rows["seg"], "state": out, "tail": [""] * (len(rows) - 1) + [str(_TAIL[state])]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the repaired text of conversations whose rows stream by in their order."""
    g, state, digest, fresh = None, 0, None, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([digest.hexdigest()])], ["g", "repaired_sha256"])

    for batch in batches:
        for name, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("g", "edits", "role", "text"))):
            if name != g:
                if digest is not None:
                    yield row()
                g, state, digest, fresh = name, 0, hashlib.sha256(), True
            for letter in edits:
                if letter == "D":
                    continue
                step = _STEP["sua".find(role[:1]) if role else 3, state] if letter == "K" else _NEXT[state]
                said = (role if letter == "K" else ROLES[step - 1]) + ":" + ("" if letter == "I" else text)
                digest.update(("" if fresh else "\n").encode() + said.encode())
                state, fresh = step, False
    if digest is not None:
        yield row()


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Repair of long conversations by segments."""
    keys = ["g", "part", "seg"]
    ranged = rows.repartitionByRange("g", F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64))).sortWithinPartitions(*_ordered())
    marked = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_marked, "g string, role string, text string, part int, at long, code int, blank long, duplicate long, truncated long")
    placed = materialise(marked.withColumn("seg", F.floor(F.col("at") / segment)), "turns")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    segments = materialise(placed.groupBy(*keys).agg(F.min("at").alias("at"), codes.alias("codes")), "segments")
    transfers = segments.select(*keys, "codes").mapInArrow(_transfers, "g string, part int, seg long, m array<long>, bad long, first long, last long")
    ends = materialise(transfers.groupBy("g").applyInPandas(_ends, "g string, part int, seg long, ends array<long>, cost long, bad long"), "ends")
    traced = materialise(segments.select(*keys, "codes").join(ends.select(*keys, "ends"), keys).mapInArrow(_traced, "g string, part int, seg long, exits array<long>, edits array<string>"), "traced")
    starts = traced.select(*keys, "exits").groupBy("g").applyInPandas(_starts, "g string, part int, seg long, state int, tail string")
    chosen = traced.join(starts, keys).select(*keys, F.get("edits", F.col("state")).alias("edits"), "tail")
    chosen = materialise(chosen.join(segments.select(*keys, "at"), keys), "edits")

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seg", F.concat("edits", "tail").alias("e")))), lambda x: x["e"]), "")
    audits = chosen.groupBy("g").agg(audit.alias("audit"))
    each = chosen.select("g", "part", "at", F.posexplode(F.regexp_extract_all("edits", F.lit("I*[DKR]"), F.lit(0))).alias("n", "edits"))
    turns = placed.select("g", "part", "at", "role", "text").join(each.select("g", "part", (F.col("at") + F.col("n")).alias("at"), "edits"), ["g", "part", "at"])
    last = chosen.where("tail <> ''").select("g", F.lit((1 << 31) - 1).alias("part"), "at", F.lit("").alias("role"), F.lit("").alias("text"), F.col("tail").alias("edits"))
    stream = turns.unionByName(last).repartition("g").sortWithinPartitions("g", "part", "at")
    digests = stream.select("g", "edits", "role", "text").mapInArrow(_hashed, "g string, repaired_sha256 string")
    faults = placed.groupBy("g").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    whole = ends.groupBy("g").agg(F.first("bad").alias("illegal"), F.first("cost").alias("cost"))
    return faults.join(whole, "g").join(audits, "g").join(digests, "g")


def repair(rows: DataFrame, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation (``g``) of (g, turn, role, text) with faults, cost, edits and the digest of the repaired text.

    Rows go by turn (null first), then role and text; equal rows lie side by side.
    """
    every = materialise(coded(rows), "coded")
    names = every.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > long).select("g")
    names = materialise(names, "long")
    if names.isEmpty():
        return every.repartition("g").sortWithinPartitions(*_ordered()).mapInArrow(_short, _SHORT)
    names = small(names, BROADCAST_ROWS)
    short = every.join(names, "g", "left_anti").repartition("g").sortWithinPartitions(*_ordered()).mapInArrow(_short, _SHORT)
    return short.unionByName(_long(every.join(names, "g", "left_semi"), segment))


def gaps(rows: DataFrame) -> DataFrame:
    """(g, gaps): turns missing between the first and the last one, nulls ignored."""
    turns = rows.where("turn IS NOT NULL").select("g", "turn").distinct()
    return turns.groupBy("g").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def audit(conversations: DataFrame, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation after the damage.

    Null ids form one conversation, nulls elsewhere read as one space (a null
    turn sorts first), repeated rows are turns of their own, other columns are
    ignored. A conversation whose rows all go has zeros, no edits and the digest of
    the empty string; empty tables give no row. Texts may have any length; whole
    conversations of up to ``long`` turns lie in one task's memory.
    """
    hurt = damaged(conversations)
    ids = conversations.select(group_name(), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(repair(hurt, long, segment), "g", "left").join(gaps(hurt), "g", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation."""
    return audit(table(spark, sf_dir, "conversations"))


def _sql_state(state: int) -> str:
    """Least (cost, edits, repaired text) in a state before row ``i``, without insertions."""
    options = [f"{{'c': v{state}.c + {DELETE}, 'a': 'D' || v{state}.a, 'r': v{state}.r}}"]
    for initial, name in enumerate("sua"):
        if _STEP[initial][state] < 4:
            to = f"v{_STEP[initial][state]}"
            options.append(f"{{'c': {to}.c + cut + CASE WHEN gone OR left(role, 1) <> '{name}' THEN 1000000000 ELSE 0 END, 'a': 'K' || {to}.a, 'r': role || ':' || text || chr(10) || {to}.r}}")
    to = f"v{_NEXT[state]}"
    options.append(f"{{'c': {to}.c + {REROLE} + cut + CASE WHEN gone THEN 1000000000 ELSE 0 END, 'a': 'R' || {to}.a, 'r': '{ROLES[_NEXT[state] - 1]}:' || text || chr(10) || {to}.r}}")
    return f"list_min([{', '.join(options)}])"


def _sql_inserted(state: int, of: str) -> str:
    """The state's least value, with up to two insertions before the row."""
    one, two = _NEXT[state], _NEXT[_NEXT[state]]
    line = lambda s: f"'{ROLES[s - 1]}:' || chr(10)"
    return (
        f"list_min([{of}{state}, {{'c': {of}{one}.c + {INSERT}, 'a': 'I' || {of}{one}.a, 'r': {line(one)} || {of}{one}.r}}, "
        f"{{'c': {of}{two}.c + {2 * INSERT}, 'a': 'II' || {of}{two}.a, 'r': {line(one)} || {line(two)} || {of}{two}.r}}])"
    )


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_SPOKEN = r"[^\x20\x09-\x0D]"
ORACLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT coalesce('i' || conv_id, 'n') AS g, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {sql_crc32(f"list_transform(string_split({_KEY}, ''), lambda x: ord(x))")} % {_DAMAGE} AS d FROM conversations),
t AS (
  SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE d <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
f AS (
  SELECT *, NOT regexp_matches(text, '{_SPOKEN}') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '({_SPOKEN})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS ends,
         left(lag(role) OVER (PARTITION BY g ORDER BY i), 1) || left(role, 1) AS two FROM o),
r AS MATERIALIZED (
  SELECT g, i, role, text, two, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND ends AS truncated,
         blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND ends THEN {TRUNCATED} ELSE 0 END AS cut FROM f),
dp AS (
  SELECT g, count(*) AS i, {{'c': 0, 'a': '', 'r': ''}} AS v0, {{'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS v1,
         {{'c': 2, 'a': 'I', 'r': 'assistant:' || chr(10)}} AS v2, {{'c': 0, 'a': '', 'r': ''}} AS v3 FROM r GROUP BY g
  UNION ALL
  SELECT g, i, {", ".join(_sql_inserted(s, "w") for s in range(4))} FROM (
    SELECT dp.g, dp.i - 1 AS i, {", ".join(f"{_sql_state(s)} AS w{s}" for s in range(4))} FROM dp JOIN r ON r.g = dp.g AND r.i = dp.i)),
best AS (SELECT g, v0.c AS cost, v0.a AS audit, sha256(left(v0.r, greatest(length(v0.r) - 1, 0))) AS digest FROM dp WHERE i = 0),
n AS (
  SELECT g, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g),
s AS (SELECT g, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM t GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, coalesce('i' || conv_id, 'n') AS g FROM conversations) LEFT JOIN n USING (g) LEFT JOIN best USING (g) LEFT JOIN s USING (g)
"""
