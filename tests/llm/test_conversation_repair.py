"""Conversation repair against a search over all edits, and long conversations against short ones."""

import hashlib
import heapq
import re
import zlib

import pytest
from strandloom.llm import conversation_repair as C

from tests.llm import helpers

FINE = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Rows after the damage by conversation, in their order."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows, faults):
    """(cost, edits, lines) of least cost, then least edits, by uniform-cost search over written role initials."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, said, lines = heapq.heappop(queue)
        if i == len(rows) and FINE.match(said):
            return cost, edits, list(lines)
        tail = said[-3:]  # what may follow depends on no more than that
        if (i, len(said) > 0, tail[-1:]) in done:
            continue
        done.add((i, len(said) > 0, tail[-1:]))
        more = [("I", 2, i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more.append(("D", 3, i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                more.append(("K", extra, i + 1, role or "?", f"{role}:{text}"))
                more += [("R", 2 + extra, i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, price, at, role, line in more:
            new = said + role[:1]
            if not role or re.match(r"s?(ua)*u?\Z", new):
                heapq.heappush(queue, (cost + price, edits + letter, at, new, lines if line is None else (*lines, line)))
    raise AssertionError("no repair")


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            spoken = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, edits, lines = cheapest(kept, faults)
        turns = {t for t, _, _ in kept if t is not None}
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_search_over_all_edits(spark, seed):
    t = helpers.conversations(seed)
    got = rows_of(C.audit(spark.createDataFrame(t)))
    assert got == expected(list(zip(*(t.column(i).to_pylist() for i in range(4)))))


@pytest.mark.parametrize("long, segment", [(0, 1), (4, 3), (12, 1000)])
def test_long_conversations_in_segments(spark, tmp_path, long, segment):
    rows = spark.read.parquet(helpers.write(tmp_path) + "/conversations.parquet")
    assert rows_of(C.audit(rows.repartition(3), long, segment)) == rows_of(C.audit(rows))


def test_a_hot_conversation_and_a_very_long_text(spark):
    """A third of all turns are of one conversation, all null turns; one text has 12 MB."""
    rows = [(1, None, "user", f"q{i}.") for i in range(300)] + [(2, 0, "user", "x " * 6_000_000), (2, 1, "assistant", "y.")]
    rows += [(i, 0, "user", "Hi.") for i in range(3, 600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(C.audit(df, 50, 16))
    assert got == rows_of(C.audit(df)) and len(got) == 599 and got == expected(rows)
