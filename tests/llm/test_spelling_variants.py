"""Spelling variants against a direct count and comparison of all words."""

import collections
import itertools
import random
import re
import zlib

import pytest
from strandloom.llm import spelling_variants as V


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected(words):
    close = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return out


def made(seed, size):
    """Words around few stems, so that many halves are shared and chains of forms arise."""
    rng = random.Random(seed)
    letters = "abcz\u00e9\u00ff\u00d7"
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12, 15]))) for _ in range(6)] + ["a" * 9, "ab" * 5]
    words = set(stems)
    while len(words) < size:
        w = rng.choice(sorted(words))
        i, c = rng.randrange(len(w) + 1), rng.choice(letters)
        w = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
        if len(w) >= 7:
            words.add(w)
    return {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize("slice_size", [1 << 16, 5])
def test_all_pairs(spark, slice_size):
    words = made(3, 700) | {"z" * 300: 2, "z" * 301: 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in V.variants(df, slice_size).collect()} == expected(words)


def test_blocks_end_between_halves(spark, monkeypatch):
    words = made(4, 400)
    monkeypatch.setattr(V, "BLOCK", 40)
    rows = sorted((side, len(w) + role, (w[: (len(w) + role - 1) // 2] if side == 0 else w[len(w) - (len(w) + role - 1) // 2 :]), 0, role, w, n) for w, n in words.items() for side in (0, 1) for role in (0, 1))
    import pyarrow as pa

    names = ["side", "m", "half", "slice", "role", "word", "n"]
    t = pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)})
    got = set()
    for batch in V._searched(t.to_batches(max_chunksize=33)):
        got |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert got == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and a != b and near(a, b)}


def test_automaton_is_minimal_and_numbers_every_word():
    import numpy as np

    words = sorted(x + y for x in ("abcd", "abce", "xbcd", "zzzz") for y in ("tail", "tall", "tell"))
    a = V.Automaton(np.array([list(w.encode()) for w in words], np.uint8))
    assert [len(np.unique(keys >> 8)) for keys, _, _ in a.levels] == [1, 3, 3, 3, 1, 1, 2, 1]
    for i, w in enumerate(words):
        state, number = np.zeros(1, int), 0
        for d, c in enumerate(w.encode()):
            ok, state, skipped = a.step(d, state, np.array([c]))
            assert ok[0]
            number += int(skipped[0])
        assert number == i


def test_very_long_texts_and_words(spark):
    """Texts of several blocks, one with a run of 3 MB; a third of all words are one."""
    rng = random.Random(1)
    mixed = " ".join(rng.choice(["alphabets", "ALPHABET", "alphabit", "betaalpha\u00e9", "\u00c9tudiant", "short"]) for _ in range(300_000))
    docs = [(1, mixed), (2, "x" * 3_000_000 + " alphabets" * 400_000), (3, "x" * 3_000_000), (4, None), (None, "alphabet alphabet"), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in V.vocabulary(df).collect()}
    assert got == vocabulary(docs)


def test_whole_query_on_small_texts(spark):
    rng = random.Random(6)
    stems = ["necessary", "separately", "accommodate", "d\u00e9finition"]
    docs = [(i, " ".join(w if rng.random() > 0.05 else w[:3] + w[4:] for w in rng.choices(stems, k=30))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in V.variants(V.vocabulary(df)).collect()} == expected(vocabulary(docs))
