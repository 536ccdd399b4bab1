"""Licence scan against plain word matching and a recursive-descent evaluation of expressions."""

import itertools
import random
import re

import pytest
from strandloom.llm import license_scan as L


def descend(tokens):
    """(labels, restriction) by recursive descent, None for an expression that isn't well formed."""
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def primary():
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            value = level(0)
            if peek() != ")":
                raise ValueError
            at += 1
            return value[0], value[1], False
        if t is None or t in ("and", "or", "with", ")"):
            raise ValueError
        label = L.label_of(t)
        return {label}, L.RESTRICTS[label], True

    def level(n):
        nonlocal at
        if n == 3:
            return primary()
        left = level(n + 1)
        while peek() == ("or", "and", "with")[n]:
            at += 1
            right = level(n + 1)
            if n == 2:
                if not (left[2] and right[2]):
                    raise ValueError
                left = left[0], min(left[1], L.EXCEPTED), False
            else:
                left = left[0] | right[0], (max if n else min)(left[1], right[1]), False
        return left

    try:
        value = level(0)
        if at < len(tokens):
            raise ValueError
        return frozenset(value[0]), value[1]
    except ValueError:
        return frozenset([L.INVALID]), L.RESTRICTS[L.INVALID]


def test_every_short_expression():
    some = ["MIT", "GPL-3.0-only", "AND", "or", "WITH", "(", ")"]
    for n in range(6):
        for tokens in itertools.product(some, repeat=n):
            assert L.evaluate(list(tokens)) == descend(list(tokens)), tokens


def test_longer_expressions():
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["MIT", "Apache-2.0", "AGPL-3.0", "CC-BY-NC-4.0", "foo"])] + (["with", "Foo-exception"] if rng.random() < 0.3 else [])
        inner = made(depth - 1) + [rng.choice(["and", "or"])] + made(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(2000):
        tokens = made(5)
        if rng.random() < 0.2:
            tokens.pop(rng.randrange(len(tokens)))
        assert L.evaluate(tokens) == descend(tokens)


def plain(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = f" {' '.join(words)} "
    places, labels, base = [], set(), set()
    for phrase, label in [*L.BASE.items(), *L.NOTICES.items()]:
        n = len(phrase.split())
        found = [i for i in range(len(words)) if words[i : i + n] == phrase.split()] if f" {phrase} " in line else []
        if found:
            labels.add(label)
            if phrase in L.BASE:
                base.add(label)
                places += found
    score = max((L.RESTRICTS[x] for x in labels), default=0.0)
    for said in re.findall(L._TAGGED.encode(), (text or "").encode(), re.IGNORECASE):
        names, restricts = descend(re.findall(L._TOKEN, said.decode("latin-1")))
        labels, score = labels | names, max(score, restricts)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


PARTS = ["MIT", "License", "gnu", "General", "public", "LICENSE", "cc", "BY", "nc", "apache", "x", "\u00e9", "mit\u00e9", "SPDX-License-Identifier: MIT AND (GPL-2.0 OR ISC)", "all rights reserved", "free"]


@pytest.mark.parametrize("part_bytes", [1 << 20, 64])
def test_random_texts(spark, monkeypatch, part_bytes):
    rng = random.Random(part_bytes)
    texts = ["".join(rng.choice(PARTS) + rng.choice([" ", "\n", "-", ", ", "/", ""]) for _ in range(rng.choice([0, 1, 4, 40, 200]))) for _ in range(300)] + [None, ""]
    import numpy as np

    monkeypatch.setattr(L, "PART_BYTES", part_bytes)
    words = L.automaton()
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        assert L.scan_block(words, data, np.array([0, len(data)])) == [plain(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in L.scan(df).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_a_very_long_text(spark):
    """12 MB, with a phrase over the border of two parts and one at the end, and a word of 3 MB."""
    text = "a " * (L.PART_BYTES // 2 - 2) + "gnu general public license " + "b" * 3_000_000 + " mit license" * 700_000 + "\nSPDX-License-Identifier: MIT\n cc by"
    df = spark.createDataFrame([(1, text), (2, "cc by")], "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in L.scan(df).collect()} == {1: plain(text), 2: plain("cc by")}
