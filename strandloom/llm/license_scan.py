"""License scan: Aho-Corasick over words, and licence expressions by a shunting-yard.

One automaton holds the notice phrases and the identifier tags, as words between
single spaces. A block of texts is brought to that form in a few numpy passes
(lower-cased, separators squeezed to one space, a line feed between texts) and
read once. A text with a tag is then searched for the tag's expression, such as
``(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause``.

The shunting-yard applies operators to a stack of values while it reads. A value
has the labels of its licences and how much they restrict use, from 0 to 1: of
``OR`` the user takes the milder side, ``AND`` binds to the stricter one, and
``WITH`` an exception bounds the restriction of one licence. Every notice and
every tag of a text binds, so its score is the greatest restriction among them,
0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.llm.textbytes import blocks, lowered

# Fixed values of the contract: base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices of this method.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "public-domain",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Identifier tags, as words.
TAGS = ("spdx license identifier", "license expression")
#: Beginnings of licence identifiers and their labels; the first that fits counts.
IDENTIFIERS = {
    "agpl-": "agpl", "lgpl-": "lgpl", "gpl-": "gpl", "apache-": "apache", "mit": "mit", "bsd-": "bsd", "0bsd": "bsd", "mpl-": "mpl", "isc": "isc", "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa", "cc-by-": "cc-by", "cc0-": "public-domain", "unlicense": "public-domain",
}
OTHER, INVALID = "other", "invalid-expression"
#: How much each label restricts use.
RESTRICTS = {
    "public-domain": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.15, "apache": 0.2, "cc-by": 0.25, "mpl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.8, "agpl": 0.9, "cc-by-nc": 0.95,
    "reserved": 1.0, OTHER: 0.5, INVALID: 0.5,
}
#: A licence with an exception restricts no more than this.
EXCEPTED = 0.4

_BINDS = {"or": 1, "and": 2, "with": 3}
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_TAGGED = r"(?:^|" + _GAP + ")(?:" + "|".join((_GAP + "+").join(t.split()) for t in TAGS) + r")[ \t]*[:=][ \t]*([A-Za-z0-9.+() \t-]*)"
_TOKEN = r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]"
_EXPRESSION = re.compile(_TAGGED.encode(), re.IGNORECASE)
_TOKENS = re.compile(_TOKEN)

#: Bytes of a text, from which on it is read in parts that overlap by the words of a phrase.
PART_BYTES = 1 << 20
_PHRASE_WORDS = max(len(p.split()) for p in [*BASE, *NOTICES, *TAGS])


def label_of(identifier: str) -> str:
    low = identifier.lower()
    return next((label for start, label in IDENTIFIERS.items() if low.startswith(start)), OTHER)


def evaluate(tokens: list[str]) -> tuple[frozenset, float]:
    """(labels, restriction) of a licence expression; one that isn't well formed has the label :data:`INVALID`.

    ``WITH`` binds closer than ``AND``, and that closer than ``OR``, all to the left; letters go in either case.
    """
    invalid = frozenset([INVALID]), RESTRICTS[INVALID]
    values: list[tuple[frozenset, float, bool]] = []  # labels, restriction, whether it is a bare identifier
    operators: list[str] = []

    def apply() -> bool:
        operator, right, left = operators.pop(), values.pop(), values.pop()
        if operator == "with":
            values.append((left[0], min(left[1], EXCEPTED), False))
            return left[2] and right[2]
        values.append((left[0] | right[0], (max if operator == "and" else min)(left[1], right[1]), False))
        return True

    operand = True  # whether one is due
    for token in tokens:
        low = token.lower()
        if (low == "(" or low not in _BINDS and low != ")") != operand:
            return invalid
        if low == "(":
            operators.append(low)
        elif low == ")":
            while operators and operators[-1] != "(":
                if not apply():
                    return invalid
            if not operators:
                return invalid
            operators.pop()
            labels, restricts, _ = values.pop()
            values.append((labels, restricts, False))
        elif low in _BINDS:
            while operators and _BINDS.get(operators[-1], 0) >= _BINDS[low]:
                if not apply():
                    return invalid
            operators.append(low)
            operand = True
        else:
            label = label_of(low)
            values.append((frozenset([label]), RESTRICTS[label], True))
            operand = False
    while operators:
        if operators[-1] == "(" or operand or not apply():
            return invalid
    return values[0][:2] if values else invalid


def expressions(text: bytes) -> list[tuple[frozenset, float]]:
    """Values of all tagged expressions of a text."""
    return [evaluate(_TOKENS.findall(m.decode("latin-1"))) for m in _EXPRESSION.findall(text)]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in sorted({*BASE, *NOTICES, *TAGS}):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def phrases_in(words: ahocorasick.Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """Words of each row, and (row, word, phrase) of every place of a phrase."""
    rows = len(offsets) - 1
    # Every row begins with a separator, which keeps rows apart.
    spaced = np.zeros(len(data) + rows + 1, np.uint8)
    begin = offsets[:-1] + np.arange(rows)
    spaced[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = lowered(data)
    word = _WORD[spaced]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = np.zeros(len(word), bool)
    last[1:] = ~word[1:] & word[:-1]
    row_end = np.zeros(len(word), bool)
    row_end[begin] = row_end[-1] = True
    keep = word | last | row_end
    spaced[~word] = 32
    starts = np.flatnonzero(first[keep])  # of words, in the squeezed text
    squeezed = spaced[keep]
    ends = np.flatnonzero(row_end[keep])
    # Two separators in place of one at the border of rows: a phrase holds single spaces only.
    text = np.insert(squeezed, ends, 32)
    starts = starts + np.searchsorted(ends, starts, "right")
    row_of = np.searchsorted(begin, np.flatnonzero(first), "right") - 1
    number = np.bincount(row_of, minlength=rows)
    before = np.cumsum(number) - number
    hits = []
    for end, phrase in words.iter(text.tobytes().decode("latin-1")):
        w = int(np.searchsorted(starts, end - len(phrase)))
        row = int(row_of[w])
        hits.append((row, w - int(before[row]), phrase))
    return number, hits


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, words that begin in the part itself) of parts of one long text; the words after those only complete phrases."""
    lo = 0
    while lo < len(data):
        hi = min(lo + PART_BYTES, len(data))
        while hi < len(data) and _WORD[data[hi]] and _WORD[data[hi - 1]]:
            stop = np.flatnonzero(~_WORD[data[hi : hi + PART_BYTES]])
            hi = hi + int(stop[0]) if len(stop) else min(hi + PART_BYTES, len(data))
        end, step = hi, 1 << 10
        while end < len(data):
            word = _WORD[data[hi : hi + step]]
            over = np.flatnonzero(word[:-1] & ~word[1:])
            if len(over) >= _PHRASE_WORDS or hi + step >= len(data):
                end = hi + int(over[_PHRASE_WORDS - 1]) + 1 if len(over) >= _PHRASE_WORDS else len(data)
                break
            step *= 2
        word = _WORD[data[lo:hi]]
        yield data[lo:end], int(word[0]) + int((word[1:] & ~word[:-1]).sum())
        lo = hi


def scan_block(words: ahocorasick.Automaton, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    if len(offsets) == 2 and len(data) > 2 * PART_BYTES:
        total, hits = 0, []
        for part, own in _parts(data):
            hits += [(0, total + w, p) for _, w, p in phrases_in(words, part, np.array([0, len(part)]))[1] if w < own]
            total += own
        number = [total]
    else:
        number, hits = phrases_in(words, data, offsets)
    by_row: dict[int, list[tuple[int, str]]] = {}
    for row, w, phrase in hits:
        by_row.setdefault(row, []).append((w, phrase))
    out = []
    for row, n in enumerate(number):
        found = by_row.get(row)
        if not found:
            out.append((int(n), 0, None, None, "", "", 0.0))
            continue
        places = [w for w, phrase in found if phrase in BASE]
        base = {BASE[p] for _, p in found if p in BASE}
        labels = base | {NOTICES[p] for _, p in found if p in NOTICES}
        score = max((RESTRICTS[x] for x in labels), default=0.0)
        if any(p in TAGS for _, p in found):
            for names, restricts in expressions(data[offsets[row] : offsets[row + 1]].tobytes()):
                labels, score = labels | names, max(score, restricts)
        out.append((int(n), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


_COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices and tags of every row.

    Null and empty texts have no words, no labels and score 0; a null id stays,
    repeated rows come out repeated, other columns are ignored, empty tables give no
    row. A phrase may stand across lines; places that overlap all count. A very
    long text is read in parts that overlap by the words of a phrase.
    """
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = [r for _, _, data, offsets in blocks(batch.column(1)) for r in scan_block(words, data, offsets)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, _COLUMNS)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_phrases() -> str:
    """(phrase, base, label) as SQL values, and the test whether one begins at a word."""
    tests = []
    for phrase in {**BASE, **NOTICES}:
        label, parts = {**NOTICES, **BASE}[phrase], phrase.split()
        fits = " AND ".join(f"w{j} = '{p}'" for j, p in enumerate(parts))
        tests.append(f"SELECT rid, i, {str(phrase in BASE).lower()} AS base, '{label}' AS label FROM led WHERE {fits}")
    return " UNION ALL ".join(tests)


_SQL_LABEL = "CASE " + " ".join(f"WHEN starts_with(tok, '{start}') THEN '{label}'" for start, label in IDENTIFIERS.items()) + f" ELSE '{OTHER}' END"
_SQL_RESTRICTS = "CASE {} " + " ".join(f"WHEN '{label}' THEN {value}" for label, value in RESTRICTS.items()) + " END"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LEADS = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(1, _PHRASE_WORDS))
_SQL_TAGGED = "(?is)" + _TAGGED.replace("(?:^|", r"(?:\A|")
_BIND = "CASE {} WHEN 'or' THEN 1 WHEN 'and' THEN 2 WHEN 'with' THEN 3 ELSE 0 END"
# One step of the shunting-yard a round: a token is shifted, or the operator on top is applied.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ws AS (
  SELECT rid, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM t),
each AS (SELECT rid, unnest(ws) AS w0, unnest(range(len(ws))) AS i FROM ws),
led AS MATERIALIZED (SELECT rid, i, w0, {_LEADS.replace("(w,", "(w0,")} FROM each WINDOW o AS (PARTITION BY rid ORDER BY i)),
hit AS ({_sql_phrases()}),
tag AS (SELECT rid, unnest(regexp_extract_all(text, '{_SQL_TAGGED}', 1)) AS said FROM t WHERE contains(lower(text), 'license')),
yard AS (
  SELECT row_number() OVER () AS k, rid, list_transform(regexp_extract_all(said, '{_TOKEN}'), lambda x: lower(x)) AS toks, 1 AS i,
         CAST([] AS STRUCT(l VARCHAR[], r DOUBLE, bare BOOLEAN)[]) AS vals, CAST([] AS VARCHAR[]) AS ops, true AS operand, 'go' AS state FROM tag
  UNION ALL
  SELECT k, rid, toks, CASE WHEN act IN ('apply', 'bad', 'end') THEN i ELSE i + 1 END,
         CASE act WHEN 'push' THEN list_append(vals, {{'l': [{_SQL_LABEL}], 'r': {_SQL_RESTRICTS.format("(" + _SQL_LABEL + ")")}, 'bare': true}})
              WHEN 'close' THEN list_append(vals[:-2], {{'l': vals[-1].l, 'r': vals[-1].r, 'bare': false}})
              WHEN 'apply' THEN list_append(vals[:-3], CASE ops[-1] WHEN 'with' THEN {{'l': vals[-2].l, 'r': least(vals[-2].r, {EXCEPTED}), 'bare': false}}
                   WHEN 'and' THEN {{'l': list_concat(vals[-2].l, vals[-1].l), 'r': greatest(vals[-2].r, vals[-1].r), 'bare': false}}
                   ELSE {{'l': list_concat(vals[-2].l, vals[-1].l), 'r': least(vals[-2].r, vals[-1].r), 'bare': false}} END) ELSE vals END,
         CASE act WHEN 'open' THEN list_append(ops, tok) WHEN 'operator' THEN list_append(ops, tok) WHEN 'close' THEN ops[:-2] WHEN 'apply' THEN ops[:-2] ELSE ops END,
         CASE act WHEN 'push' THEN false WHEN 'operator' THEN true ELSE operand END,
         CASE WHEN act = 'bad' OR (act = 'apply' AND ops[-1] = 'with' AND NOT (vals[-1].bare AND vals[-2].bare)) THEN 'bad' WHEN act = 'end' THEN 'end' ELSE 'go' END
  FROM (SELECT *, CASE
          WHEN tok IS NULL THEN CASE WHEN operand OR ops[-1] = '(' THEN 'bad' WHEN len(ops) = 0 THEN 'end' ELSE 'apply' END
          WHEN (tok = '(' OR tok NOT IN ('and', 'or', 'with', ')')) <> operand THEN 'bad'
          WHEN tok = '(' THEN 'open' WHEN tok = ')' THEN CASE WHEN len(ops) = 0 THEN 'bad' WHEN ops[-1] = '(' THEN 'close' ELSE 'apply' END
          WHEN tok IN ('and', 'or', 'with') THEN CASE WHEN len(ops) > 0 AND {_BIND.format("ops[-1]")} >= {_BIND.format("tok")} THEN 'apply' ELSE 'operator' END
          ELSE 'push' END AS act FROM (SELECT *, toks[i] AS tok FROM yard WHERE state = 'go'))),
said AS (
  SELECT rid, CASE state WHEN 'end' THEN vals[1].l ELSE ['{INVALID}'] END AS l, CASE state WHEN 'end' THEN vals[1].r ELSE {RESTRICTS[INVALID]} END AS r FROM yard WHERE state <> 'go'),
lab AS (
  SELECT rid, i, base, label, {_SQL_RESTRICTS.format("label")} AS r FROM hit UNION ALL SELECT rid, NULL, false, unnest(l), r FROM said),
d AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, CAST(max(r) AS DOUBLE) AS score
  FROM lab GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM t JOIN ws USING (rid) LEFT JOIN d USING (rid)
"""
